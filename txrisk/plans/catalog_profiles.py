"""Named queries: profiles by class and the account network."""

from pyspark.sql import functions as F

from txrisk.operators import network, profiles
from txrisk.operators.profiles import LABEL
from txrisk.plans.catalog import query
from txrisk.plans.oracle import BASE, rate_sql
from txrisk.session import materialize
from txrisk.sources.warehouse import payments


@query(
    "class_counts",
    f"""{BASE} SELECT count(*) AS total, count(*) FILTER (is_laundering = 1) AS positives,
    count(*) FILTER (is_laundering = 0) AS negatives,
    round(count(*) FILTER (is_laundering = 1)::DOUBLE / count(*)::DOUBLE * 100e0, 3) AS positive_pct FROM tx""",
)
def class_counts(spark, folder):
    return profiles.class_counts(payments(spark, folder))


@query(
    "class_distribution",
    f"""{BASE} SELECT is_laundering, CASE is_laundering WHEN 1 THEN 'Laundering' ELSE 'Legitimate' END AS label,
    count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM tx)::DOUBLE * 100e0, 3) AS pct
    FROM tx GROUP BY is_laundering""",
)
def class_distribution(spark, folder):
    return profiles.class_distribution(payments(spark, folder))


@query(
    "amount_stats_by_class",
    f"""{BASE} SELECT is_laundering, round(avg(amount_paid), 2) AS avg_amount,
    round(min(amount_paid), 2) AS min_amount, round(max(amount_paid), 2) AS max_amount,
    round(stddev_samp(amount_paid), 2) AS std_amount FROM tx GROUP BY is_laundering""",
)
def amount_stats_by_class(spark, folder):
    return profiles.amount_stats(payments(spark, folder))


@query("rate_by_payment_format", rate_sql("payment_format", "payment_format"))
def rate_by_payment_format(spark, folder):
    rates = profiles.rate_by(payments(spark, folder), F.col("payment_format"), "payment_format")
    return rates.orderBy(F.col("rate_pct").desc(), "payment_format")


@query("rate_by_currency", rate_sql("payment_currency", "payment_currency"))
def rate_by_currency(spark, folder):
    rates = profiles.rate_by(payments(spark, folder), F.col("payment_currency"), "payment_currency")
    return rates.orderBy(F.col("rate_pct").desc(), "payment_currency")


@query("rate_by_hour", rate_sql("hour_of_day", "hour_of_day"))
def rate_by_hour(spark, folder):
    return profiles.rate_by(payments(spark, folder), F.hour("ts"), "hour_of_day").orderBy("hour_of_day")


@query("peak_hours_top5", rate_sql("hour_of_day", "hour_of_day") + " ORDER BY rate_pct DESC, hour_of_day LIMIT 5")
def peak_hours_top5(spark, folder):
    rates = profiles.rate_by(payments(spark, folder), F.hour("ts"), "hour_of_day")
    return profiles.top_by(rates, "rate_pct", 5, "hour_of_day")


@query(
    "rate_by_weekday",
    rate_sql(
        "['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][day_of_week]", "day_name"
    ),
)
def rate_by_weekday(spark, folder):
    return profiles.rate_by(payments(spark, folder), profiles.weekday_name(F.dayofweek("ts")), "day_name")


@query(
    "rate_by_cross_border",
    rate_sql("CASE is_cross_border WHEN 1 THEN 'Cross-Border' ELSE 'Same Bank' END", "transfer"),
)
def rate_by_cross_border(spark, folder):
    name = profiles.cross_border_name(F.col("from_bank"), F.col("to_bank"))
    return profiles.rate_by(payments(spark, folder), name, "transfer")


@query(
    "rate_by_currency_mismatch",
    rate_sql(
        "CASE WHEN payment_currency <> receiving_currency THEN 'Currency Mismatch' ELSE 'Same Currency' END",
        "currencies",
    ),
)
def rate_by_currency_mismatch(spark, folder):
    name = profiles.currency_match_name(F.col("payment_currency"), F.col("receiving_currency"))
    return profiles.rate_by(payments(spark, folder), name, "currencies")


@query(
    "rate_by_structuring",
    rate_sql("CASE is_near_threshold WHEN 1 THEN '$8K-$10K Range' ELSE 'Other Amounts' END", "amounts"),
)
def rate_by_structuring(spark, folder):
    name = profiles.structuring_name(F.col("amount_paid"))
    return profiles.rate_by(payments(spark, folder), name, "amounts")


@query(
    "pivot_by_class",
    f"""{BASE} SELECT payment_format, count(*) FILTER (is_laundering = 0) AS legitimate,
    count(*) FILTER (is_laundering = 1) AS laundering FROM tx GROUP BY payment_format""",
)
def pivot_by_class(spark, folder):
    return profiles.pivot_by_class(payments(spark, folder), "payment_format")


@query(
    "top_banks",
    f"""{BASE} SELECT from_bank, count(*) AS n FROM tx WHERE is_laundering = 1 GROUP BY from_bank
    ORDER BY n DESC, from_bank LIMIT 10""",
)
def top_banks(spark, folder):
    positives = payments(spark, folder).where(F.col(LABEL) == 1)
    counted = positives.groupBy("from_bank").agg(F.count(F.lit(1)).alias("n"))
    return profiles.top_by(counted, "n", 10, "from_bank")


@query(
    "self_loops",
    f"""{BASE} SELECT count(*) AS self_loops, count(*) FILTER (is_laundering = 1) AS laundering_self_loops,
    round(count(*) FILTER (is_laundering = 1)::DOUBLE / nullif(count(*), 0)::DOUBLE * 100e0, 3) AS rate_pct
    FROM tx WHERE from_account = to_account""",
)
def self_loops(spark, folder):
    return network.self_loops(payments(spark, folder))


@query(
    "cycle_pairs",
    f"""{BASE} SELECT p.cycle_pairs, p.laundering_pairs, t.cycle_tx, t.laundering_tx,
    round(p.laundering_pairs::DOUBLE / nullif(p.cycle_pairs, 0)::DOUBLE * 100e0, 3) AS rate_pct FROM
    (SELECT count(*) AS cycle_pairs, coalesce(sum(f.is_laundering), 0)::BIGINT AS laundering_pairs
     FROM tx f JOIN tx r ON f.from_account = r.to_account AND f.to_account = r.from_account
     WHERE f.from_account <> f.to_account) p,
    (SELECT count(*) AS cycle_tx, coalesce(sum(is_laundering), 0)::BIGINT AS laundering_tx FROM tx
     WHERE from_account <> to_account
       AND (to_account, from_account) IN (SELECT (from_account, to_account) FROM edge)) t""",
)
def cycle_pairs(spark, folder):
    return network.cycle_pair_counts(network.edges(payments(spark, folder)))


@query("cycle_edges", f"{BASE} SELECT from_account, to_account, n_tx FROM cycle")
def cycle_edges(spark, folder):
    return network.cycle_edges(network.edges(payments(spark, folder)))


@query(
    "distinct_edges", f"{BASE} SELECT DISTINCT from_account, to_account FROM tx"
)
def distinct_edges(spark, folder):
    return network.distinct_edges(payments(spark, folder))


def _degree_sql(account: str, other: str) -> str:
    return f"""SELECT {account}, is_laundering, count(DISTINCT {other}) AS counterparties,
    count(*) AS n_tx, round(sum(amount_paid), 2) AS total_amount FROM tx GROUP BY {account}, is_laundering"""


def _summary_sql(inner: str) -> str:
    return f"""SELECT is_laundering, round(avg(counterparties), 2) AS avg_counterparties,
    round(avg(n_tx), 2) AS avg_tx, max(counterparties) AS max_counterparties
    FROM ({inner}) GROUP BY is_laundering"""


_OUT, _IN = _degree_sql("from_account", "to_account"), _degree_sql("to_account", "from_account")


def _top_degrees(degrees, account):
    return profiles.top_by(degrees.where(F.col(LABEL) == 1), "counterparties", 10, account)


def _top_degree_sql(inner: str, account: str) -> str:
    return f"""{BASE} SELECT * FROM ({inner}) WHERE is_laundering = 1
    ORDER BY counterparties DESC, {account} LIMIT 10"""


@query("fan_out_accounts", f"{BASE} {_OUT}")
def fan_out_accounts(spark, folder):
    return network.degree_by_class(payments(spark, folder), "out")


@query("fan_out_summary", f"{BASE} {_summary_sql(_OUT)}")
def fan_out_summary(spark, folder):
    return network.degree_summary(network.degree_by_class(payments(spark, folder), "out"))


@query("fan_out_top", _top_degree_sql(_OUT, "from_account"))
def fan_out_top(spark, folder):
    return _top_degrees(network.degree_by_class(payments(spark, folder), "out"), "from_account")


@query("fan_in_accounts", f"{BASE} {_IN}")
def fan_in_accounts(spark, folder):
    return network.degree_by_class(payments(spark, folder), "in")


@query("fan_in_summary", f"{BASE} {_summary_sql(_IN)}")
def fan_in_summary(spark, folder):
    return network.degree_summary(network.degree_by_class(payments(spark, folder), "in"))


@query("fan_in_top", _top_degree_sql(_IN, "to_account"))
def fan_in_top(spark, folder):
    return _top_degrees(network.degree_by_class(payments(spark, folder), "in"), "to_account")


_VELOCITY = "SELECT from_account, is_laundering, count(*) AS n_tx FROM tx GROUP BY ALL"


@query(
    "velocity_summary",
    f"""{BASE} SELECT is_laundering, round(avg(n_tx), 2) AS avg_tx, max(n_tx) AS max_tx
    FROM ({_VELOCITY}) GROUP BY is_laundering""",
)
def velocity_summary(spark, folder):
    return network.velocity_summary(network.velocity_by_class(payments(spark, folder)))


@query(
    "velocity_top",
    f"""{BASE} SELECT * FROM ({_VELOCITY}) WHERE is_laundering = 1 ORDER BY n_tx DESC, from_account LIMIT 10""",
)
def velocity_top(spark, folder):
    velocity = network.velocity_by_class(payments(spark, folder))
    return profiles.top_by(velocity.where(F.col(LABEL) == 1), "n_tx", 10, "from_account")


@query(
    "bank_flow_top",
    f"""{BASE} SELECT from_bank, to_bank, count(*) AS n_tx, round(sum(amount_paid), 2) AS total_amount,
    from_bank::VARCHAR || ' → ' || to_bank::VARCHAR AS flow
    FROM tx WHERE is_laundering = 1 GROUP BY from_bank, to_bank
    ORDER BY n_tx DESC, from_bank, to_bank LIMIT 10""",
)
def bank_flow_top(spark, folder):
    from txrisk.functions.scalars import pair_label

    top = profiles.top_by(network.bank_flows(payments(spark, folder)), "n_tx", 10, "from_bank", "to_bank")
    return top.withColumn("flow", pair_label(F.col("from_bank"), F.col("to_bank")))


@query(
    "graph_size",
    f"""{BASE} SELECT (SELECT count(*) FROM (SELECT from_account FROM tx UNION SELECT to_account FROM tx)) AS nodes,
    count(*) AS edges, sum(n_tx)::BIGINT AS transactions, sum(n_laundering)::BIGINT AS laundering_transactions
    FROM edge""",
)
def graph_size(spark, folder):
    return network.graph_size(materialize(network.edges(payments(spark, folder)), "edges"))
