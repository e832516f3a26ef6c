"""Named queries: features, cleaning, splits and samples."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import fixed_values as fv
from txrisk.functions import row_features as rf
from txrisk.functions.scalars import fx_rate, size_band, to_usd
from txrisk.operators import cleaning, history, network, profiles, rolling, splitting
from txrisk.operators.history import fit_history
from txrisk.plans.catalog import query
from txrisk.plans.feature_table import feature_table, request_features, transform
from txrisk.plans.oracle import BASE, case_of
from txrisk.session import materialize
from txrisk.sources.warehouse import payments

_KEYS = ["ts", "from_account", "to_account", "from_bank", "to_bank", "amount_paid", "payment_format", "is_laundering"]
_KEY_SQL = ", ".join(_KEYS)
_FEATURE_SQL = ", ".join(fv.FEATURES)
_CARRY_SQL = (
    "from_account, to_account, from_bank, to_bank, amount_paid, ts, is_laundering, payment_format, payment_currency"
)
_ROW_FEATURES = fv.FEATURES[:9]


@query("row_features", f"{BASE} SELECT {_KEY_SQL}, {', '.join(_ROW_FEATURES)} FROM rowf")
def row_features(spark, folder):
    return rf.add_row_features(payments(spark, folder)).select(*_KEYS, *_ROW_FEATURES)


@query(
    "account_features",
    f"""{BASE} SELECT coalesce(s.from_account, r.to_account) AS account, fan_out_degree, tx_velocity, total_sent,
    avg_sent, amount_per_tx, fan_in_degree, total_received, avg_received,
    CASE WHEN fan_out_degree > 40 THEN 1 ELSE 0 END AS is_high_fan_out
    FROM sender s FULL JOIN receiver r ON s.from_account = r.to_account""",
)
def account_features(spark, folder):
    edge_table = materialize(network.edges(payments(spark, folder)), "edges")
    sent = history.sender_history(edge_table).withColumnRenamed("from_account", "account")
    received = history.receiver_history(edge_table).withColumnRenamed("to_account", "account").drop("n_received")
    return sent.join(received, "account", "full").withColumn("is_high_fan_out", history.high_fan_out(40))


@query(
    "bank_features",
    f"""{BASE} SELECT from_bank, bank_avg_amount, bank_std_amount, bank_total_tx, bank_laund_tx,
    bank_risk_score, is_hub_bank FROM bank""",
)
def bank_features(spark, folder):
    return history.bank_history(payments(spark, folder))


@query("cycle_flags", f"{BASE} SELECT {_KEY_SQL}, is_in_cycle FROM feat")
def cycle_flags(spark, folder):
    tx = payments(spark, folder)
    flagged = history.attach_history(tx, fit_history(tx, ("cycle",)))
    return cleaning.fill_history(flagged).select(*_KEYS, "is_in_cycle")


@query("hub_flags", f"{BASE} SELECT {_KEY_SQL}, is_hub_bank FROM feat")
def hub_flags(spark, folder):
    tx = payments(spark, folder)
    flagged = history.attach_history(tx, fit_history(tx, ("bank",)))
    return cleaning.fill_history(flagged).select(*_KEYS, "is_hub_bank")


@query("feature_table", f"{BASE} SELECT {_FEATURE_SQL}, {_CARRY_SQL} FROM feat")
def full_feature_table(spark, folder):
    return feature_table(payments(spark, folder))


_TRAIN = """(SELECT * FROM rowf WHERE epoch(ts)::BIGINT <=
  (SELECT min(epoch(ts)::BIGINT) + (max(epoch(ts)::BIGINT) - min(epoch(ts)::BIGINT)) * 8e-1 FROM tx))"""


@query(
    "features_train_only",
    f"""{BASE},
    past AS {_TRAIN},
    s AS (SELECT from_account, count(DISTINCT to_account) AS fo, count(*) AS v,
                 round((round(sum(amount_paid), 2) / count(*))::VARCHAR::DECIMAL(38,18), 2)::DOUBLE AS per
          FROM past GROUP BY from_account),
    t AS (SELECT to_account, count(DISTINCT from_account) AS fi FROM past GROUP BY to_account),
    b0 AS (SELECT from_bank, round(avg(amount_paid), 2) AS m, round(stddev_samp(amount_paid), 2) AS sd,
                  count(*) AS n, sum(is_laundering)::BIGINT AS bad FROM past GROUP BY from_bank),
    b AS (SELECT *, CASE WHEN bad > 0 AND row_number() OVER (ORDER BY bad DESC, from_bank) <= 20
                    THEN 1 ELSE 0 END AS hub FROM b0),
    e AS (SELECT DISTINCT from_account, to_account FROM past),
    c AS (SELECT x.from_account, x.to_account FROM e x
          JOIN e y ON x.from_account = y.to_account AND x.to_account = y.from_account)
    SELECT r.is_cross_border, r.hour_of_day, r.is_peak_hour, r.day_of_week, r.is_weekend, r.payment_format_risk,
      r.currency_risk_score, r.amount_log, r.is_near_threshold,
      coalesce(s.fo, 0) AS fan_out_degree, coalesce(t.fi, 0) AS fan_in_degree, coalesce(s.v, 1) AS tx_velocity,
      coalesce(s.per, 0e0) AS amount_per_tx,
      coalesce(round((r.amount_paid - b.m) / CASE WHEN b.sd > 0 THEN b.sd ELSE 1e0 END, 4), 0e0) + 0e0
        AS amount_zscore_per_bank,
      coalesce(round(b.bad::DOUBLE / b.n * 100e0, 6), 0e0) AS bank_risk_score,
      CASE WHEN s.fo > 100 THEN 1 ELSE 0 END AS is_high_fan_out,
      CASE WHEN c.from_account IS NULL THEN 0 ELSE 1 END AS is_in_cycle,
      coalesce(b.hub, 0) AS is_hub_bank,
      r.from_account, r.to_account, r.from_bank, r.to_bank, r.amount_paid, r.ts, r.is_laundering,
      r.payment_format, r.payment_currency
    FROM rowf r LEFT JOIN s USING (from_account) LEFT JOIN t USING (to_account) LEFT JOIN b USING (from_bank)
    LEFT JOIN c ON c.from_account = r.from_account AND c.to_account = r.to_account
    WHERE epoch(r.ts)::BIGINT >
      (SELECT min(epoch(ts)::BIGINT) + (max(epoch(ts)::BIGINT) - min(epoch(ts)::BIGINT)) * 8e-1 FROM tx)""",
)
def features_train_only(spark, folder):
    """Features of the later rows with history of the earlier ones only."""
    parts = splitting.split_temporal(payments(spark, folder))
    past = fit_history(parts.where("split = 'train'"))
    return transform(parts.where("split = 'test'"), past)


@query(
    "request_features",
    f"""{BASE} SELECT r.is_cross_border, 12 AS hour_of_day, 1 AS is_peak_hour, 2 AS day_of_week, 0 AS is_weekend,
    r.payment_format_risk, r.currency_risk_score, r.amount_log, r.is_near_threshold,
    s.fan_out_degree, 1::BIGINT AS fan_in_degree, s.tx_velocity,
    round((r.amount_paid / s.tx_velocity)::VARCHAR::DECIMAL(38,18), 2)::DOUBLE AS amount_per_tx,
    0e0 AS amount_zscore_per_bank, 15e-2 AS bank_risk_score,
    CASE WHEN s.fan_out_degree > 100 THEN 1 ELSE 0 END AS is_high_fan_out, 0 AS is_in_cycle, 0 AS is_hub_bank,
    r.payment_format, r.amount_paid AS amount, r.from_bank::VARCHAR AS from_bank,
    r.to_bank::VARCHAR AS to_bank, r.payment_currency AS currency
    FROM rowf r JOIN sender s USING (from_account)""",
)
def all_request_features(spark, folder):
    """Every payment turned into a scoring request and scored without history."""
    tx = payments(spark, folder)
    known = history.attach_history(tx, fit_history(tx, ("sender",)))
    requests = known.select(
        "payment_format",
        F.col("amount_paid").alias("amount"),
        F.col("from_bank").cast("string").alias("from_bank"),
        F.col("to_bank").cast("string").alias("to_bank"),
        F.col("payment_currency").alias("currency"),
        F.col("fan_out_degree").cast("int").alias("fan_out"),
        F.col("tx_velocity").cast("int").alias("tx_velocity"),
    )
    return request_features(requests)


@query(
    "request_violations",
    f"""{BASE}, req AS (SELECT CASE WHEN to_account % 9 <> 0 THEN payment_format END AS payment_format,
      CASE WHEN to_account % 11 <> 0 THEN CASE WHEN to_account % 7 = 0 THEN -amount_paid ELSE amount_paid END END
        AS amount,
      CASE WHEN from_account % 13 <> 0 THEN from_bank END AS from_bank,
      CASE WHEN from_account % 17 <> 0 THEN to_bank END AS to_bank,
      CASE WHEN to_account % 8 <> 0 THEN payment_currency END AS currency,
      CASE WHEN from_account % 11 <> 0 THEN from_account % 5 END AS fan_out,
      CASE WHEN from_account % 19 <> 0 THEN from_account % 7 END AS tx_velocity FROM tx),
    bad AS (SELECT unnest([
        CASE WHEN payment_format IS NULL THEN 'missing payment_format' END,
        CASE WHEN amount IS NULL THEN 'missing amount' WHEN amount <= 0 THEN 'amount not positive' END,
        CASE WHEN from_bank IS NULL THEN 'missing from_bank' END,
        CASE WHEN to_bank IS NULL THEN 'missing to_bank' END,
        CASE WHEN currency IS NULL THEN 'missing currency' END,
        CASE WHEN fan_out IS NULL THEN 'missing fan_out' WHEN fan_out < 1 THEN 'fan_out below 1' END,
        CASE WHEN tx_velocity IS NULL THEN 'missing tx_velocity' WHEN tx_velocity < 1 THEN 'tx_velocity below 1' END,
        CASE WHEN payment_format IS NOT NULL AND amount > 0 AND from_bank IS NOT NULL AND to_bank IS NOT NULL
          AND currency IS NOT NULL AND fan_out >= 1 AND tx_velocity >= 1 THEN 'accepted' END
      ]) AS reason FROM req)
    SELECT reason, count(*) AS n FROM bad WHERE reason IS NOT NULL GROUP BY reason""",
)
def request_violations(spark, folder):
    """Requests damaged on purpose, every rule: how often each rejects."""
    sender, receiver, amount = F.col("from_account"), F.col("to_account"), F.col("amount_paid")
    requests = payments(spark, folder).select(
        F.when(receiver % 9 != 0, F.col("payment_format")).alias("payment_format"),
        F.when(receiver % 11 != 0, F.when(receiver % 7 == 0, -amount).otherwise(amount)).alias("amount"),
        F.when(sender % 13 != 0, F.col("from_bank").cast("string")).alias("from_bank"),
        F.when(sender % 17 != 0, F.col("to_bank").cast("string")).alias("to_bank"),
        F.when(receiver % 8 != 0, F.col("payment_currency")).alias("currency"),
        F.when(sender % 11 != 0, (sender % 5).cast("int")).alias("fan_out"),
        F.when(sender % 19 != 0, (sender % 7).cast("int")).alias("tx_velocity"),
    )
    reasons = cleaning.request_violations()
    named = F.explode(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("accepted"))))
    return requests.select(named.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_rejects",
    f"""{BASE}, raw AS (SELECT CASE WHEN to_account % 13 = 0 THEN 'n/a' ELSE strftime(ts, '%Y/%m/%d %H:%M') END AS t,
      CASE WHEN to_account % 11 <> 0 THEN from_account END AS a, CASE WHEN from_account % 7 <> 0 THEN to_account END AS b,
      CASE WHEN from_account % 11 <> 0 THEN amount_paid END AS m,
      CASE WHEN from_account % 13 <> 0 THEN is_laundering END AS l FROM tx),
    bad AS (SELECT 'missing from_account' AS reason FROM raw WHERE a IS NULL
      UNION ALL SELECT 'missing to_account' FROM raw WHERE b IS NULL
      UNION ALL SELECT 'missing amount_paid' FROM raw WHERE m IS NULL
      UNION ALL SELECT 'missing is_laundering' FROM raw WHERE l IS NULL
      UNION ALL SELECT 'bad ts' FROM raw WHERE t = 'n/a'
      UNION ALL SELECT 'accepted' FROM raw WHERE a IS NOT NULL AND b IS NOT NULL AND m IS NOT NULL AND l IS NOT NULL
        AND t <> 'n/a')
    SELECT reason, count(*) AS n FROM bad GROUP BY reason""",
)
def clean_rejects(spark, folder):
    """Raw text rows damaged on purpose, every way: why rows are quarantined."""
    sender, receiver = F.col("from_account"), F.col("to_account")
    raw = payments(spark, folder).select(
        F.when(receiver % 13 == 0, "n/a")
        .otherwise(F.replace(F.substring(F.col("ts").cast("string"), 1, 16), F.lit("-"), F.lit("/")))
        .alias("ts"),
        F.when(receiver % 11 != 0, sender.cast("string")).alias("from_account"),
        F.when(sender % 7 != 0, receiver.cast("string")).alias("to_account"),
        F.when(sender % 11 != 0, F.col("amount_paid")).alias("amount_paid"),
        F.when(sender % 13 != 0, F.col("is_laundering")).alias("is_laundering"),
    )
    good, bad = cleaning.split_rejects(raw, cleaning.reject_reasons(raw))
    accepted = cleaning.parse_timestamp(cleaning.drop_incomplete(good)).select(F.lit("accepted").alias("reason"))
    reasons = splitting.union_parts(accepted, bad.select(F.explode("reasons").alias("reason")))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rolling_bank_risk",
    f"""{BASE} SELECT {_KEY_SQL}, (coalesce(count(*) OVER w, 0))::BIGINT AS past_tx,
    (coalesce(sum(is_laundering) OVER w, 0))::BIGINT AS past_laundering,
    coalesce(round((sum(is_laundering) OVER w)::DOUBLE / nullif((count(*) OVER w), 0) * 100e0, 6), 0e0)
      AS rolling_bank_risk
    FROM tx WINDOW w AS (PARTITION BY from_bank ORDER BY ts
      RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""",
)
def rolling_bank_risk(spark, folder):
    return rolling.with_rolling_bank_risk(payments(spark, folder)).select(
        *_KEYS, "past_tx", "past_laundering", "rolling_bank_risk"
    )


def _means_sql(names, digits=4):
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS feature,
        round(avg(CASE WHEN is_laundering = 1 THEN {n} END), {digits}) AS laundering_avg,
        round(avg(CASE WHEN is_laundering = 0 THEN {n} END), {digits}) AS legitimate_avg FROM feat"""
        for n in names
    )


@query("feature_class_means", f"{BASE} {_means_sql(fv.FEATURES)}")
def feature_class_means(spark, folder):
    return profiles.feature_class_means(feature_table(payments(spark, folder)))


@query(
    "feature_lift",
    f"""{BASE} SELECT *, round((laundering_avg / greatest(legitimate_avg, 1e-4))::VARCHAR::DECIMAL(38,18), 2)::DOUBLE AS lift
    FROM ({_means_sql(fv.LIFT_FEATURES)})""",
)
def feature_lift(spark, folder):
    return profiles.feature_lift(feature_table(payments(spark, folder)))


_STRANGER = "to_account % 3 = 0"
_NULLS = {
    **dict.fromkeys(("fan_out_degree", "tx_velocity", "amount_per_tx"), _STRANGER),
    "is_in_cycle": f"{_STRANGER} OR is_in_cycle = 0",
}


def _with_strangers(tx):
    """The payments to every third receiver come from accounts that history does not know."""
    stranger = F.when(F.expr(_STRANGER), -1 - F.col("from_account")).otherwise(F.col("from_account"))
    return tx.withColumn("from_account", stranger)


@query(
    "null_profile",
    BASE + " UNION ALL ".join(
        f" SELECT '{name}' AS feature, count(*) FILTER ({_NULLS.get(name, 'false')}) AS n_null FROM feat"
        for name in fv.FEATURES
    ),
)
def null_profile(spark, folder):
    """Nulls of all features before filling, history of all payments, some senders unknown to it."""
    tx = payments(spark, folder)
    return profiles.null_profile(transform(_with_strangers(tx), fit_history(tx), fill=False))


def _filled_sql(name, value):
    return f"CASE WHEN {_STRANGER} THEN {value} ELSE {name} END AS {name}"


@query(
    "null_fill",
    f"""{BASE} SELECT {_KEY_SQL.replace('from_account', _filled_sql('from_account', '-1 - from_account'))},
    {_filled_sql('fan_out_degree', 0)}, {_filled_sql('tx_velocity', 1)}, {_filled_sql('amount_per_tx', '0e0')},
    {_filled_sql('is_high_fan_out', 0)}, {_filled_sql('is_in_cycle', 0)},
    fan_in_degree, amount_zscore_per_bank, bank_risk_score, is_hub_bank FROM feat""",
)
def null_fill(spark, folder):
    tx = payments(spark, folder)
    return transform(_with_strangers(tx), fit_history(tx)).select(
        *_KEYS,
        "fan_out_degree",
        "tx_velocity",
        "amount_per_tx",
        "is_high_fan_out",
        "is_in_cycle",
        "fan_in_degree",
        "amount_zscore_per_bank",
        "bank_risk_score",
        "is_hub_bank",
    )


# --- splits ----------------------------------------------------------------
_TEXT_KEYS = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "is_laundering"]


def _bucket_sql(salt: str, buckets: int = 10000) -> str:
    text = """concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), from_account::VARCHAR, to_account::VARCHAR,
      amount_paid::DECIMAL(38,6)::VARCHAR, payment_format, is_laundering::VARCHAR)"""
    return f"(('0x' || substr(md5('{salt}|' || {text}), 1, 8))::BIGINT % {buckets})"


_SPLIT = f"CASE WHEN {_bucket_sql('split-42')} < 8000 THEN 'train' ELSE 'test' END"


@query("split_stratified", f"{BASE} SELECT {_KEY_SQL}, {_SPLIT} AS split FROM tx")
def split_stratified(spark, folder):
    return splitting.split_stratified(payments(spark, folder).select(*_KEYS), columns=_TEXT_KEYS)


@query(
    "split_temporal",
    f"""{BASE} SELECT {_KEY_SQL}, CASE WHEN epoch(ts)::BIGINT <=
      (SELECT min(epoch(ts)::BIGINT) + (max(epoch(ts)::BIGINT) - min(epoch(ts)::BIGINT)) * 8e-1 FROM tx)
      THEN 'train' ELSE 'test' END AS split FROM tx""",
)
def split_temporal(spark, folder):
    return splitting.split_temporal(payments(spark, folder).select(*_KEYS))


@query(
    "split_summary",
    f"""{BASE} SELECT {_SPLIT} AS split, count(*) AS n, sum(is_laundering)::BIGINT AS positives,
    round(sum(is_laundering)::DOUBLE / count(*)::DOUBLE * 100e0, 3) AS positive_pct FROM tx GROUP BY 1""",
)
def split_summary(spark, folder):
    return splitting.split_summary(splitting.split_stratified(payments(spark, folder), columns=_TEXT_KEYS))


_UNDER = f"""SELECT * FROM tx WHERE is_laundering = 1 OR {_bucket_sql('sample-42', 1 << 32)} <
  (SELECT sum(is_laundering) * 10e0 / sum(1 - is_laundering) * 4294967296 FROM tx)"""


@query("undersample", f"{BASE} SELECT {_KEY_SQL} FROM ({_UNDER})")
def undersample(spark, folder):
    return splitting.undersample(payments(spark, folder), columns=_TEXT_KEYS).select(*_KEYS)


def _quota_sql(salt: str, quota: str, source: str = "tx") -> str:
    """Rows with ``place``, their position in the hash order of their class, and the class quota."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY is_laundering ORDER BY {_bucket_sql(salt, 1 << 32)}, {_KEY_SQL})
      <= {quota} AS taken FROM (SELECT *, count(*) OVER (PARTITION BY is_laundering) AS n,
        sum(is_laundering) OVER () AS positives FROM {source}))"""


_SHARE = "floor(n * 8e-1 + 5e-1)"


@query(
    "split_exact",
    f"""{BASE} SELECT {_KEY_SQL}, CASE WHEN taken THEN 'train' ELSE 'test' END AS split
    FROM {_quota_sql('split-42', _SHARE)}""",
)
def split_exact(spark, folder):
    return splitting.split_exact(payments(spark, folder).select(*_KEYS), columns=_TEXT_KEYS)


@query(
    "split_exact_summary",
    f"""{BASE}, s AS (SELECT *, CASE WHEN taken THEN 'train' ELSE 'test' END AS split FROM {_quota_sql('split-42', _SHARE)}),
    v AS (SELECT CASE WHEN taken THEN 'fit' ELSE 'validation' END AS split, is_laundering
      FROM {_quota_sql('validation-42', _SHARE, "(SELECT * EXCLUDE (taken, n, positives) FROM s WHERE split = 'train')")})
    SELECT split, count(*) AS n, sum(is_laundering)::BIGINT AS positives,
      round(sum(is_laundering)::DOUBLE / count(*)::DOUBLE * 100e0, 3) AS positive_pct
    FROM (SELECT split, is_laundering FROM s UNION ALL SELECT * FROM v) GROUP BY 1""",
)
def split_exact_summary(spark, folder):
    """Both cuts to the row: train and test, and the training rows once more."""
    parts = materialize(splitting.split_exact(payments(spark, folder).select(*_KEYS), columns=_TEXT_KEYS), "exact-split")
    train = parts.where("split = 'train'").drop("split")
    second = splitting.split_exact(
        train, salt=splitting.VALIDATION_SALT, columns=_TEXT_KEYS, names=("fit", "validation")
    )
    return splitting.split_summary(parts.unionByName(second))


@query("undersample_exact", f"{BASE} SELECT {_KEY_SQL} FROM {_quota_sql('sample-42', 'CASE WHEN is_laundering = 1 THEN n ELSE positives * 3 END')} WHERE taken")
def undersample_exact(spark, folder):
    return splitting.undersample_exact(payments(spark, folder).select(*_KEYS), 3.0, columns=_TEXT_KEYS)


@query(
    "class_weight",
    f"""{BASE} SELECT sum(is_laundering)::BIGINT AS positives, sum(1 - is_laundering)::BIGINT AS negatives,
    round(sum(1 - is_laundering)::DOUBLE / sum(is_laundering), 6) AS positive_weight FROM ({_UNDER})""",
)
def class_weight(spark, folder):
    return splitting.class_weight(splitting.undersample(payments(spark, folder), columns=_TEXT_KEYS))


@query(
    "split_validation",
    f"""{BASE} SELECT CASE WHEN {_bucket_sql('validation-42')} < 8000 THEN 'train' ELSE 'validation' END AS split,
    count(*) AS n, sum(is_laundering)::BIGINT AS positives,
    round(sum(is_laundering)::DOUBLE / count(*)::DOUBLE * 100e0, 3) AS positive_pct
    FROM (SELECT * FROM tx WHERE {_SPLIT} = 'train') GROUP BY 1""",
)
def split_validation(spark, folder):
    """A second, independent cut of the training rows."""
    parts = splitting.split_stratified(payments(spark, folder), columns=_TEXT_KEYS)
    train = parts.where("split = 'train'").drop("split")
    second = splitting.split_stratified(
        train, salt=splitting.VALIDATION_SALT, columns=_TEXT_KEYS, names=("train", "validation")
    )
    return splitting.split_summary(second)


@query(
    "fx_normalised",
    f"""{BASE} SELECT payment_currency, fx_rate,
      CASE WHEN amount_usd < 1000 THEN 'small' WHEN amount_usd < 10000 THEN 'moderate'
           WHEN amount_usd < 100000 THEN 'large' ELSE 'very large' END AS size,
      count(*) AS n, min(amount_usd) AS min_usd, max(amount_usd) AS max_usd
    FROM (SELECT payment_currency, {case_of('payment_currency', {n: r for n, (r, _) in fv.FX_TO_USD.items()}, 1.0)} AS fx_rate,
          amount_usd FROM usd) GROUP BY ALL""",
)
def fx_normalised(spark, folder):
    usd = to_usd(F.col("amount_paid"), F.col("payment_currency"))
    converted = payments(spark, folder).select(
        "payment_currency", fx_rate(F.col("payment_currency")).alias("fx_rate"), usd.alias("usd")
    )
    return converted.groupBy("payment_currency", "fx_rate", size_band(F.col("usd")).alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.min("usd").alias("min_usd"), F.max("usd").alias("max_usd")
    )


@query(
    "scratch_columns",
    f"""{BASE} SELECT from_account AS sender, to_account AS receiver, 1 AS is_payment,
    amount_paid * 2e0 AS double_amount FROM tx""",
)
def scratch_columns(spark, folder):
    """Rename, constant, expression and drop in one projection."""
    tx = payments(spark, folder).withColumns({"is_payment": F.lit(1), "scratch": F.lit(None).cast(T.StringType())})
    named = cleaning.rename(tx, {"from_account": "sender", "to_account": "receiver"})
    return cleaning.drop_scratch(named, ["scratch", "not_there"]).selectExpr(
        "sender", "receiver", "is_payment", "amount_paid * 2D AS double_amount"
    )
