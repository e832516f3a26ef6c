"""Named queries: history that grows, frequent keys, payments in buckets."""

import math

from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.operators import history
from txrisk.operators.history_store import HistoryStore
from txrisk.plans.catalog import query
from txrisk.plans.feature_table import transform, transform_stored
from txrisk.plans.oracle import BASE
from txrisk.session import new_path
from txrisk.sources.payment_store import PaymentStore
from txrisk.sources.warehouse import stored_payments

_CARRY_SQL = (
    "from_account, to_account, from_bank, to_bank, amount_paid, ts, is_laundering, payment_format, payment_currency"
)


_BUCKET_ROWS = 1_000_000


def stretch_of(tx, n):
    """The payments with the number of their stretch of days, of n equal ones."""
    first, last = tx.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    days = (last - first).days + 1 if first else 1
    return tx.withColumn("stretch", F.floor(F.datediff(F.to_date("ts"), F.lit(first)) * n / days).cast("int"))


STRETCH_SQL = """((ts::DATE - (SELECT min(ts)::DATE FROM tx)) * {n}
  // ((SELECT max(ts)::DATE FROM tx) - (SELECT min(ts)::DATE FROM tx) + 1))"""


def buckets_for(tx, least=8):
    """Buckets that hold about a million payments each, so that a task's rows do not grow with the table."""
    return max(least, math.ceil(tx.count() / _BUCKET_ROWS))


def _in_parts(tx, n):
    """The payments in n stretches of time, stored so that each can be read by itself."""
    spark = tx.sparkSession
    path = new_path(spark, "daily-payments")
    stretch_of(tx, n).write.partitionBy("stretch").parquet(path)
    stored = spark.read.parquet(path)
    return [(f"stretch {k}", stored.where(F.col("stretch") == k).drop("stretch")) for k in range(n)]


def _grown(tx, n):
    store = HistoryStore(tx.sparkSession, new_path(tx.sparkSession, "history"), buckets_for(tx))
    for name, part in _in_parts(tx, n):
        store.add(name, part)
    return store


@query(
    "history_in_parts",
    f"""{BASE} SELECT coalesce(s.from_account, r.to_account) AS account, fan_out_degree, tx_velocity, total_sent,
    avg_sent, amount_per_tx, fan_in_degree, total_received, avg_received
    FROM sender s FULL JOIN receiver r ON s.from_account = r.to_account""",
)
def history_in_parts(spark, folder):
    """Account history after ten batches, each read once."""
    known = _grown(stored_payments(spark, folder), 10).history(("sender", "receiver"))
    sent = known.sender.withColumnRenamed("from_account", "account")
    received = known.receiver.withColumnRenamed("to_account", "account").drop("n_received")
    return sent.join(received, "account", "full")


@query(
    "features_grown_history",
    f"{BASE} SELECT {', '.join(fv.FEATURES)}, {_CARRY_SQL} FROM feat",
)
def features_grown_history(spark, folder):
    """The feature table with stored history: three batches, one of them sent twice, then compacted."""
    tx = stored_payments(spark, folder)
    store = _grown(tx, 3)
    store.add("stretch 1", tx)
    store.compact()
    return transform(tx, store.history())


@query(
    "features_bucketed",
    f"{BASE} SELECT {', '.join(fv.FEATURES)}, {_CARRY_SQL} FROM feat",
)
def features_bucketed(spark, folder):
    """The feature table of payments that stay in their buckets."""
    tx = stored_payments(spark, folder)
    store = PaymentStore(spark, new_path(spark, "payments"), buckets_for(tx))
    store.add("all", tx)
    return transform_stored(store, history.fit_history(store.payments()))


_HOT = "CASE WHEN (to_account + hour(ts)) % 10 < 3 THEN -7 WHEN to_account % 17 = 0 THEN NULL ELSE from_account END"


@query(
    "features_hot_account",
    f"""{BASE}, h AS (SELECT * REPLACE ({_HOT} AS from_account) FROM rowf),
    s AS (SELECT from_account, count(DISTINCT to_account) AS fo, count(*) AS v FROM h GROUP BY 1),
    t AS (SELECT to_account, count(DISTINCT from_account) AS fi FROM h GROUP BY 1),
    e AS (SELECT DISTINCT from_account, to_account FROM h),
    c AS (SELECT x.from_account, x.to_account FROM e x
          JOIN e y ON x.from_account = y.to_account AND x.to_account = y.from_account)
    SELECT h.from_account, h.to_account, h.ts, h.amount_paid, h.payment_format, coalesce(s.fo, 0) AS fan_out_degree,
      coalesce(s.v, 1) AS tx_velocity, coalesce(t.fi, 0) AS fan_in_degree,
      CASE WHEN c.from_account IS NULL THEN 0 ELSE 1 END AS is_in_cycle
    FROM h LEFT JOIN s ON h.from_account = s.from_account LEFT JOIN t ON h.to_account = t.to_account
    LEFT JOIN c ON c.from_account = h.from_account AND c.to_account = h.to_account""",
)
def features_hot_account(spark, folder):
    """History joined to payments of which one account sends about 30 % and many have no sender."""
    tx = with_hot_account(stored_payments(spark, folder))
    parts = ("sender", "receiver", "cycle")
    table = transform(tx, history.fit_history(tx, parts), hot=history.hot_keys_of(tx, parts))
    return table.select(
        "from_account",
        "to_account",
        "ts",
        "amount_paid",
        "payment_format",
        "fan_out_degree",
        "tx_velocity",
        "fan_in_degree",
        "is_in_cycle",
    )


def with_hot_account(tx):
    hot = (F.col("to_account") + F.hour("ts")) % 10 < 3
    missing = F.when(F.col("to_account") % 17 == 0, F.lit(None)).otherwise(F.col("from_account"))
    return tx.withColumn("from_account", F.when(hot, F.lit(-7)).otherwise(missing))
