"""Named queries that run a stream over the tables to its end."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators import drift, sessions
from txrisk.operators.history import fit_history
from txrisk.operators.history_store import HistoryStore
from txrisk.plans import training
from txrisk.plans.catalog import query
from txrisk.plans.catalog_history import STRETCH_SQL, buckets_for, stretch_of
from txrisk.plans.catalog_monitoring import STATUS_SQL
from txrisk.plans.feature_table import transform
from txrisk.plans.oracle import BASE, drift_ctes, mean4
from txrisk.session import materialize, new_path
from txrisk.sources.warehouse import payment_stream, payments, stored_payments
from txrisk.streaming import monitoring
from txrisk.streaming.growing import score_and_grow
from txrisk.streaming.scoring import log_stream, score_ensemble_stream, score_stream, start_file_sink, start_update_sink

_METRICS = ", ".join(drift.METRICS)


def _run(stream, spark, label):
    """Run a stream over what is there now and return the table it wrote."""
    sink = new_path(spark, label)
    running = start_file_sink(stream, sink, new_path(spark, f"{label}-checkpoint"))
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def _windows(stream, spark, label, keys):
    """Run a windowed stream over what is there now; all windows, with ``is_open``."""
    sink = new_path(spark, label)
    running = start_update_sink(stream, sink, new_path(spark, f"{label}-checkpoint"))
    running.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    updates = spark.read.schema(schema).parquet(sink)
    return monitoring.latest_windows(updates, ["window_start", "window_end", *keys])


def _stream_session(spark):
    """A session whose stateful operators have one partition per core, since
    adaptive execution does not resize them."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return session


def _scored_stream(spark, folder, parts):
    known = fit_history(payments(spark, folder), parts)
    session = _stream_session(spark)
    return score_stream(payment_stream(session, folder, with_latency=True), known, extra=("processing_ms",))


_SCORES = "ts, from_account, to_account, amount_paid, payment_format, is_laundering, risk_score, verdict"


@query("stream_scores", f"{BASE} SELECT {_SCORES} FROM scored")
def stream_scores(spark, folder):
    scored = _scored_stream(spark, folder, ("sender",))
    return _run(scored.select(*_SCORES.split(", ")), spark, "stream-scores")


# A window is open until the latest row is more than the allowed delay past its end.
_OPEN = "CASE WHEN window_end > (SELECT max(ts) FROM log) - INTERVAL 1 DAY THEN 1 ELSE 0 END AS is_open"


@query(
    "stream_daily_mix",
    f"""{BASE}, m AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start,
      date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, payment_format, count(*) AS n,
      count(*) FILTER (verdict = 'FLAGGED') AS flagged FROM log GROUP BY 1, 2, 3)
    SELECT *, round(flagged::DOUBLE / n, 6) AS flag_rate, {_OPEN} FROM m""",
)
def stream_daily_mix(spark, folder):
    parts = ("sender", "bank", "cycle")
    mix = monitoring.daily_mix(log_stream(_scored_stream(spark, folder, parts)))
    return _windows(mix, spark, "stream-mix", ["payment_format"])


_WINDOWS = f"""w AS (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(k) AS window_start, log.* FROM log, range(7) t(k)),
    p AS (SELECT window_start, risk_score, row_number() OVER (PARTITION BY window_start ORDER BY risk_score) - 1 AS pos,
      count(*) OVER (PARTITION BY window_start) AS n FROM w),
    q AS (SELECT window_start, min(CASE WHEN pos = floor(n * 95e-2) THEN risk_score END) AS score_p95 FROM p GROUP BY 1),
    m AS (SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS n_transactions,
      count(*) FILTER (verdict = 'FLAGGED')::DOUBLE / count(*) AS flag_rate, {mean4('risk_score')} AS avg_risk_score,
      any_value(score_p95) AS score_p95,
      count(*) FILTER (payment_format = 'ACH')::DOUBLE / count(*) AS pct_ach,
      count(*) FILTER (payment_format = 'Wire')::DOUBLE / count(*) AS pct_wire,
      count(*) FILTER (payment_format = 'Bitcoin')::DOUBLE / count(*) AS pct_bitcoin,
      count(*) FILTER (payment_format = 'Cash')::DOUBLE / count(*) AS pct_cash,
      {mean4('payment_format_risk')} AS avg_payment_format_risk, {mean4('currency_risk_score')} AS avg_currency_risk,
      {mean4('is_cross_border')} AS pct_cross_border, {mean4('is_near_threshold')} AS pct_near_threshold,
      {mean4('is_in_cycle')} AS pct_in_cycle, {mean4('fan_out_degree')} AS avg_fan_out,
      {mean4('bank_risk_score')} AS avg_bank_risk,
      round((round(sum(CASE WHEN processing_ms > 0 THEN processing_ms END), 6)
        / count(CASE WHEN processing_ms > 0 THEN 1 END))::VARCHAR::DECIMAL(38,18), 1)::DOUBLE AS avg_processing_ms
      FROM w JOIN q USING (window_start) GROUP BY window_start),
    windows AS (SELECT window_start, window_end, {_OPEN}, n_transactions, {_METRICS} FROM m)"""


def _window_metrics(spark, folder):
    log = log_stream(_scored_stream(spark, folder, ("sender", "bank", "cycle")))
    return monitoring.window_metrics(_windows(monitoring.window_summary(log), spark, "stream-summary", ["risk_score"]))


@query("stream_drift", f"{BASE}, {_WINDOWS} SELECT * FROM windows")
def stream_drift(spark, folder):
    return _window_metrics(spark, folder)


_KEYS = ["window_start", "window_end", "is_open"]


@query(
    "stream_drift_status",
    f"{BASE}, {_WINDOWS}, {drift_ctes('windows', ', '.join(_KEYS))} SELECT {', '.join(_KEYS)}, {STATUS_SQL} FROM status",
)
def stream_drift_status(spark, folder):
    """Alerts of every window, drawn together to its status and advice."""
    metrics = materialize(_window_metrics(spark, folder), "window-metrics")
    return drift.drift_status(metrics, _KEYS)


# --- state that grows with the stream ----------------------------------------
_STRETCHES = 4
#: Payments in a file of the stream.
_FILE_ROWS = 2_000_000


def _arriving(tx, n=_STRETCHES):
    """The payments as a stream of files in the order of time, a stretch of n per micro-batch.

    Every stretch has the same number of files, so that a trigger takes one whole stretch.
    """
    spark = tx.sparkSession
    path = new_path(spark, "arriving")
    cut = materialize(stretch_of(tx, n), "stretches")
    rows = cut.drop("stretch")
    most = cut.groupBy("stretch").count().agg(F.max("count")).first()[0] or 0
    files = max(1, math.ceil(most / _FILE_ROWS))
    for k in range(n):
        mine = cut.where(f"stretch = {k}").drop("stretch")
        (mine.coalesce(1) if files == 1 else mine.repartition(files)).write.mode("append").parquet(path)
        # a task without rows writes no file; empty ones stand in
        for _ in range(files * (k + 1) - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return _stream_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


_GROWN = ["fan_out_degree", "fan_in_degree", "tx_velocity", "is_in_cycle", "bank_risk_score"]


@query(
    "stream_growing_history",
    f"""{BASE}, st AS (SELECT *, {STRETCH_SQL.format(n=_STRETCHES)} AS k FROM tx),
    ks AS (SELECT DISTINCT k FROM st),
    s AS (SELECT ks.k, from_account, count(DISTINCT to_account) AS fo, count(*) AS v FROM ks JOIN st ON st.k < ks.k GROUP BY 1, 2),
    r AS (SELECT ks.k, to_account, count(DISTINCT from_account) AS fi FROM ks JOIN st ON st.k < ks.k GROUP BY 1, 2),
    b AS (SELECT ks.k, from_bank, round(sum(is_laundering)::DOUBLE / count(*) * 100e0, 6) AS risk
      FROM ks JOIN st ON st.k < ks.k GROUP BY 1, 2),
    e AS (SELECT DISTINCT ks.k, from_account, to_account FROM ks JOIN st ON st.k < ks.k),
    c AS (SELECT x.k, x.from_account, x.to_account FROM e x JOIN e y
      ON x.k = y.k AND x.from_account = y.to_account AND x.to_account = y.from_account)
    SELECT st.ts, st.from_account, st.to_account, st.amount_paid, st.payment_format, coalesce(fo, 0) AS fan_out_degree,
      coalesce(fi, 0) AS fan_in_degree, coalesce(v, 1) AS tx_velocity,
      CASE WHEN c.from_account IS NULL THEN 0 ELSE 1 END AS is_in_cycle, coalesce(risk, 0e0) AS bank_risk_score
    FROM st LEFT JOIN s ON s.k = st.k AND s.from_account = st.from_account
    LEFT JOIN r ON r.k = st.k AND r.to_account = st.to_account
    LEFT JOIN b ON b.k = st.k AND b.from_bank = st.from_bank
    LEFT JOIN c ON c.k = st.k AND c.from_account = st.from_account AND c.to_account = st.to_account""",
)
def stream_growing_history(spark, folder):
    """Each micro-batch sees the history of the earlier ones, and adds its own."""
    tx = stored_payments(spark, folder)
    store = HistoryStore(spark, new_path(spark, "history"), buckets_for(tx))
    sink = new_path(spark, "grown-scores")
    score_and_grow(_arriving(tx), store, sink, new_path(spark, "grown-checkpoint")).awaitTermination()
    scored = spark.read.parquet(sink)
    return scored.select("ts", "from_account", "to_account", "amount_paid", "payment_format", *_GROWN)


_SESSIONS = f"""{BASE}, p AS (SELECT *, lag(ts) OVER (PARTITION BY from_account ORDER BY ts) AS before FROM tx),
    q AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 DAY THEN 1 ELSE 0 END)
      OVER (PARTITION BY from_account ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM p)
    SELECT from_account, min(ts) AS session_start, max(ts) + INTERVAL 30 DAY AS session_end, count(*) AS n_tx,
      sum(is_laundering)::BIGINT AS n_laundering, sum(amount_paid::DECIMAL(18,4))::DOUBLE AS amount,
      CASE WHEN max(ts) + INTERVAL 30 DAY >= (SELECT max(ts) FROM tx) THEN 1 ELSE 0 END AS is_open
    FROM q GROUP BY from_account, session"""


@query("account_sessions", _SESSIONS)
def account_sessions(spark, folder):
    return sessions.account_sessions(payments(spark, folder))


@query("stream_sessions", _SESSIONS)
def stream_sessions(spark, folder):
    """Pieces of sessions stored by each micro-batch, put together over all of them."""
    sink = new_path(spark, "session-pieces")
    tx = stored_payments(spark, folder)
    schema = sessions.session_pieces(tx).schema

    def store(rows, batch):
        sessions.session_pieces(rows).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    stream = _arriving(tx).writeStream.foreachBatch(store).trigger(availableNow=True)
    stream.option("checkpointLocation", new_path(spark, "pieces-checkpoint")).start().awaitTermination()
    return sessions.sessions_of_pieces(spark.read.schema(schema).parquet(sink))


@query(
    "stream_ensemble",
    f"""{BASE} SELECT payment_format, count(*) AS n, sum(is_laundering)::BIGINT AS positives,
    count(*) AS n_judged, 0 AS n_unlike_batch FROM tx GROUP BY 1""",
)
def stream_ensemble(spark, folder):
    """The ensemble on a stream of all payments, beside the same rows scored as a batch."""
    rows = stored_payments(spark, folder)
    settings = training.Settings(boosted_depth=3, boosted_rounds=5, forest_trees=5, forest_depth=4)
    model, known = training.train_ensemble(training.prepare(rows, settings), settings), fit_history(rows)
    keys = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "is_laundering"]
    stream = score_ensemble_stream(payment_stream(_stream_session(spark), folder), known, model)
    scored = _run(stream.select(*keys, "risk_score", "verdict"), spark, "stream-ensemble")
    batch = training.score_ensemble(transform(rows, known), model).select(*keys, "risk_score", "verdict")

    def counted(df):
        judged = F.count(F.when(F.col("verdict").isin("FLAGGED", "CLEARED"), 1))
        total = F.sum(F.col("risk_score").cast("decimal(20,4)"))
        flagged = F.sum(F.when(F.col("verdict") == "FLAGGED", 1).otherwise(0))
        return df.groupBy("payment_format").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("is_laundering").cast("long")).alias("positives"), judged.alias("n_judged"), F.struct(total, flagged).alias("sums")
        )

    other = counted(batch).select("payment_format", F.col("sums").alias("batch_sums"))
    both = counted(scored).join(other, "payment_format", "full")
    unlike = F.when(F.col("sums") == F.col("batch_sums"), 0).otherwise(1)
    return both.select("payment_format", "n", "positives", "n_judged", unlike.alias("n_unlike_batch"))
