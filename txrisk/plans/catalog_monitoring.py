"""Named queries: prediction log and drift."""

from pyspark.sql import functions as F

from txrisk import schemas
from txrisk.operators import drift
from txrisk.plans.catalog import query
from txrisk.plans.oracle import AS_OF, BASE, DRIFT, half_up, mean4
from txrisk.plans.scoring import prediction_log
from txrisk.session import materialize, new_path
from txrisk.sources.log_store import LogStore
from txrisk.sources.prediction_log import append_predictions, as_of_literal, read_log, recent_rows
from txrisk.sources.warehouse import payments, stored_payments

_METRICS = ", ".join(drift.METRICS)
_WEEK = "period_days = 7"


def _log(spark, folder):
    return prediction_log(payments(spark, folder, with_latency=True))


@query("log_lookback", f"{BASE} SELECT {', '.join(schemas.LOOKBACK_COLUMNS)} FROM recent WHERE {_WEEK}")
def log_lookback(spark, folder):
    return recent_rows(_log(spark, folder), AS_OF, 7)


@query("stored_log", f"{BASE} SELECT {', '.join(schemas.LOOKBACK_COLUMNS)} FROM recent WHERE period_days = 30")
def stored_log(spark, folder):
    """The whole log appended to day partitions; the lookback lists and reads its own days only."""
    path = new_path(spark, "stored-log")
    append_predictions(_log(spark, folder), path, strict=True)
    return recent_rows(read_log(spark, path), AS_OF, 30)


@query("drift_metrics", f"{BASE} SELECT period_days, n_transactions, {_METRICS} FROM metrics WHERE {_WEEK}")
def drift_metrics(spark, folder):
    return drift.drift_metrics(_log(spark, folder), AS_OF, [7])


@query("drift_by_lookback", f"{BASE} SELECT period_days, n_transactions, {_METRICS} FROM metrics")
def drift_by_lookback(spark, folder):
    return drift.drift_metrics(_log(spark, folder), AS_OF)


@query("drift_alerts", f"{DRIFT} SELECT * FROM alerts")
def drift_alerts(spark, folder):
    metrics = drift.drift_metrics(_log(spark, folder), AS_OF)
    return drift.order_alerts(drift.drift_alerts(metrics, ["period_days"]))


STATUS_SQL = """n_transactions, n_alerts, status, CASE status
      WHEN 'STABLE' THEN 'Model is performing within expected parameters. Continue standard monitoring.'
      WHEN 'MINOR_DRIFT' THEN 'Minor distributional shifts detected. No immediate action required. Review in 7 days.'
      WHEN 'DRIFT_DETECTED' THEN 'Significant drift detected in: ' || high_metrics || '. Schedule model retraining within 30 days. Increase manual review rate for flagged transactions in the interim.'
      WHEN 'CRITICAL_DRIFT' THEN 'CRITICAL: Model may no longer be reliable. Immediately increase manual review to 100% of flagged transactions. Initiate emergency retraining procedure. Notify compliance team.'
      END AS recommendation"""


@query("drift_status", f"{DRIFT} SELECT period_days, {STATUS_SQL} FROM status")
def drift_status(spark, folder):
    return drift.drift_status(drift.drift_metrics(_log(spark, folder), AS_OF), ["period_days"])


@query(
    "metric_table",
    f"""{DRIFT} SELECT period_days, metric, baseline, current, round(change * 100e0, 1) AS change_pct,
    CASE WHEN abs(change * 100e0) > 50 THEN 'danger' WHEN abs(change * 100e0) > 25 THEN 'warn' ELSE 'normal' END AS band
    FROM compared""",
)
def metric_table(spark, folder):
    return drift.metric_table(drift.drift_metrics(_log(spark, folder), AS_OF), ["period_days"])


@query(
    "score_histogram",
    f"""{BASE}, h AS (SELECT least(floor(risk_score * 10e0), 9)::INTEGER AS b, count(*) AS n FROM recent
      WHERE period_days = 30 GROUP BY 1)
    SELECT (i * 10)::VARCHAR || '-' || ((i + 1) * 10)::VARCHAR || '%' AS bucket, coalesce(n, 0)::BIGINT AS n,
    round(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM h)::DOUBLE * 100e0, 1) AS pct
    FROM range(10) t(i) LEFT JOIN h ON b = i""",
)
def score_histogram(spark, folder):
    return drift.score_histogram(_log(spark, folder), AS_OF, 30)


@query(
    "live_stats",
    f"""{BASE} SELECT period_days, count(*) AS n_transactions,
    count(*) FILTER (verdict = 'FLAGGED')::DOUBLE / count(*) AS flag_rate, {mean4('risk_score')} AS avg_score,
    any_value(score_p95) AS score_p95, any_value(score_p99) AS score_p99
    FROM recent JOIN pct USING (period_days) WHERE {_WEEK} GROUP BY period_days""",
)
def live_stats(spark, folder):
    return drift.live_stats(_log(spark, folder), AS_OF, 7)


@query(
    "format_mix",
    f"""{BASE}, m AS (SELECT payment_format, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM recent WHERE {_WEEK})::DOUBLE * 100e0 AS p,
      CASE payment_format WHEN 'ACH' THEN 18e0 WHEN 'Wire' THEN 22e0 WHEN 'Bitcoin' THEN 35e-1 WHEN 'Cash' THEN 18e0
        WHEN 'Credit Card' THEN 20e0 WHEN 'Reinvestment' THEN 10e0 WHEN 'Cheque' THEN 85e-1 ELSE 10e0 END AS b
      FROM recent WHERE {_WEEK} GROUP BY payment_format)
    SELECT payment_format, n, round(p, 4) AS pct, b AS baseline_pct,
    CASE WHEN abs(p - b) / b > 25e-2 THEN 1 ELSE 0 END AS drifted FROM m""",
)
def format_mix(spark, folder):
    return drift.format_mix(_log(spark, folder), AS_OF, 7)


@query(
    "monitor_health",
    f"""{BASE} SELECT count(*) AS total_logged,
    count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_7_days,
    count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS last_24_hours,
    CASE WHEN count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) >= 20 THEN 1 ELSE 0 END AS drift_ready
    FROM log WHERE ts < TIMESTAMP '{AS_OF}'""",
)
def monitor_health(spark, folder):
    return drift.monitor_health(_log(spark, folder), AS_OF)


_SHOWN = "payment_format, currency, amount_usd, verdict, risk_score, from_bank, to_bank"


@query(
    "recent_predictions",
    f"""{BASE} SELECT ts, {_SHOWN}, (SELECT count(*) FROM recent WHERE period_days = 1) AS total
    FROM recent WHERE period_days = 1 ORDER BY ts DESC, {_SHOWN} LIMIT 10""",
)
def recent_predictions(spark, folder):
    return drift.recent_predictions(_log(spark, folder), AS_OF)


@query(
    "score_shift",
    f"""{BASE}, r AS (SELECT risk_score AS s, count(*) FILTER (ts < TIMESTAMP '{AS_OF}') AS ref,
        count(*) FILTER (ts >= TIMESTAMP '{AS_OF}') AS cur FROM log GROUP BY 1),
      g AS (SELECT abs(sum(ref) OVER (ORDER BY s) / (SELECT sum(ref) FROM r)::DOUBLE
                     - sum(cur) OVER (ORDER BY s) / (SELECT sum(cur) FROM r)::DOUBLE) AS gap FROM r),
      d AS (SELECT least(floor(s * 10e0), 9) AS d, greatest(sum(ref) / (SELECT sum(ref) FROM r)::DOUBLE, 1e-4) AS p,
                   greatest(sum(cur) / (SELECT sum(cur) FROM r)::DOUBLE, 1e-4) AS q FROM r GROUP BY 1)
    SELECT (SELECT round(max(gap), 6) FROM g) AS ks, (SELECT round(sum((q - p) * ln(q / p)), 6) FROM d) AS psi""",
)
def score_shift(spark, folder):
    return drift.score_shift(_log(spark, folder), F.col("ts") >= as_of_literal(AS_OF))


@query(
    "rolling_trend",
    f"""{BASE}, day AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (verdict = 'FLAGGED') AS f,
      sum(risk_score) AS s FROM log GROUP BY 1)
    SELECT day, (sum(n) OVER w)::BIGINT AS n, round(sum(f) OVER w / (sum(n) OVER w)::DOUBLE, 6) AS flag_rate,
    {half_up('round(sum(s) OVER w, 6) / (sum(n) OVER w)::DOUBLE', 4)} AS avg_score FROM day
    WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)""",
)
def rolling_trend(spark, folder):
    return drift.rolling_trend(_log(spark, folder), 90)


# --- from the kept summary ---------------------------------------------------


def _kept(spark, folder):
    """The log in three batches, the second sent twice; nothing below reads its rows again."""
    log = materialize(prediction_log(stored_payments(spark, folder, with_latency=True)), "log")
    store = LogStore(spark, new_path(spark, "log-store"))
    batches = [("early", "ts < TIMESTAMP_NTZ '1996-01-01'"), ("middle", "ts < TIMESTAMP_NTZ '2001-07-20'"), ("late", None)]
    done = F.lit(False)
    for name, until in batches:
        mine = ~done if until is None else F.expr(until) & ~done
        done = done if until is None else F.expr(until)
        store.append(name, log.where(mine))
    store.append("middle", log)
    return store


@query("kept_drift_metrics", f"{BASE} SELECT period_days, n_transactions, {_METRICS} FROM metrics")
def kept_drift_metrics(spark, folder):
    return _kept(spark, folder).drift_metrics(AS_OF)


@query("kept_drift_alerts", f"{DRIFT} SELECT * FROM alerts")
def kept_drift_alerts(spark, folder):
    return drift.order_alerts(drift.drift_alerts(_kept(spark, folder).drift_metrics(AS_OF), ["period_days"]))


@query("kept_drift_status", f"{DRIFT} SELECT period_days, {STATUS_SQL} FROM status")
def kept_drift_status(spark, folder):
    return drift.drift_status(_kept(spark, folder).drift_metrics(AS_OF), ["period_days"])


_MOMENT = "2001-08-01 09:30:00"


@query(
    "kept_drift_at_a_moment",
    f"{BASE} SELECT period_days, n_transactions, {_METRICS} FROM metrics".replace(AS_OF, _MOMENT),
)
def kept_drift_at_a_moment(spark, folder):
    """Lookbacks that cut days in two: these days from rows, all others from the summary."""
    return _kept(spark, folder).drift_metrics(_MOMENT)


@query(
    "kept_score_histogram",
    f"""{BASE}, h AS (SELECT least(floor(risk_score * 10e0), 9)::INTEGER AS b, count(*) AS n FROM recent
      WHERE period_days = 30 GROUP BY 1)
    SELECT (i * 10)::VARCHAR || '-' || ((i + 1) * 10)::VARCHAR || '%' AS bucket, coalesce(n, 0)::BIGINT AS n,
    round(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM h)::DOUBLE * 100e0, 1) AS pct
    FROM range(10) t(i) LEFT JOIN h ON b = i""",
)
def kept_score_histogram(spark, folder):
    return _kept(spark, folder).score_histogram(AS_OF, 30)


@query("kept_log_lookback", f"{BASE} SELECT {', '.join(schemas.LOOKBACK_COLUMNS)} FROM recent WHERE period_days = 30")
def kept_log_lookback(spark, folder):
    return _kept(spark, folder).recent(AS_OF, 30).select(*schemas.LOOKBACK_COLUMNS)


@query(
    "kept_trend",
    f"""{BASE}, day AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (verdict = 'FLAGGED') AS f,
      sum(risk_score) AS s FROM log GROUP BY 1)
    SELECT day, (sum(n) OVER w)::BIGINT AS n, round(sum(f) OVER w / (sum(n) OVER w)::DOUBLE, 6) AS flag_rate,
    {half_up('round(sum(s) OVER w, 6) / (sum(n) OVER w)::DOUBLE', 4)} AS avg_score FROM day
    WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)""",
)
def kept_trend(spark, folder):
    return _kept(spark, folder).trend(90)
