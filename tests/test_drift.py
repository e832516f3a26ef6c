"""Monitoring rules on small logs."""

import pytest
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.operators import drift
from txrisk.sources.prediction_log import lookback, recent_rows

AS_OF = "2024-03-31 00:00:00"
SCHEMA = (
    "ts string, payment_format string, currency string, amount_usd double, from_bank string, to_bank string, "
    "payment_format_risk double, currency_risk_score double, is_cross_border int, is_near_threshold int, "
    "amount_log double, bank_risk_score double, is_in_cycle int, fan_out_degree double, tx_velocity_feat double, "
    "risk_score double, verdict string, processing_ms int"
)


@pytest.fixture(scope="module")
def make_log(spark):
    def build(n, ts="2024-03-30 12:00:00", score=0.312, ms=2800, fmt="ACH"):
        scores = score if callable(score) else (lambda i: score)
        rows = [
            (ts, fmt, "Euro", 10.0, "a", "b", 1.82, 2.94, i % 2, 0, 1.0, 0.089, 0, 2.21, 5.0, scores(i),
             "FLAGGED" if scores(i) >= 0.65 else "CLEARED", ms if i % 2 else 0)
            for i in range(n)
        ]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return build


def status_of(log):
    return drift.drift_status(drift.drift_metrics(log, AS_OF, [7]), ["period_days"]).first()


@pytest.mark.parametrize("n,ready", [(19, False), (20, True)])
def test_twenty_rows_are_needed(make_log, n, ready):
    row = status_of(make_log(n))
    assert (row.status != "INSUFFICIENT_DATA") is ready
    assert (row.n_alerts > 0) is ready


def test_nearest_rank_position(make_log):
    log = make_log(100, score=lambda i: i / 100)
    assert drift.drift_metrics(log, AS_OF, [7]).first().score_p95 == 0.95
    assert drift.live_stats(log, AS_OF, 7).first().score_p99 == 0.99


def test_zero_latency_is_no_measurement(make_log):
    assert drift.drift_metrics(make_log(40, ms=700), AS_OF, [7]).first().avg_processing_ms == 700.0
    assert drift.drift_metrics(make_log(40, ms=0), AS_OF, [7]).first().avg_processing_ms is None


def metric_row(spark, **values):
    wide = {**{m: b for m, b in fv.DRIFT_BASELINES.items()}, **values}
    row = [(7, 100, *[float(wide[m]) for m in drift.METRICS])]
    schema = "period_days int, n_transactions long, " + ", ".join(f"{m} double" for m in drift.METRICS)
    return spark.createDataFrame(row, schema)


def baselines(spark, metric, value):
    return drift.baseline_table(spark, {**fv.DRIFT_BASELINES, metric: value})


@pytest.mark.parametrize(
    "current,severity",
    [(1.25, None), (1.26, "MEDIUM"), (1.375, "HIGH"), (1.5, "CRITICAL"), (0.5, "CRITICAL"), (0.75, None)],
)
def test_alert_limits_and_severity(spark, current, severity):
    """Baseline 1, threshold 0.25: alerts start above it, 1.5 and 2 times it are
    the severity steps."""
    metrics = metric_row(spark, pct_wire=current)
    found = drift.drift_alerts(metrics, ["period_days"], baselines(spark, "pct_wire", 1.0)).collect()
    mine = [a.severity for a in found if a.metric == "pct_wire"]
    assert mine == ([severity] if severity else [])


def test_zero_baseline_and_missing_metric_are_skipped(spark):
    metrics = metric_row(spark, pct_wire=0.9).withColumn("pct_cash", F.lit(None).cast("double"))
    found = drift.drift_alerts(metrics, ["period_days"], baselines(spark, "pct_wire", 0.0)).collect()
    assert found == []


@pytest.mark.parametrize(
    "values,status",
    [
        ({}, "STABLE"),
        ({"pct_wire": 0.22 * 1.26}, "MINOR_DRIFT"),
        ({"pct_wire": 0.22 * 1.4, "pct_cash": 0.18 * 1.4}, "DRIFT_DETECTED"),
        ({"pct_wire": 0.22 * 1.4, "flag_rate": 0.5}, "CRITICAL_DRIFT"),
    ],
)
def test_status_is_the_worst_alert(spark, values, status):
    row = drift.drift_status(metric_row(spark, **values), ["period_days"]).first()
    assert row.status == status
    if status == "DRIFT_DETECTED":
        assert "detected in: pct_wire, pct_cash. Schedule" in row.recommendation


def test_alert_wording(spark):
    alerts = drift.drift_alerts(metric_row(spark, pct_in_cycle=0.1, pct_wire=0.01), ["period_days"])
    ordered = drift.order_alerts(alerts).collect()
    assert [a.metric for a in ordered] == ["pct_wire", "pct_in_cycle"]
    assert ordered[0].direction == fv.DIRECTION_DOWN and ordered[0].action == fv.DRIFT_ACTION_DEFAULT
    assert ordered[1].action == fv.DRIFT_ACTIONS["pct_in_cycle"][0]
    assert ordered[1].change_pct == 2400.0


def test_lookback_bounds(make_log):
    edge = make_log(1, ts="2024-03-24 00:00:00").unionByName(make_log(1, ts="2024-03-23 23:59:59"))
    both = edge.unionByName(make_log(1, ts=AS_OF))
    assert lookback(both, AS_OF, 7).count() == 1


def test_lookbacks_nest(make_log):
    log = make_log(20, ts="2024-03-30 01:00:00").unionByName(make_log(5, ts="2024-03-20 00:00:00"))
    n = {r.period_days: r.n_transactions for r in drift.drift_metrics(log, AS_OF).collect()}
    assert n == {1: 20, 7: 20, 14: 25, 30: 25}


def test_histogram_has_all_buckets(make_log):
    rows = drift.score_histogram(make_log(4, score=lambda i: [0.0, 0.55, 0.99, 1.0][i]), AS_OF).collect()
    assert {r.bucket: r.n for r in rows if r.n} == {"0-10%": 1, "50-60%": 1, "90-100%": 2}
    assert len(rows) == 10 and sum(r.n for r in rows) == 4


def test_health_and_recent(make_log):
    log = make_log(25).unionByName(make_log(3, ts="2024-01-01 00:00:00"))
    health = drift.monitor_health(log, AS_OF).first()
    assert tuple(health) == (28, 25, 25, 1)
    recent = drift.recent_predictions(log, AS_OF).collect()
    assert len(recent) == 10 and recent[0].total == 25
    assert recent_rows(log, AS_OF, 7).columns[:2] == ["risk_score", "verdict"]


def test_equal_scores_do_not_shift(make_log):
    log = make_log(50, score=lambda i: i / 50)

    def both(other):
        rows = log.withColumn("now", F.lit(False)).unionByName(other.withColumn("now", F.lit(True)))
        return drift.score_shift(rows, F.col("now")).first()

    same = both(log)
    assert (same.ks, same.psi) == (0.0, 0.0)
    moved = both(make_log(50, score=lambda i: i / 500))
    assert moved.ks > 0.8 and moved.psi > 1
