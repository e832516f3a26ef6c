"""Monitoring of the prediction log.

The log is read once and reduced to a summary per time slice and score; since
scores have four decimals that summary is small. Every metric, percentile and
lookback is computed from it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import fixed_values as fv
from txrisk.functions.scalars import (
    count_if,
    decile,
    decile_label,
    guarded_div,
    lookup,
    mean_of_sum,
)
from txrisk.session import materialize
from txrisk.sources.prediction_log import days_before, lookback

METRICS = list(fv.DRIFT_BASELINES)
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2}

SUMMED = {
    "flagged": lambda: F.when(F.col("verdict") == "FLAGGED", 1).otherwise(0),
    "ach": lambda: F.when(F.col("payment_format") == "ACH", 1).otherwise(0),
    "wire": lambda: F.when(F.col("payment_format") == "Wire", 1).otherwise(0),
    "bitcoin": lambda: F.when(F.col("payment_format") == "Bitcoin", 1).otherwise(0),
    "cash": lambda: F.when(F.col("payment_format") == "Cash", 1).otherwise(0),
    "format_risk": lambda: F.col("payment_format_risk"),
    "currency_risk": lambda: F.col("currency_risk_score"),
    "cross_border": lambda: F.col("is_cross_border"),
    "near_threshold": lambda: F.col("is_near_threshold"),
    "in_cycle": lambda: F.col("is_in_cycle"),
    "fan_out": lambda: F.col("fan_out_degree"),
    "bank_risk": lambda: F.col("bank_risk_score"),
    # A latency of zero, or none, is not a measurement.
    "ms": lambda: F.when(F.col("processing_ms") > 0, F.col("processing_ms")),
    "timed": lambda: F.when(F.col("processing_ms") > 0, 1).otherwise(0),
}


def _score() -> Column:
    """Scores count at four decimals, which bounds the rows per key to 10,001."""
    return F.round("risk_score", 4).alias("risk_score")


def summarise(rows: DataFrame, *keys: str | Column, also: tuple[Column, ...] = ()) -> DataFrame:
    """Additive sums per key and score, and the aggregates of ``also``."""
    return rows.groupBy(*keys, _score()).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(value()).alias(name) for name, value in SUMMED.items()],
        *also,
    )


def nearest_rank(
    counted: DataFrame, keys: list[str], shares: dict[str, float], also: tuple[Column, ...] = ()
) -> DataFrame:
    """Score at 0-based position int(n * share) of the sorted scores, per key, and the
    aggregates of ``also`` in the same pass.

    ``counted`` has one row per key and score, so the running total is over 10,001
    rows per key at most.
    """
    ordered = Window.partitionBy(*keys).orderBy("risk_score")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.select(
        "*",
        F.sum("n").over(upto).alias("_upto"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("_all"),
    )
    position = {name: F.floor(F.col("_all") * F.lit(share)) for name, share in shares.items()}
    return ranked.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("_upto") > at, F.col("risk_score"))).alias(name)
            for name, at in position.items()
        ],
        *also,
    )


def metrics_from_summary(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The fifteen metrics per key from summed rows."""
    n = F.sum("n")

    def share(name: str) -> Column:
        return F.sum(name).cast("double") / n

    def mean(name: str) -> Column:
        return mean_of_sum(F.sum(name).cast("double"), n)

    sums = (
        n.alias("n_transactions"),
        share("flagged").alias("flag_rate"),
        mean_of_sum(F.sum(F.col("risk_score") * F.col("n")), n).alias("avg_risk_score"),
        share("ach").alias("pct_ach"),
        share("wire").alias("pct_wire"),
        share("bitcoin").alias("pct_bitcoin"),
        share("cash").alias("pct_cash"),
        mean("format_risk").alias("avg_payment_format_risk"),
        mean("currency_risk").alias("avg_currency_risk"),
        mean("cross_border").alias("pct_cross_border"),
        mean("near_threshold").alias("pct_near_threshold"),
        mean("in_cycle").alias("pct_in_cycle"),
        mean("fan_out").alias("avg_fan_out"),
        mean("bank_risk").alias("avg_bank_risk"),
        F.round(guarded_div(F.sum("ms").cast("double"), F.sum("timed")), 1).alias("avg_processing_ms"),
    )
    return nearest_rank(summary, keys, {"score_p95": 0.95}, sums).select(*keys, "n_transactions", *METRICS)


def lookback_summary(
    log: DataFrame, as_of: str | datetime, lookbacks: list[int] = fv.LOOKBACK_DAYS
) -> DataFrame:
    """Summary per lookback. Rows are summed once, in the shortest lookback that
    holds them; the sums, not the rows, are then copied into the longer ones."""
    spans = sorted(lookbacks)
    sliced = sliced_summary(lookback(log, as_of, spans[-1]), as_of, spans)
    # Written once: averages, percentiles and status all read it, the log is read once.
    return materialize(copy_into_longer(sliced, spans), "log-summary")


def sliced_summary(rows: DataFrame, as_of: str | datetime, spans: list[int]) -> DataFrame:
    """Sums by the shortest lookback that holds a row (``slice``) and score."""
    shortest = F
    for days in spans:
        shortest = shortest.when(F.col("ts") >= days_before(as_of, days), days)
    return summarise(rows, shortest.alias("slice"))


def copy_into_longer(sliced: DataFrame, spans: list[int]) -> DataFrame:
    """Sums per lookback from sums per slice, which count in every longer lookback too."""
    longer = F.filter(F.array(*[F.lit(d) for d in spans]), lambda d: d >= F.col("slice"))
    copied = sliced.withColumn("period_days", F.explode(longer))
    sums = [F.sum(c).alias(c) for c in ["n", *SUMMED]]
    return copied.groupBy("period_days", "risk_score").agg(*sums)


def drift_metrics(
    log: DataFrame, as_of: str | datetime, lookbacks: list[int] = fv.LOOKBACK_DAYS
) -> DataFrame:
    return metrics_from_summary(lookback_summary(log, as_of, lookbacks), ["period_days"])


def baseline_table(
    spark: SparkSession,
    baselines: dict[str, float] = fv.DRIFT_BASELINES,
    thresholds: dict[str, float] = fv.DRIFT_THRESHOLDS,
) -> DataFrame:
    """One row per metric: position, baseline and, where set, its threshold."""
    schema = T.StructType(
        [
            T.StructField("metric", T.StringType(), False),
            T.StructField("position", T.IntegerType(), False),
            T.StructField("baseline", T.DoubleType(), False),
            T.StructField("threshold", T.DoubleType(), True),
        ]
    )
    rows = [(m, i, float(b), thresholds.get(m)) for i, (m, b) in enumerate(baselines.items())]
    return spark.createDataFrame(rows, schema)


def compare_metrics(metrics: DataFrame, keys: list[str], baselines: DataFrame | None = None) -> DataFrame:
    """Long table: every metric beside its baseline, with the relative change.

    The baseline table has one row per metric, hence the broadcast.
    """
    baselines = baselines if baselines is not None else baseline_table(metrics.sparkSession)
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("current")) for m in METRICS]
    long = metrics.select(*keys, "n_transactions", F.explode(F.array(*entries)).alias("e")).select(
        *keys, "n_transactions", "e.*"
    )
    change = (F.col("current") - F.col("baseline")) / F.abs("baseline")
    return (
        long.join(F.broadcast(baselines), "metric", "left")
        .where(F.col("current").isNotNull() & (F.col("baseline") != 0))
        .withColumn("threshold", F.coalesce("threshold", F.lit(fv.DRIFT_THRESHOLD_DEFAULT)))
        .withColumn("change", change)
    )


def severity(change: Column, threshold: Column) -> Column:
    ratio = change / threshold
    return (
        F.when(ratio >= fv.SEVERITY_RATIOS["CRITICAL"], "CRITICAL")
        .when(ratio >= fv.SEVERITY_RATIOS["HIGH"], "HIGH")
        .otherwise("MEDIUM")
    )


def metric_table(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics against their baselines with a display band."""
    size = F.abs(F.col("change") * 100.0)
    return compare_metrics(metrics, keys).select(
        *keys,
        "metric",
        "baseline",
        "current",
        F.round(F.col("change") * 100.0, 1).alias("change_pct"),
        F.when(size > 50, "danger").when(size > 25, "warn").otherwise("normal").alias("band"),
    )


def action_text(metric: Column, up: Column) -> Column:
    rising = lookup(metric, {m: a[0] for m, a in fv.DRIFT_ACTIONS.items()}, fv.DRIFT_ACTION_DEFAULT)
    falling = lookup(metric, {m: a[1] for m, a in fv.DRIFT_ACTIONS.items()}, fv.DRIFT_ACTION_DEFAULT)
    return F.when(up, rising).otherwise(falling)


def drift_alerts(
    metrics: DataFrame,
    keys: list[str],
    baselines: DataFrame | None = None,
    min_rows: int = fv.MIN_ROWS_FOR_DRIFT,
) -> DataFrame:
    """Metrics that moved by more than their threshold."""
    enough = metrics.where(F.col("n_transactions") >= min_rows)
    size, up = F.abs("change"), F.col("current") > F.col("baseline")
    return (
        compare_metrics(enough, keys, baselines)
        .where(size > F.col("threshold"))
        .select(
            *keys,
            "metric",
            "position",
            "baseline",
            "current",
            F.round(size * 100.0, 1).alias("change_pct"),
            F.when(up, fv.DIRECTION_UP).otherwise(fv.DIRECTION_DOWN).alias("direction"),
            severity(size, F.col("threshold")).alias("severity"),
            lookup(F.col("metric"), fv.DRIFT_EXPLANATIONS, fv.DRIFT_EXPLANATION_DEFAULT).alias("explanation"),
            action_text(F.col("metric"), up).alias("action"),
        )
    )


def order_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(lookup(F.col("severity"), SEVERITY_RANK, 3), "position")


def drift_status(
    metrics: DataFrame,
    keys: list[str],
    baselines: DataFrame | None = None,
    min_rows: int = fv.MIN_ROWS_FOR_DRIFT,
) -> DataFrame:
    """One status row per key, also where there are too few rows or no alerts."""
    alerts = drift_alerts(metrics, keys, baselines, min_rows)
    critical, high = F.col("severity") == "CRITICAL", F.col("severity") == "HIGH"
    # A key has one alert per metric at most, so these lists are short.
    named = F.array_sort(F.collect_list(F.when(high, F.struct("position", "metric"))))
    counted = alerts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_alerts"),
        count_if(critical).alias("n_critical"),
        count_if(high).alias("n_high"),
        F.array_join(F.transform(named, lambda a: a["metric"]), ", ").alias("high_metrics"),
    )
    status = (
        F.when(F.col("n_transactions") < min_rows, "INSUFFICIENT_DATA")
        .when(F.col("n_critical") > 0, "CRITICAL_DRIFT")
        .when(F.col("n_high") > 0, "DRIFT_DETECTED")
        .when(F.col("n_alerts") > 0, "MINOR_DRIFT")
        .otherwise("STABLE")
    )
    before, after = fv.DRIFT_RECOMMENDATIONS["DRIFT_DETECTED"].split("{metrics}")
    advice = (
        F.when(F.col("status") == "INSUFFICIENT_DATA", F.lit(None).cast("string"))
        .when(
            F.col("status") == "DRIFT_DETECTED",
            F.concat(F.lit(before), F.col("high_metrics"), F.lit(after)),
        )
        .otherwise(
            lookup(
                F.col("status"),
                {k: v for k, v in fv.DRIFT_RECOMMENDATIONS.items() if k != "DRIFT_DETECTED"},
                "Unknown status.",
            )
        )
    )
    return (
        metrics.select(*keys, "n_transactions")
        .join(counted, keys, "left")
        .withColumn("status", status)
        .select(
            *keys,
            "n_transactions",
            F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"),
            "status",
            advice.alias("recommendation"),
        )
    )


def score_histogram(log: DataFrame, as_of: str | datetime, days: int = 30) -> DataFrame:
    """Ten score buckets, also the empty ones, with count and share."""
    return histogram_of_counts(lookback(log, as_of, days).select("risk_score", F.lit(1).alias("n")))


def histogram_of_counts(counts: DataFrame) -> DataFrame:
    """The same from rows that stand for ``n`` predictions of one score."""
    counted = counts.groupBy(decile(F.col("risk_score")).alias("bucket")).agg(F.sum("n").alias("n"))
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    buckets = counts.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return buckets.join(F.broadcast(counted), "bucket", "left").select(
        decile_label(F.col("bucket")).alias("bucket"),
        n.alias("n"),
        F.coalesce(F.round(n.cast("double") / F.col("total") * 100.0, 1), F.lit(0.0)).alias("pct"),
    )


def monitor_health(log: DataFrame, as_of: str | datetime, min_rows: int = fv.MIN_ROWS_FOR_DRIFT) -> DataFrame:
    end = days_before(as_of, 0)
    past = log.where(F.col("ts") < end)
    return past.agg(
        F.count(F.lit(1)).alias("total_logged"),
        count_if(F.col("ts") >= days_before(as_of, 7)).alias("last_7_days"),
        count_if(F.col("ts") >= days_before(as_of, 1)).alias("last_24_hours"),
    ).withColumn("drift_ready", F.when(F.col("last_7_days") >= min_rows, 1).otherwise(0))


def live_stats(log: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    counted = (
        lookback(log, as_of, days)
        .groupBy(F.lit(days).alias("period_days"), _score())
        .agg(F.count(F.lit(1)).alias("n"), count_if(F.col("verdict") == "FLAGGED").alias("flagged"))
    )
    sums = (
        F.sum("n").alias("n_transactions"),
        (F.sum("flagged").cast("double") / F.sum("n")).alias("flag_rate"),
        mean_of_sum(F.sum(F.col("risk_score") * F.col("n")), F.sum("n")).alias("avg_score"),
    )
    return nearest_rank(counted, ["period_days"], {"score_p95": 0.95, "score_p99": 0.99}, sums)


def format_mix(log: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Share of each payment format against its usual share."""
    counted = lookback(log, as_of, days).groupBy("payment_format").agg(F.count(F.lit(1)).alias("n"))
    # One row per payment format reaches this window.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    counted = counted.withColumn("total", total)
    pct = F.col("n").cast("double") / F.col("total") * 100.0
    usual = lookup(F.col("payment_format"), fv.FORMAT_MIX_BASELINE, fv.FORMAT_MIX_DEFAULT)
    return counted.select(
        "payment_format",
        "n",
        F.round(pct, 4).alias("pct"),
        usual.alias("baseline_pct"),
        F.when(F.abs(pct - usual) / usual > 0.25, 1).otherwise(0).alias("drifted"),
    )


def recent_predictions(log: DataFrame, as_of: str | datetime, k: int = 10, days: int = 1) -> DataFrame:
    """Newest rows of the last day with the number of rows in that day."""
    shown = ["ts", "payment_format", "currency", "amount_usd", "verdict", "risk_score", "from_bank", "to_bank"]
    # Stored, so that the log is read once for the rows and their number.
    recent = materialize(lookback(log, as_of, days).select(*shown), "recent-predictions")
    total = recent.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        recent.orderBy(F.col("ts").desc(), *[c for c in shown if c != "ts"])
        .limit(k)
        .select(*shown)
        .withColumn("total", total)
    )


def score_shift(rows: DataFrame, is_current: Column, score: str = "risk_score", floor: float = 1e-4) -> DataFrame:
    """Kolmogorov-Smirnov distance over all scores and population stability index
    over deciles, between the rows of ``is_current`` and all others, in one pass."""
    both = rows.groupBy(F.round(score, 4).alias("s")).agg(
        count_if(~F.coalesce(is_current, F.lit(False))).alias("ref"), count_if(is_current).alias("cur")
    )
    both = materialize(both, "score-counts")
    # One group on purpose: 10,001 distinct scores at most.
    whole = Window.partitionBy(F.lit(1))
    upto = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = both.select(
        F.abs(
            F.sum("ref").over(upto) / F.sum("ref").over(whole)
            - F.sum("cur").over(upto) / F.sum("cur").over(whole)
        ).alias("gap")
    )
    deciles = both.groupBy(decile(F.col("s")).alias("d")).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    ref = F.greatest(F.col("ref") / F.sum("ref").over(whole), F.lit(floor))
    cur = F.greatest(F.col("cur") / F.sum("cur").over(whole), F.lit(floor))
    index = deciles.select(((cur - ref) * F.log(cur / ref)).alias("part")).agg(F.round(F.sum("part"), 6).alias("psi"))
    return gaps.agg(F.round(F.max("gap"), 6).alias("ks")).select("ks", index.scalar().alias("psi"))


def rolling_trend(log: DataFrame, days: int = 90) -> DataFrame:
    """Per day: rows, flag rate and mean score over the ``days`` days up to it."""
    daily = log.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("verdict") == "FLAGGED").alias("flagged"),
        F.sum("risk_score").alias("score"),
    )
    return trend_of_days(daily, days)


def trend_of_days(daily: DataFrame, days: int) -> DataFrame:
    # One row per calendar day reaches this window.
    past = (
        Window.partitionBy(F.lit(1))
        .orderBy(F.unix_date("day"))
        .rangeBetween(-(days - 1), Window.currentRow)
    )
    n = F.sum("n").over(past)
    return daily.select(
        "day",
        n.alias("n"),
        F.round(F.sum("flagged").over(past) / n, 6).alias("flag_rate"),
        mean_of_sum(F.sum("score").over(past), n).alias("avg_score"),
    )
