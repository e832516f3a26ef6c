"""Drift and mix per time window over a stream of predictions.

Log times carry no zone. A watermark needs an instant, so a log time is read as
UTC whatever the session zone is, and window bounds are turned back the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalars import count_if
from txrisk.operators.drift import metrics_from_summary, summarise


def as_instant(wall: Column) -> Column:
    return F.from_utc_timestamp(wall.cast("timestamp"), F.current_timezone())


def as_wall(instant: Column) -> Column:
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def _bounds(grouped: DataFrame) -> DataFrame:
    named = grouped.withColumns(
        {"window_start": as_wall(F.col("window.start")), "window_end": as_wall(F.col("window.end"))}
    )
    return named.drop("window")


def _timed(log: DataFrame, delay: str) -> DataFrame:
    return log.withColumn("event_time", as_instant(F.col("ts"))).withWatermark("event_time", delay)


def _newest() -> Column:
    return F.max("ts").alias("newest")


def window_summary(
    log: DataFrame, length: str = "7 days", slide: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """Sums per sliding window and score. State is kept until the watermark passes
    the end of a window: 10,001 rows per open window at most."""
    window = F.window("event_time", length, slide)
    return _bounds(summarise(_timed(log, delay), window.alias("window"), also=(_newest(),)))


def latest_windows(updates: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The newest version of every window of an update sink, open ones included.

    ``is_open`` is 1 while later rows can still change the window: its end is not more
    than the delay before the newest row of the stream.
    """
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.agg(F.max("newest").alias("newest")).scalar()
    current = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
    still_open = F.col("window_end") > newest - F.expr(f"INTERVAL {delay}")
    return current.withColumn("is_open", F.when(still_open, 1).otherwise(0)).drop("newest")


def window_metrics(windows: DataFrame) -> DataFrame:
    """Drift metrics of all windows, from their sums."""
    return metrics_from_summary(windows, ["window_start", "window_end", "is_open"])


def daily_mix(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows and flag rate per calendar day and payment format."""
    grouped = _timed(log, delay).groupBy(F.window("event_time", "1 day"), "payment_format")
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("verdict") == "FLAGGED").alias("flagged"), _newest())
    return _bounds(counted).withColumn("flag_rate", F.round(F.col("flagged") / F.col("n"), 6))
