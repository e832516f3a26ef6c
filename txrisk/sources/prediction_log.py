"""Append-only prediction log, partitioned by day."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schemas

log = logging.getLogger(__name__)


def as_of_literal(as_of: str | datetime) -> Column:
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def days_before(as_of: str | datetime, days: int | Column) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    zero = F.lit(0)
    return as_of_literal(as_of) - F.make_dt_interval(days, zero, zero, zero)


def to_log(scored: DataFrame) -> DataFrame:
    """Bring scored payments into the shape of the log.

    The log keeps bank risk as a fraction, the unit of the drift baseline, while
    the feature table keeps it in percent.
    """
    shape = {field.name: field.dataType for field in schemas.PREDICTION_LOG.fields}
    source = {
        "currency": F.col("payment_currency"),
        "fan_out": F.col("fan_out_degree"),
        "bank_risk_score": F.col("bank_risk_score") / F.lit(100.0),
        "tx_velocity_feat": F.col("tx_velocity"),
    }
    return scored.select(
        *[source.get(name, F.col(name)).cast(kind).alias(name) for name, kind in shape.items()]
    )


def append_predictions(rows: DataFrame, path: str, strict: bool = False) -> bool:
    """Append to the log. A failed write is reported, not raised, unless strict.

    Rows are gathered by day before the write, so a day gets few files; adaptive
    execution splits a day that is too large for one task.
    """
    dated = rows.withColumn("dt", F.to_date("ts")).hint("rebalance", F.col("dt"))
    try:
        dated.write.mode("append").partitionBy("dt").parquet(path)
        return True
    except Exception:
        if strict:
            raise
        log.exception("prediction log append failed")
        return False


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookback(rows: DataFrame, as_of: str | datetime, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``.

    When the log's day partition is present it is filtered too, so only the days
    concerned are listed and read.
    """
    start, end = days_before(as_of, days), as_of_literal(as_of)
    if "dt" in rows.columns:
        rows = rows.where((F.col("dt") >= F.to_date(start)) & (F.col("dt") <= F.to_date(end)))
    return rows.where((F.col("ts") >= start) & (F.col("ts") < end))


def recent_rows(rows: DataFrame, as_of: str | datetime, days: int) -> DataFrame:
    """The lookback in display order: newest first, columns as consumers expect."""
    recent = lookback(rows, as_of, days)
    return recent.orderBy(F.col("ts").desc(), *schemas.LOOKBACK_COLUMNS).select(
        *schemas.LOOKBACK_COLUMNS
    )
