"""Rolling bank risk that looks at the past only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.scalars import count_if, guarded_div
from txrisk.operators.profiles import LABEL
from txrisk.session import materialize


def rolling_bank_risk_table(tx: DataFrame) -> DataFrame:
    """Per (bank, moment): positive share, in percent, of all strictly earlier rows.

    A running total over all rows of a bank would put a big bank into one task.
    Rows are first combined per (bank, moment); then totals of whole earlier days
    run over one row per day, and the rest runs inside a (bank, day) only.
    """
    moments = (
        tx.where(F.col("from_bank").isNotNull() & F.col("ts").isNotNull())
        .groupBy("from_bank", F.to_date("ts").alias("day"), "ts")
        .agg(F.count(F.lit(1)).alias("n"), count_if(F.col(LABEL) == 1).alias("bad"))
    )
    moments = materialize(moments, "bank-moments")
    days = moments.groupBy("from_bank", "day").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    earlier_days = Window.partitionBy("from_bank").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    day_start = days.select(
        "from_bank",
        "day",
        F.sum("n").over(earlier_days).alias("n_before"),
        F.sum("bad").over(earlier_days).alias("bad_before"),
    )
    earlier_today = (
        Window.partitionBy("from_bank", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0)
    running = moments.join(day_start, ["from_bank", "day"]).select(
        "from_bank",
        "ts",
        (F.coalesce("n_before", zero) + F.coalesce(F.sum("n").over(earlier_today), zero)).alias("past_tx"),
        (F.coalesce("bad_before", zero) + F.coalesce(F.sum("bad").over(earlier_today), zero)).alias("past_laundering"),
    )
    share = F.round(guarded_div(F.col("past_laundering").cast("double"), F.col("past_tx")) * 100.0, 6)
    return running.withColumn("rolling_bank_risk", F.coalesce(share, F.lit(0.0)))


def with_rolling_bank_risk(tx: DataFrame) -> DataFrame:
    return tx.join(rolling_bank_risk_table(tx), ["from_bank", "ts"], "left").fillna(
        {"past_tx": 0, "past_laundering": 0, "rolling_bank_risk": 0.0}
    )
