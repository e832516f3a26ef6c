"""Exact nearest-rank quantiles of values that are not rounded.

Values are counted and stored in ranges. One row per range says how many rows lie in the
ranges before; only the ranges that hold a wanted rank are then looked into. No task sees
more than a range, whatever the number of distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import materialize


def exact_quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at 0-based position floor(n * share) of the sorted
    values (the last one for a share of 1), and ``n``. Nulls and NaN are left out; without
    values all quantiles are null."""
    number = F.col(value).cast("double")
    counted = rows.where(number.isNotNull() & ~F.isnan(number)).groupBy(number.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(F.col("value")).withColumn("range", F.spark_partition_id())
    stored = materialize(ranged, "value-ranges")
    totals = stored.groupBy("range").agg(F.sum("n").alias("rows"))
    # one row per range reaches this window
    upto = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(
        totals.select("range", (F.sum("rows").over(upto) - F.col("rows")).alias("before"), "rows", F.sum("rows").over(Window.partitionBy(F.lit(1))).alias("all")),
        "range-places",
    )
    # positions stay below 2 ** 53, so the product is the one that SQL computes
    wanted = {name: F.least(F.floor(F.col("all") * F.lit(float(share))), F.col("all") - 1) for name, share in shares.items()}
    holds = F.lit(False)
    for at in wanted.values():
        holds = holds | ((at >= F.col("before")) & (at < F.col("before") + F.col("rows")))
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = stored.join(placed.where(holds), "range").withColumn("_upto", F.col("before") + F.sum("n").over(inside))
    found = ranked.agg(*[F.min(F.when(F.col("_upto") > at, F.col("value"))).alias(name) for name, at in wanted.items()])
    return found.withColumn("n", F.coalesce(placed.agg(F.sum("rows").alias("t")).scalar(), F.lit(0).cast("long")))
