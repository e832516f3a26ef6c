"""Payments derived from an order warehouse.

A payment is an order line: the customer pays the supplier. Customers and
suppliers share one space of account numbers, which gives self-payments and
reciprocal flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.session import materialize


def _pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index % len(names)).cast("int") + 1)


def payment_stream(spark: SparkSession, folder: str, with_latency: bool = False) -> DataFrame:
    """The same payments as a stream over the order lines."""
    path = f"{folder}/lineitem.parquet"
    # A stream source takes folders; the pattern also admits a single file.
    lines = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return payments(spark, folder, with_latency, lines)


def payments(
    spark: SparkSession, folder: str, with_latency: bool = False, lines: DataFrame | None = None
) -> DataFrame:
    """Payment table; ``with_latency`` adds the ``processing_ms`` log column.

    No join is hinted: Catalyst broadcasts a dimension only while its size allows.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem") if lines is None else lines
    orders, customers, suppliers = table("orders"), table("customer"), table("supplier")
    # Orders meet their customers first: they are fewer and narrower than the lines, which then move once less.
    ordered = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    hours = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24).cast("int")
    zero = F.lit(0)
    mismatch = F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0)
    columns = [
        (F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(zero, hours, zero, zero)).alias("ts"),
        F.col("o_custkey").alias("from_account"),
        F.col("l_suppkey").alias("to_account"),
        F.col("c_nationkey").alias("from_bank"),
        F.col("s_nationkey").alias("to_bank"),
        F.col("l_extendedprice").alias("amount_paid"),
        F.col("l_extendedprice").alias("amount_received"),
        _pick(fv.WAREHOUSE_FORMATS, F.col("l_partkey")).alias("payment_format"),
        _pick(fv.WAREHOUSE_CURRENCIES, F.col("o_custkey")).alias("payment_currency"),
        _pick(fv.WAREHOUSE_CURRENCIES, F.col("o_custkey") + mismatch).alias("receiving_currency"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), 1)
        .otherwise(0)
        .alias("is_laundering"),
    ]
    if with_latency:
        columns.append((F.col("l_partkey") % 50).cast("int").alias("processing_ms"))
    return joined.select(*columns)


def stored_payments(spark: SparkSession, folder: str, with_latency: bool = False) -> DataFrame:
    """The payment table joined once and written, for queries that read it several times."""
    return materialize(payments(spark, folder, with_latency), "payments")
