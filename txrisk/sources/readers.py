"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import schemas

CORRUPT = "_corrupt"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    mode: str = "PERMISSIVE",
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV with a header row. Columns are taken by position from ``schema``."""
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", mode)
    )
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(path)


def read_transactions_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, schemas.RAW_TRANSACTIONS, **options)


def read_accounts_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, schemas.ACCOUNTS, **options)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_latest_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of the newest run, each with the number of reports in that run.

    ``run`` is a partition column, so the filter on it prunes the older runs.
    """
    reports = spark.read.parquet(path)
    newest = reports.agg(F.max("run").alias("run")).scalar()
    latest = reports.where(F.col("run") == newest)
    total = latest.agg(F.count(F.lit(1)).alias("n_reports")).scalar()
    return latest.withColumn("n_reports", total)


def read_ensemble_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENSEMBLE_METADATA).option("multiLine", True).json(path)
