"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.scalars import lookup


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def as_json_records(df: DataFrame, column: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def case_report_text(reports: DataFrame, width: int = 65) -> DataFrame:
    """One readable block of text per case report."""
    heading = F.format_string(
        "CASE %02d — %s — %s",
        F.col("case_id").cast("int"),
        F.col("case_type"),
        lookup(F.col("case_type"), fv.CASE_NAMES, ""),
    )
    actual = F.when(F.col("actual_label") == 1, "FRAUD").otherwise("LEGITIMATE")
    drivers = F.transform(
        "drivers",
        lambda d: F.concat(
            F.lit("  "),
            F.rpad(d["feature"], 28, " "),
            F.lit(" value="),
            F.format_string("%+.4f", d["shap_val"]),
            F.lit(" ("),
            d["direction"],
            F.lit(" risk)"),
        ),
    )
    block = F.concat_ws(
        "\n",
        heading,
        F.lit("-" * width),
        F.format_string("Risk Score  : %.4f", F.col("risk_score")),
        F.concat(F.lit("Verdict     : "), F.col("verdict")),
        F.concat(F.lit("Actual Label: "), actual),
        F.lit(""),
        F.lit("Top Drivers:"),
        F.array_join(drivers, "\n"),
        F.lit(""),
        F.lit("Explanation:"),
        F.col("explanation"),
        F.lit(""),
        F.lit("=" * width),
        F.lit(""),
    )
    return reports.select(block.alias("value"))


def write_case_report_text(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    case_report_text(reports).write.mode(mode).text(path)


def write_reports(reports: DataFrame, path: str, run: str) -> None:
    """Store one run of case reports beside the earlier ones."""
    reports.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def show_summary(df: DataFrame, rows: int = 5) -> None:
    df.printSchema()
    df.show(rows, truncate=False)
