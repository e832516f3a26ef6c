"""Profiles by class. Each one is a single pass with map-side aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import fixed_values as fv
from txrisk.functions.scalars import count_if, lookup, share_pct

LABEL = "is_laundering"


def class_name(label: Column) -> Column:
    return lookup(label, fv.CLASS_NAMES, "Unknown")


def class_counts(tx: DataFrame, label: str = LABEL) -> DataFrame:
    """Total, positive and negative rows with the positive share."""
    counted = tx.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col(label) == 1).alias("positives"),
        count_if(F.col(label) == 0).alias("negatives"),
    )
    return counted.withColumn("positive_pct", share_pct(F.col("positives"), F.col("total")))


def class_distribution(tx: DataFrame, label: str = LABEL) -> DataFrame:
    counted = tx.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class reaches this window.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.select(
        F.col(label),
        class_name(F.col(label)).alias("label"),
        "n",
        share_pct(F.col("n"), total).alias("pct"),
    )


def amount_stats(tx: DataFrame, amount: str = "amount_paid", label: str = LABEL) -> DataFrame:
    value = F.col(amount)
    return tx.groupBy(label).agg(
        F.round(F.avg(value), 2).alias("avg_amount"),
        F.round(F.min(value), 2).alias("min_amount"),
        F.round(F.max(value), 2).alias("max_amount"),
        F.round(F.stddev(value), 2).alias("std_amount"),
    )


def rate_by(tx: DataFrame, dimension: Column, name: str, label: str = LABEL) -> DataFrame:
    """Rows per class and positive rate for every value of a dimension.

    Both class columns always exist, also when a class is absent.
    """
    return (
        tx.groupBy(dimension.alias(name))
        .agg(
            count_if(F.col(label) == 0).alias("legitimate"),
            count_if(F.col(label) == 1).alias("laundering"),
        )
        .withColumn(
            "rate_pct",
            share_pct(F.col("laundering"), F.col("legitimate") + F.col("laundering")),
        )
    )


def pivot_by_class(tx: DataFrame, dimension: str, label: str = LABEL) -> DataFrame:
    """The same counts as a pivot with fixed class values and missing filled by 0."""
    wide = tx.groupBy(dimension).pivot(label, [0, 1]).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=["0", "1"]).withColumnsRenamed({"0": "legitimate", "1": "laundering"})


def weekday_name(day: Column) -> Column:
    return lookup(day, fv.DAY_NAMES, "Unknown")


def cross_border_name(from_bank: Column, to_bank: Column) -> Column:
    return F.when(from_bank != to_bank, "Cross-Border").otherwise("Same Bank")


def currency_match_name(paid: Column, received: Column) -> Column:
    return F.when(paid != received, "Currency Mismatch").otherwise("Same Currency")


def structuring_name(amount: Column) -> Column:
    low, high = fv.STRUCTURING_RANGE
    return F.when((amount >= low) & (amount < high), "$8K-$10K Range").otherwise("Other Amounts")


def top_by(df: DataFrame, measure: str, k: int, *tie_break: str) -> DataFrame:
    """The k largest by a measure. Ties are ordered by the named columns."""
    return df.orderBy(F.col(measure).desc(), *[F.col(c) for c in tie_break]).limit(k)


def _unpivot(row: DataFrame, prefixes: dict[str, str], names: list[str], feature: str) -> DataFrame:
    """Turn one wide row of aggregates into one row per feature."""
    entries = [
        F.struct(
            F.lit(name).alias(feature),
            *[F.col(f"{prefix}{name}").alias(column) for prefix, column in prefixes.items()],
        )
        for name in names
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def feature_class_means(
    features: DataFrame,
    names: list[str] = fv.FEATURES,
    digits: int = 4,
    percent: bool = False,
    label: str = LABEL,
) -> DataFrame:
    """Mean of every feature per class: one pass for all features."""
    scale = F.lit(100.0 if percent else 1.0)

    def mean(name: str, wanted: int) -> Column:
        value = F.when(F.col(label) == wanted, F.col(name).cast(T.DoubleType()))
        return F.round(F.avg(value) * scale, digits)

    wide = features.agg(
        *[mean(n, 1).alias(f"laundering_{n}") for n in names],
        *[mean(n, 0).alias(f"legitimate_{n}") for n in names],
    )
    prefixes = {"laundering_": "laundering_avg", "legitimate_": "legitimate_avg"}
    return _unpivot(wide, prefixes, names, "feature")


def feature_lift(
    features: DataFrame,
    names: list[str] = fv.LIFT_FEATURES,
    floor: float = 0.0001,
    only_zero: bool = False,
) -> DataFrame:
    """Ratio of the class means. A tiny legitimate mean is replaced by ``floor``;
    with ``only_zero`` that is done for zero only."""
    means = feature_class_means(features, names)
    base = F.col("legitimate_avg")
    guarded = F.when(base > 0, base).otherwise(floor) if only_zero else F.greatest(base, F.lit(floor))
    return means.withColumn("lift", F.round(F.col("laundering_avg") / guarded, 2))


def null_profile(df: DataFrame, names: list[str] = fv.FEATURES) -> DataFrame:
    wide = df.agg(*[count_if(F.col(n).isNull()).alias(f"nulls_{n}") for n in names])
    return _unpivot(wide, {"nulls_": "n_null"}, names, "feature")
