"""Attribution of a linear score: each feature's weight times its distance to the mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_means(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row of means: the expectation that contributions are measured from."""
    return rows.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])


def with_linear_contributions(
    rows: DataFrame, weights: dict[str, float], means: dict[str, float], intercept: float = 0.0
) -> DataFrame:
    """Adds ``contributions`` (a struct with one field per feature) and ``expected``, the
    score at the means. Together they add up to the score of the row. A missing value
    counts as the mean, so it contributes nothing."""
    parts = [
        (F.lit(float(w)) * (F.coalesce(F.col(f).cast("double"), F.lit(float(means[f]))) - F.lit(float(means[f])))).alias(f)
        for f, w in weights.items()
    ]
    expected = intercept + sum(w * means[f] for f, w in weights.items())
    return rows.withColumn("contributions", F.struct(*parts)).withColumn("expected", F.lit(float(expected)))
