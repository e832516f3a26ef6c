"""Case selection, case comparison and case reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions import text
from txrisk.functions.scalars import verdict
from txrisk.functions.scorecard import signed_contributions, top_drivers
from txrisk.operators.evaluation import with_case_type
from txrisk.operators.profiles import LABEL

CASE_ORDER = [
    "ts",
    "from_account",
    "to_account",
    "amount_paid",
    "payment_format",
    "is_laundering",
]
_TYPE_RANK = {"TP": 1, "FP": 2, "FN": 3}


def top_scores(scored: DataFrame, k: int = 10, fields: list[str] = fv.TOP_SCORE_FIELDS) -> DataFrame:
    return (
        scored.orderBy(F.col("risk_score").desc(), *CASE_ORDER)
        .limit(k)
        .select("risk_score", LABEL, *fields)
    )


def case_sample(
    scored: DataFrame,
    threshold: float = fv.SCORECARD_THRESHOLD,
    per_type: int = 10,
    order: list[str] = CASE_ORDER,
) -> DataFrame:
    """First rows of each kind of hit and miss, in a declared order.

    The rank filter is applied by every task before the shuffle, so no more than
    ``per_type`` rows per kind and task move.
    """
    typed = with_case_type(scored, threshold).where(F.col("case_type") != "TN")
    first = Window.partitionBy("case_type").orderBy(*order)
    return typed.withColumn("case_rank", F.row_number().over(first)).where(F.col("case_rank") <= per_type)


def case_means(
    scored: DataFrame,
    threshold: float = fv.SCORECARD_THRESHOLD,
    names: list[str] = fv.CASE_MEAN_FEATURES,
) -> DataFrame:
    """Feature means of true positives, false positives and misses side by side."""
    typed = with_case_type(scored, threshold)
    kinds = ["TP", "FP", "FN"]
    wide = typed.agg(
        *[
            F.round(F.avg(F.when(F.col("case_type") == k, F.col(n).cast("double"))), 4).alias(f"{k}_{n}")
            for k in kinds
            for n in names
        ]
    )
    rows = [
        F.struct(
            F.lit(n).alias("feature"), *[F.col(f"{k}_{n}").alias(f"{k.lower()}_mean") for k in kinds]
        )
        for n in names
    ]
    return wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def with_drivers(scored: DataFrame, n: int = 5) -> DataFrame:
    return scored.withColumn("drivers", top_drivers(signed_contributions(), n))


def with_explanation(scored: DataFrame, threshold: float = fv.SCORECARD_THRESHOLD) -> DataFrame:
    return text.add_case_report(scored, "explanation", threshold)


def case_reports(
    scored: DataFrame, threshold: float = fv.SCORECARD_THRESHOLD, per_type: int = 10
) -> DataFrame:
    """One report per sampled case, numbered by kind and then by order."""
    cases = case_sample(scored, threshold, per_type)
    rank = F.create_map(*[F.lit(v) for pair in _TYPE_RANK.items() for v in pair])[F.col("case_type")]
    # 3 x per_type rows at most reach this window.
    number = Window.partitionBy(F.lit(1)).orderBy(rank, "case_rank")
    explained = with_drivers(with_explanation(cases, threshold))
    return explained.select(
        F.row_number().over(number).alias("case_id"),
        "case_type",
        "risk_score",
        F.col(LABEL).alias("actual_label"),
        verdict(F.col("risk_score"), threshold).alias("verdict"),
        "drivers",
        F.struct(*[n for n in fv.FEATURES if n in scored.columns]).alias("features"),
        "explanation",
    )


def top_driver_counts(cases: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent first driver over the cases."""
    return (
        cases.groupBy(F.get("drivers", F.lit(0))["feature"].alias("feature"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "feature")
        .limit(k)
    )


def reports_of_type(reports: DataFrame, kind: str = "ALL") -> DataFrame:
    return reports if kind == "ALL" else reports.where(F.col("case_type") == kind)
