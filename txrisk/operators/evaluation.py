"""Evaluation of scores against labels.

All curves start from the threshold table, one row per distinct score, written once
in descending ranges of the score. The running total is done in two levels at every
size: inside each range, and over one row per range. No task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.scalars import case_type, count_if, guarded_div, mean_of_sum
from txrisk.operators.profiles import LABEL, class_name
from txrisk.session import materialize

EPSILON = 1e-8


def threshold_table(
    scored: DataFrame, score: str = "risk_score", label: str = LABEL, digits: int | None = 4
) -> DataFrame:
    """Rows of both classes per distinct score; ``digits`` of None keeps scores as they are."""
    value = F.col(score).cast("double")
    return (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy((value if digits is None else F.round(value, digits)).alias("threshold"))
        .agg(count_if(F.col(label) == 1).alias("pos"), count_if(F.col(label) == 0).alias("neg"))
    )


def in_ranges(thresholds: DataFrame, ranges: int | None = None) -> DataFrame:
    """Descending ranges of the score, numbered by ``part``. Their number follows the
    shuffle partitions of the session unless given."""
    by = F.col("threshold").desc()
    ranged = thresholds.repartitionByRange(ranges, by) if ranges else thresholds.repartitionByRange(by)
    return ranged.withColumn("part", F.spark_partition_id())


def stored_thresholds(scored: DataFrame, score: str, label: str, digits: int | None) -> DataFrame:
    """The threshold table, written once: curves read it several times, the
    scored rows are read once. The number of a range is stored with its rows."""
    return materialize(in_ranges(threshold_table(scored, score, label, digits)), "thresholds")


def _totals(thresholds: DataFrame) -> tuple[Column, Column]:
    sums = thresholds.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select("p").scalar(), sums.select("n").scalar()


def running_counts(thresholds: DataFrame) -> DataFrame:
    """Positives and negatives at each threshold or above, from rows with ``part``."""
    totals = thresholds.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # One row per range reaches this window.
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("p").over(before), F.lit(0)).alias("tp0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("fp0"),
    )
    inside = (
        Window.partitionBy("part")
        .orderBy(F.col("threshold").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return thresholds.join(starts, "part").select(
        "threshold",
        "pos",
        "neg",
        (F.col("tp0") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("fp0") + F.sum("neg").over(inside)).alias("fp"),
    )


def precision_recall_curve(
    scored: DataFrame,
    score: str = "risk_score",
    label: str = LABEL,
    digits: int | None = 4,
) -> DataFrame:
    """Counts, precision, recall and F1 when flagging scores >= threshold."""
    thresholds = stored_thresholds(scored, score, label, digits)
    positives, _ = _totals(thresholds)
    counts = running_counts(thresholds)
    flagged = F.col("tp") + F.col("fp")
    precision = guarded_div(F.col("tp").cast("double"), flagged)
    recall = guarded_div(F.col("tp").cast("double"), positives)
    curve = counts.select("threshold", "tp", "fp", precision.alias("precision"), recall.alias("recall"))
    f1 = F.lit(2.0) * F.col("precision") * F.col("recall") / (
        F.col("precision") + F.col("recall") + F.lit(EPSILON)
    )
    return curve.withColumn("f1", f1)


def best_f1(curve: DataFrame) -> DataFrame:
    """Row of the highest F1; of equal ones the lowest threshold."""
    return curve.orderBy(F.col("f1").desc(), F.col("threshold")).limit(1)


def thresholds_meeting(curve: DataFrame, min_recall: float = 0.60, min_precision: float = 0.30) -> DataFrame:
    """Thresholds that reach both targets; the best F1 if there is none."""
    good = curve.where((F.col("recall") >= min_recall) & (F.col("precision") >= min_precision))
    found = good.agg(F.count(F.lit(1)).alias("n")).scalar()
    fallback = best_f1(curve).where(found == 0)
    return good.withColumn("meets_both", F.lit(1)).unionByName(fallback.withColumn("meets_both", F.lit(0)))


def ranking_quality(
    scored: DataFrame,
    score: str = "risk_score",
    label: str = LABEL,
    digits: int | None = 4,
) -> DataFrame:
    """ROC area, with ties counted half, and step-wise average precision.

    Average precision weighs each precision by the recall gained at its threshold,
    which is the positives at that score over all positives.
    """
    thresholds = stored_thresholds(scored, score, label, digits)
    positives, negatives = _totals(thresholds)
    counts = running_counts(thresholds)
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    won = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0))
    sums = counts.agg(
        F.sum(F.col("pos") * precision).alias("weighted"),
        F.sum(won).alias("won"),
    )
    return sums.select(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.round(guarded_div(F.col("won"), positives.cast("double") * negatives), 8).alias("roc_auc"),
        F.round(guarded_div(F.col("weighted"), positives), 8).alias("average_precision"),
    )


def confusion(scored: DataFrame, threshold: float, score: str = "risk_score", label: str = LABEL) -> DataFrame:
    kind = case_type(F.col(score), F.col(label), threshold)
    counts = scored.agg(*[count_if(kind == k).alias(k.lower()) for k in ("TP", "FP", "FN", "TN")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return counts.select(
        F.lit(float(threshold)).alias("threshold"),
        "tp",
        "fp",
        "fn",
        "tn",
        F.coalesce(guarded_div(tp.cast("double"), tp + fp), zero).alias("precision"),
        F.coalesce(guarded_div(tp.cast("double"), tp + fn), zero).alias("recall"),
        F.coalesce(guarded_div(tp * 2.0, tp * 2 + fp + fn), zero).alias("f1"),
    )


def calibration(
    scored: DataFrame,
    score: str = "risk_score",
    label: str = LABEL,
    gap: float = 20.0,
    binary_edges: bool = False,
) -> DataFrame:
    """Ten score bins: rows, positive share, expected share, gap flag.

    ``binary_edges`` compares with multiples of 0.1 as they are in binary and
    drops a score of 1.0; by default 1.0 belongs to the last bin.
    """
    value = F.col(score)
    if binary_edges:
        edges = [i * 0.1 for i in range(1, 10)]
        bin_no = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))
        scored = scored.where((value >= 0) & (value < 1.0))
    else:
        bin_no = F.least(F.floor(value * 10.0), F.lit(9)).cast("int")
    bins = (
        scored.groupBy(bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label) * 100.0).alias("share"))
        .where("bin IS NOT NULL")
    )
    expected = F.col("bin") * 10.0 + 5.0
    return bins.select(
        "bin",
        "n",
        F.round("share", 3).alias("actual_pct"),
        expected.alias("expected_pct"),
        F.when(F.abs(F.col("share") - expected) > gap, 1).otherwise(0).alias("off"),
    )


def score_density(scored: DataFrame, bins: int = 50, score: str = "risk_score", label: str = LABEL) -> DataFrame:
    """Histogram of [0, 1] per class, as count and as density."""
    bin_no = F.least(F.floor(F.col(score) * float(bins)), F.lit(bins - 1)).cast("int")
    counted = scored.groupBy(F.col(label), bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most ``bins`` rows per class reach this window.
    whole = F.sum("n").over(Window.partitionBy(label))
    return counted.withColumn("density", F.round(F.col("n") / whole * float(bins), 6))


def score_summary(scored: DataFrame, score: str = "risk_score", label: str = LABEL) -> DataFrame:
    """Mean, median and high counts per class, from the scores counted at four decimals."""
    counted = scored.groupBy(F.col(label), F.round(F.col(score), 4).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return counted.groupBy(label).agg(
        F.sum("n").alias("n"),
        mean_of_sum(F.sum(F.col("s") * F.col("n")), F.sum("n")).alias("mean_score"),
        F.round(F.percentile("s", 0.5, F.col("n")), 4).alias("median_score"),
        F.coalesce(F.sum(F.when(F.col("s") > 0.5, F.col("n"))), zero).alias("n_above_50"),
        F.coalesce(F.sum(F.when(F.col("s") > 0.85, F.col("n"))), zero).alias("n_above_85"),
    ).withColumn("label", class_name(F.col(label)))


def single_feature_leakage(features: DataFrame, column: str, label: str = LABEL, digits: int = 6) -> DataFrame:
    """How well one column alone ranks the labels, with a suspicion band."""
    quality = ranking_quality(features, column, label, digits)
    band = (
        F.when(F.col("roc_auc") > 0.80, "very high")
        .when(F.col("roc_auc") > 0.65, "moderate")
        .otherwise("low")
    )
    return quality.select(
        F.lit(column).alias("feature"), "roc_auc", "average_precision", band.alias("suspicion")
    )


def ablation_band(difference: Column) -> Column:
    return F.when(difference > 0.05, "significant").when(difference > 0.01, "minor").otherwise("minimal")


def with_case_type(scored: DataFrame, threshold: float = fv.MODEL_THRESHOLD, score: str = "risk_score", label: str = LABEL) -> DataFrame:
    return scored.withColumn("case_type", case_type(F.col(score), F.col(label), threshold))
