"""Training and auditing of the two-model ensemble with Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import fixed_values as fv
from txrisk.functions.scalars import guarded_div, verdict
from txrisk.operators import evaluation, splitting
from txrisk.operators.history import fit_history
from txrisk.operators.profiles import LABEL
from txrisk.plans.feature_table import transform
from txrisk.session import materialize
from txrisk.sources.readers import read_ensemble_metadata

SPLIT_KEYS = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "is_laundering"]


@dataclass(frozen=True)
class Settings:
    """Learner settings; the defaults are the published ones where Spark ML has
    the same parameter. Boosting stops early once a round no longer helps on the
    validation rows."""

    boosted_depth: int = 6
    boosted_rate: float = 0.05
    boosted_rounds: int = 1000
    early_stop_tolerance: float = 0.001
    forest_trees: int = 100
    forest_depth: int = 8
    negatives_per_positive: float = 10.0
    train_share: float = 0.8
    seed: int = 42


@dataclass(frozen=True)
class Ensemble:
    boosted: PipelineModel
    forest: PipelineModel
    boosted_ap: float
    forest_ap: float
    threshold: float
    features: list[str] = field(default_factory=lambda: list(fv.FEATURES))

    @property
    def boosted_weight(self) -> float:
        return self.boosted_ap / (self.boosted_ap + self.forest_ap)

    @property
    def forest_weight(self) -> float:
        return self.forest_ap / (self.boosted_ap + self.forest_ap)


@dataclass(frozen=True)
class Prepared:
    """Stored feature tables. ``train`` holds the rebalanced rows with ``weight``
    and ``is_validation``; ``test`` keeps its natural class mix and is stored when it is first read."""

    train: DataFrame
    unstored_test: DataFrame

    @cached_property
    def test(self) -> DataFrame:
        return materialize(self.unstored_test, "test")

    @property
    def validation(self) -> DataFrame:
        return self.train.where("is_validation")


def mark_validation(rows: DataFrame, fit_share: float = 0.8) -> DataFrame:
    """Adds ``is_validation`` by content hash: a row keeps its side through every step."""
    sides = ("fit", "validation")
    cut = splitting.split_stratified(rows, fit_share, splitting.VALIDATION_SALT, SPLIT_KEYS, sides)
    return cut.withColumn("is_validation", F.col("split") == "validation").drop("split")


def prepare(tx: DataFrame, settings: Settings = Settings(), temporal: bool = True) -> Prepared:
    """Split, fit history, rebalance, store.

    Validation rows are set aside first: history is fitted on the other training rows,
    so neither validation nor test rows see their own label in the bank risk. Only then
    are negatives thinned out, so that degrees and rates keep their true values.
    """
    if temporal:
        parts = splitting.split_temporal(tx, settings.train_share)
    else:
        parts = splitting.split_stratified(tx, settings.train_share, columns=SPLIT_KEYS)
    train_rows = parts.where("split = 'train'").drop("split")
    test_rows = parts.where("split = 'test'").drop("split")
    past = fit_history(mark_validation(train_rows).where("NOT is_validation").drop("is_validation"))
    kept = splitting.undersample(train_rows, settings.negatives_per_positive, columns=SPLIT_KEYS)
    stored = materialize(mark_validation(transform(kept, past)), "train")
    ratio = splitting.class_weight(stored).first()["positive_weight"]
    weighted = stored.withColumn("weight", F.when(F.col(LABEL) == 1, F.lit(ratio).cast("double")).otherwise(1.0))
    return Prepared(weighted, transform(test_rows, past))


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="keep")


def boosted_trees(features: list[str], settings: Settings) -> Pipeline:
    learner = GBTClassifier(
        featuresCol="vector",
        labelCol=LABEL,
        weightCol="weight",
        maxDepth=settings.boosted_depth,
        stepSize=settings.boosted_rate,
        maxIter=settings.boosted_rounds,
        validationIndicatorCol="is_validation",
        validationTol=settings.early_stop_tolerance,
        seed=settings.seed,
    )
    return Pipeline(stages=[_assembler(features), learner])


def random_forest(features: list[str], settings: Settings) -> Pipeline:
    learner = RandomForestClassifier(
        featuresCol="vector",
        labelCol=LABEL,
        weightCol="weight",
        numTrees=settings.forest_trees,
        maxDepth=settings.forest_depth,
        seed=settings.seed,
    )
    return Pipeline(stages=[_assembler(features), learner])


def add_probability(rows: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    predicted = model.transform(rows)
    chance = vector_to_array(F.col("probability"))[1]
    return predicted.withColumn(name, chance).drop("vector", "rawPrediction", "probability", "prediction")


def ensemble_score(first: Column, second: Column, weight_first: Column, weight_second: Column) -> Column:
    return F.round(weight_first * first + weight_second * second, 4)


def proportional_weights(quality: DataFrame) -> DataFrame:
    """Weights of two scores in proportion to their average precision."""
    total = F.col("ap_first") + F.col("ap_second")
    return quality.select(
        "ap_first",
        "ap_second",
        guarded_div(F.col("ap_first"), total).alias("weight_first"),
        guarded_div(F.col("ap_second"), total).alias("weight_second"),
    )


def _value(df: DataFrame, column: str) -> float:
    """One number of a one-row result."""
    return float(df.select(column).first()[0])


def train_ensemble(
    data: Prepared, settings: Settings = Settings(), features: list[str] = fv.FEATURES
) -> Ensemble:
    """Fit both learners, weigh them by validation quality, choose the threshold
    of the best F1 on validation rows."""
    boosted = boosted_trees(features, settings).fit(data.train)
    forest = random_forest(features, settings).fit(data.train.where("NOT is_validation"))
    both = add_probability(add_probability(data.validation, boosted, "p_boosted"), forest, "p_forest")
    scored = materialize(both.select(LABEL, "p_boosted", "p_forest"), "validation-scores")
    ap = {
        name: _value(evaluation.ranking_quality(scored, name, digits=None), "average_precision")
        for name in ("p_boosted", "p_forest")
    }
    total = ap["p_boosted"] + ap["p_forest"]
    score = ensemble_score(
        F.col("p_boosted"), F.col("p_forest"), F.lit(ap["p_boosted"] / total), F.lit(ap["p_forest"] / total)
    )
    curve = evaluation.precision_recall_curve(scored.withColumn("risk_score", score))
    threshold = _value(evaluation.best_f1(curve), "threshold")
    return Ensemble(boosted, forest, ap["p_boosted"], ap["p_forest"], threshold, list(features))


def score_ensemble(rows: DataFrame, model: Ensemble, threshold: float | None = None) -> DataFrame:
    """Score a whole feature table."""
    cut = model.threshold if threshold is None else threshold
    both = add_probability(add_probability(rows, model.boosted, "p_boosted"), model.forest, "p_forest")
    score = ensemble_score(
        F.col("p_boosted"), F.col("p_forest"), F.lit(model.boosted_weight), F.lit(model.forest_weight)
    )
    scored = both.withColumn("risk_score", score)
    return scored.withColumns({"verdict": verdict(F.col("risk_score"), cut), "threshold": F.lit(cut)})


def evaluation_report(scored: DataFrame, model: Ensemble, threshold: float | None = None) -> DataFrame:
    """One row of test metrics, all at the threshold named in the row."""
    cut = model.threshold if threshold is None else threshold
    quality = evaluation.ranking_quality(scored).select("roc_auc", "average_precision")
    counts = evaluation.confusion(scored, cut)
    # Both sides have exactly one row; they are put side by side by scalar subqueries.
    return counts.select(
        "*",
        quality.select("roc_auc").scalar().alias("roc_auc"),
        quality.select("average_precision").scalar().alias("average_precision"),
        F.lit(model.boosted_weight).alias("boosted_weight"),
        F.lit(model.forest_weight).alias("forest_weight"),
        F.lit(model.boosted_ap).alias("boosted_validation_ap"),
        F.lit(model.forest_ap).alias("forest_validation_ap"),
    )


def importance_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """Importance of every feature in each model, as shares, and their mean."""
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])

    def rows(fitted: PipelineModel, name: str) -> DataFrame:
        values = fitted.stages[-1].featureImportances.toArray()
        pairs = [(f, float(v)) for f, v in zip(model.features, values)]
        return spark.createDataFrame(pairs, schema).withColumnRenamed("importance", name)

    return combine_importance(rows(model.boosted, "boosted"), rows(model.forest, "forest"))


def combine_importance(boosted: DataFrame, forest: DataFrame) -> DataFrame:
    def share(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.sum(name).alias("t")).scalar()
        return df.select("feature", guarded_div(F.col(name), total).alias(name))

    both = share(boosted, "boosted").join(share(forest, "forest"), "feature")
    mean = (F.col("boosted") + F.col("forest")) / 2
    return both.withColumn("avg_importance", mean).orderBy(F.col("avg_importance").desc(), "feature")


def ablation_audit(
    data: Prepared, feature: str = "bank_risk_score", settings: Settings = Settings()
) -> DataFrame:
    """Test quality of the boosted model with and without one feature."""

    def quality(features: list[str], suffix: str) -> DataFrame:
        model = boosted_trees(features, settings).fit(data.train)
        scored = add_probability(data.test, model, "risk_score")
        found = evaluation.ranking_quality(scored, digits=None)
        return found.select(
            F.col("roc_auc").alias(f"roc_auc_{suffix}"), F.col("average_precision").alias(f"ap_{suffix}")
        )

    kept = [f for f in fv.FEATURES if f != feature]
    with_it, without = quality(fv.FEATURES, "with"), quality(kept, "without")
    side = with_it.select(
        F.lit(feature).alias("feature"),
        "roc_auc_with",
        without.select("roc_auc_without").scalar().alias("roc_auc_without"),
        "ap_with",
        without.select("ap_without").scalar().alias("ap_without"),
    )
    difference = F.round(F.col("ap_with") - F.col("ap_without"), 6)
    return side.withColumns(
        {
            "roc_auc_difference": F.round(F.col("roc_auc_with") - F.col("roc_auc_without"), 6),
            "ap_difference": difference,
            "leakage": evaluation.ablation_band(difference),
        }
    )


def metadata_row(spark: SparkSession, model: Ensemble) -> DataFrame:
    values = {
        "boosted_weight": model.boosted_weight,
        "forest_weight": model.forest_weight,
        "threshold": model.threshold,
        "boosted_ap": model.boosted_ap,
        "forest_ap": model.forest_ap,
        "features": model.features,
    }
    return spark.createDataFrame([(json.dumps(values),)], "value string")


def save_ensemble(spark: SparkSession, model: Ensemble, path: str) -> None:
    model.boosted.write().overwrite().save(f"{path}/boosted")
    model.forest.write().overwrite().save(f"{path}/forest")
    metadata_row(spark, model).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    meta = read_ensemble_metadata(spark, f"{path}/metadata").first()
    return Ensemble(
        PipelineModel.load(f"{path}/boosted"),
        PipelineModel.load(f"{path}/forest"),
        meta["boosted_ap"],
        meta["forest_ap"],
        meta["threshold"],
        list(meta["features"]),
    )
