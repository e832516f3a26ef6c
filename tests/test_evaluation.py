"""Curves and metrics against brute force and against Spark ML."""

import random

import pytest
from conftest import rows_of
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from txrisk.operators import cases, evaluation
from txrisk.session import materialize


def sample(n=800, seed=3, positives=0.2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        label = int(rng.random() < positives)
        rows.append((round(min(max(rng.gauss(0.4 + 0.2 * label, 0.2), 0.0), 1.0), 2), label))
    return rows


@pytest.fixture(scope="module")
def data():
    return sample()


@pytest.fixture(scope="module")
def scored(spark, data):
    return spark.createDataFrame(data, "risk_score double, is_laundering int").cache()


def brute_curve(data):
    total = sum(y for _, y in data)
    out = {}
    for t in {s for s, _ in data}:
        tp = sum(y for s, y in data if s >= t)
        fp = sum(1 - y for s, y in data if s >= t)
        p, r = tp / (tp + fp), tp / total
        out[t] = (tp, fp, p, r, 2 * p * r / (p + r + 1e-8))
    return out


def test_curve_equals_brute_force(scored, data):
    mine = {
        r.threshold: (r.tp, r.fp, r.precision, r.recall, r.f1)
        for r in evaluation.precision_recall_curve(scored).collect()
    }
    assert mine == {t: pytest.approx(v) for t, v in brute_curve(data).items()}


def test_best_f1_takes_the_lowest_of_equal_thresholds(spark, scored, data):
    best = evaluation.best_f1(evaluation.precision_recall_curve(scored)).first()
    assert best.f1 == pytest.approx(max(v[4] for v in brute_curve(data).values()))
    tied = spark.createDataFrame([(0.5, 10, 0.4), (0.3, 12, 0.4)], "threshold double, tp long, f1 double")
    assert evaluation.best_f1(tied).first().threshold == 0.3


def test_roc_area_equals_spark_ml_and_ap_is_step_wise(scored, data):
    mine = evaluation.ranking_quality(scored).first()
    judge = BinaryClassificationEvaluator(rawPredictionCol="risk_score", labelCol="is_laundering", numBins=0)
    assert mine.roc_auc == pytest.approx(judge.evaluate(scored), abs=1e-7)
    curve = sorted(brute_curve(data).items(), reverse=True)
    recall, area = 0.0, 0.0
    for _, (_, _, p, r, _) in curve:
        area, recall = area + (r - recall) * p, r
    assert mine.average_precision == pytest.approx(area, abs=1e-7)


@pytest.mark.parametrize("ranges", [None, 1, 7, 50])
def test_running_totals_do_not_depend_on_the_ranges(scored, ranges):
    table = evaluation.threshold_table(scored)
    stored = materialize(evaluation.in_ranges(table, ranges), "test-ranges")
    tp = fp = 0
    expected = []
    for row in sorted(table.collect(), key=lambda r: -r.threshold):
        tp, fp = tp + row.pos, fp + row.neg
        expected.append((row.threshold, row.pos, row.neg, tp, fp))
    assert rows_of(evaluation.running_counts(stored)) == sorted(expected, key=repr)


def test_raw_scores_are_not_merged(spark):
    rows = spark.createDataFrame([(0.10001, 1), (0.10002, 0)], "risk_score double, is_laundering int")
    assert evaluation.ranking_quality(rows).first().roc_auc == 0.5
    assert evaluation.ranking_quality(rows, digits=None).first().roc_auc == 0.0


def test_one_class_gives_null_not_an_error(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 0)], "risk_score double, is_laundering int")
    quality = evaluation.ranking_quality(rows).first()
    assert quality.roc_auc is None and quality.average_precision is None
    counts = evaluation.confusion(rows, 0.5).first()
    assert (counts.tp, counts.fp, counts.fn, counts.tn) == (0, 0, 0, 2)
    assert (counts.precision, counts.recall, counts.f1) == (0.0, 0.0, 0.0)


def test_threshold_search_falls_back_to_best_f1(scored):
    curve = evaluation.precision_recall_curve(scored)
    best = evaluation.best_f1(curve).first().threshold
    fallback = evaluation.thresholds_meeting(curve, 0.99, 0.99).collect()
    assert [(r.threshold, r.meets_both) for r in fallback] == [(best, 0)]
    met = evaluation.thresholds_meeting(curve, 0.2, 0.2).collect()
    assert met and all(r.meets_both == 1 and r.recall >= 0.2 and r.precision >= 0.2 for r in met)


def test_calibration_edges(spark):
    rows = spark.createDataFrame([(s, 0) for s in (0.0, 0.3, 0.6, 0.7, 0.95, 1.0)], "risk_score double, is_laundering int")
    ours = {r.bin: r.n for r in evaluation.calibration(rows).collect()}
    assert ours == {0: 1, 3: 1, 6: 1, 7: 1, 9: 2}
    binary = {r.bin: r.n for r in evaluation.calibration(rows, binary_edges=True).collect()}
    assert binary == {0: 1, 2: 1, 5: 1, 6: 1, 9: 1}


def test_histograms_keep_every_row(scored, data):
    assert sum(r.n for r in evaluation.score_density(scored).collect()) == len(data)
    assert sum(r.n for r in evaluation.calibration(scored).collect()) == len(data)


def test_score_summary_median(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.9, 0), (0.86, 1)], "risk_score double, is_laundering int")
    found = {r.is_laundering: r for r in evaluation.score_summary(rows).collect()}
    assert (found[0].median_score, found[0].n_above_50, found[0].n_above_85) == (0.2, 1, 1)
    assert found[1].mean_score == 0.86


@pytest.mark.parametrize("difference,band", [(0.06, "significant"), (0.05, "minor"), (0.02, "minor"), (0.01, "minimal")])
def test_ablation_bands(spark, difference, band):
    assert spark.range(1).select(evaluation.ablation_band(F.lit(difference))).first()[0] == band


def test_case_types_at_the_threshold(spark):
    rows = spark.createDataFrame(
        [(0.8514, 1), (0.8514, 0), (0.8513, 1), (0.0, 0), (1.0, 1)], "risk_score double, is_laundering int"
    )
    kinds = [r.case_type for r in evaluation.with_case_type(rows).collect()]
    assert kinds == ["TP", "FP", "FN", "TN", "TP"]


def test_top_driver_counts(spark):
    rows = spark.createDataFrame(
        [([("a", 1.0, "increases")],), ([("a", 2.0, "increases")],), ([("b", 1.0, "increases")],)],
        "drivers array<struct<feature string, shap_val double, direction string>>",
    )
    assert [tuple(r) for r in cases.top_driver_counts(rows).collect()] == [("a", 2), ("b", 1)]
