import glob
import time
from pathlib import Path

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.plans import training
from txrisk.plans.tree_attribution import model_nodes, with_tree_drivers
from txrisk.session import materialize, work_folder
from txrisk.sources.writers import write_csv
from txrisk.sources.warehouse import payments

TINY = training.Settings(boosted_depth=3, boosted_rounds=3, forest_trees=3, forest_depth=3)


@pytest.fixture(scope="module")
def data(spark, folder):
    return training.prepare(payments(spark, folder), TINY)


@pytest.fixture(scope="module")
def model(data):
    return training.train_ensemble(data, TINY)


def test_prepared_tables(data):
    assert data.train.where("weight IS NULL OR weight <= 0").count() == 0
    assert 0.1 < data.validation.count() / data.train.count() < 0.3
    last = data.train.agg(F.max("ts")).first()[0]
    assert data.test.where(F.col("ts") <= F.lit(last)).count() == 0


def test_weights_and_scores(data, model):
    assert model.boosted_weight + model.forest_weight == pytest.approx(1.0)
    scored = training.score_ensemble(data.test, model)
    assert scored.count() == data.test.count()
    assert scored.where("risk_score < 0 OR risk_score > 1").count() == 0
    row = training.evaluation_report(scored, model).first()
    assert row.tp + row.fp + row.fn + row.tn == data.test.count()
    assert row.threshold == model.threshold


def test_saved_model_scores_alike(spark, data, model, tmp_path):
    training.save_ensemble(spark, model, str(tmp_path / "m"))
    loaded = training.load_ensemble(spark, str(tmp_path / "m"))
    assert loaded.features == fv.FEATURES and loaded.threshold == model.threshold
    one, two = (
        training.score_ensemble(data.test, m).agg(F.sum("risk_score")).first()[0] for m in (model, loaded)
    )
    assert one == pytest.approx(two)


def test_importance(spark, model, tmp_path):
    table = training.importance_table(spark, model)
    rows = table.collect()
    assert len(rows) == 18 and sum(r.avg_importance for r in rows) == pytest.approx(1.0)
    assert [r.avg_importance for r in rows] == sorted((r.avg_importance for r in rows), reverse=True)
    write_csv(table, str(tmp_path / "importance"))


def test_audit_reports_both_runs(data):
    row = training.ablation_audit(data, "bank_risk_score", TINY).first()
    assert row.ap_difference == pytest.approx(row.ap_with - row.ap_without, abs=1e-6)
    assert row.leakage in ("significant", "minor", "minimal")


def test_tree_credits_add_up_to_the_raw_score(spark, data, model):
    """Also checks the walk itself: a wrong turn would break the sum."""
    boosted = model.boosted
    rows = boosted.transform(data.test)
    explained = with_tree_drivers(rows, model_nodes(spark, boosted.stages[-1]), model.features)
    total = F.aggregate("credits", F.lit(0.0), lambda a, c: a + c)
    gap = F.abs(total - vector_to_array("rawPrediction")[1])
    worst = explained.agg(F.max(gap), F.count(F.lit(1)), F.min(F.size("drivers"))).first()
    assert worst[0] < 1e-9 and worst[1] == data.test.count() and worst[2] == 5


def test_combine_importance(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "feature string, boosted double")
    b = spark.createDataFrame([("x", 50.0), ("y", 50.0)], "feature string, forest double")
    assert [(r.feature, r.avg_importance) for r in training.combine_importance(a, b).collect()] == [
        ("y", 0.625),
        ("x", 0.375),
    ]


def test_prepare_stores_train_once_and_test_when_it_is_read(spark, folder):
    stored = lambda: {p.name.rsplit("-", 1)[0] for p in set(work.iterdir()) - before}
    work = Path(work_folder(spark).removeprefix("file:")) / "txrisk"
    materialize(spark.range(1), "one")
    before = set(work.iterdir())
    data = training.prepare(payments(spark, folder), TINY)
    assert "train" in stored() and not {"train-weighted", "test"} & stored()
    assert data.test.count() == data.test.count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(work.iterdir()) - before].count("test") == 1


def test_stored_steps_leave_no_shuffled_files(spark):
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key)
    stored = materialize(spark.range(1000).repartition(5, "id"), "rows")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(key) == setting and stored.count() == 1000
