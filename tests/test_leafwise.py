"""Trees grown leaf by leaf against a plain computation on the same bins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from txrisk.plans import leafwise, training
from txrisk.plans.leafwise import LeafwiseSettings
from txrisk.operators import evaluation
from txrisk.session import materialize
from txrisk.sources.warehouse import payments

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 6, 600), rng.normal(size=600).round(1), np.ones(600)])
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 3 + 2 * (x[:, 1] > 0.4))))).astype(int)
    data = [(float(a) if k % 50 else None, float(b), float(c), int(l), 1.0 + (k % 3), k % 5 == 0) for k, ((a, b, c), l) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "a double, b double, c double, is_laundering int, weight double, is_validation boolean").repartition(4)


def plain_tree(bins, g, h, settings):
    """Best-first growth, one leaf at a time, straight from the rows."""
    leaves = [np.arange(len(g))]

    def best(members):
        found = (settings.least_gain, None)
        worth = lambda some: g[some].sum() ** 2 / (h[some].sum() + settings.shrinkage)
        for f in range(bins.shape[1]):
            for upto in range(bins[:, f].max()):
                left, right = members[bins[members, f] <= upto], members[bins[members, f] > upto]
                if h[left].sum() >= settings.least_weight and h[right].sum() >= settings.least_weight:
                    gain = worth(left) + worth(right) - worth(members)
                    if gain > found[0] + 1e-12:
                        found = (gain, (left, right))
        return found

    while len(leaves) < settings.leaves:
        gains = [best(members) for members in leaves]
        at = max(range(len(leaves)), key=lambda k: gains[k][0] if gains[k][1] else -1)
        if not gains[at][1]:
            break
        leaves[at : at + 1] = gains[at][1]
    return sorted((len(m), round(-settings.rate * g[m].sum() / (h[m].sum() + settings.shrinkage), 9)) for m in leaves)


@pytest.mark.parametrize("leaves", [2, 7, 31])
def test_a_tree_equals_plain_best_first_growth(rows, leaves):
    settings = LeafwiseSettings(leaves=leaves, rounds=1, rate=0.3, bins=16)
    model = leafwise.train(rows, FEATURES, settings)
    known = rows.where("NOT is_validation")
    cuts = leafwise.cut_points(known, FEATURES, settings.bins)
    table = leafwise.with_bins(known, FEATURES, cuts).select("bins", "is_laundering", "weight").collect()
    bins, y, w = np.array([r.bins for r in table]), np.array([r.is_laundering for r in table]), np.array([r.weight for r in table])
    p = 1 / (1 + math.exp(-model.start))
    mine = sorted((int(n[-1]), round(n[1], 9)) for n in model.trees[0] if n[2] < 0)
    assert mine == plain_tree(bins, w * (p - y), w * p * (1 - p), settings)


def test_scores_from_features_equal_scores_from_bins(spark, rows):
    settings = LeafwiseSettings(leaves=8, rounds=5, bins=16)
    model = leafwise.train(rows, FEATURES, settings)
    scored = leafwise.add_probability(rows, model, "p").collect()
    fit = [r for r in scored if r.is_validation]
    loss = sum(-r.weight * math.log(r.p if r.is_laundering else 1 - r.p) for r in fit) / sum(r.weight for r in fit)
    assert loss == pytest.approx(model.losses[-1], abs=1e-9)
    assert all(a > b for a, b in zip(model.losses, model.losses[1:]))
    assert model.nodes(spark).where("`left` < 0").groupBy("treeID").agg(F.sum("cover").alias("n")).select("n").distinct().collect()[0].n == sum(not r.is_validation for r in scored)


def test_training_stops_and_needs_both_classes(rows):
    noise = rows.withColumn("a", F.rand(1)).withColumn("b", F.rand(2)).withColumn("is_laundering", (F.rand(3) < 0.5).cast("int"))
    model = leafwise.train(materialize(noise, "noise"), FEATURES, LeafwiseSettings(leaves=31, rounds=40, rate=0.5, patience=2))
    assert len(model.trees) < 40 and len(model.trees) == len(model.losses)
    with pytest.raises(ValueError):
        leafwise.train(rows.where("is_laundering = 0"), FEATURES)


def test_cuts_of_constant_few_many_and_missing_values(spark):
    rows = spark.createDataFrame([(float(k % 3), float(k), 1.0, None) for k in range(500)], "few double, many double, one double, none double")
    few, many, one, none = leafwise.cut_points(rows, ["few", "many", "one", "none"], 16)
    assert few == [0.5, 1.5] and one == [] and none == [] and 8 <= len(many) <= 15
    binned = leafwise.with_bins(rows, ["few", "none"], [few, none])
    assert {tuple(r.bins) for r in binned.collect()} == {(0, 0), (1, 0), (2, 0)}
    assert rows_of(binned.select(rows.columns)) == rows_of(rows)


def test_quality_is_near_the_forests(spark, folder):
    settings = training.Settings(forest_trees=20, forest_depth=6)
    data = training.prepare(payments(spark, folder), settings)
    model = leafwise.train(data.train, settings=LeafwiseSettings(leaves=8, rounds=12, rate=0.2))
    forest = training.random_forest(training.fv.FEATURES, settings).fit(data.train.where("NOT is_validation"))
    scored = leafwise.add_probability(training.add_probability(data.test, forest, "p_forest"), model, "p_leafwise")
    scored = materialize(scored.select("is_laundering", "p_forest", "p_leafwise"), "both-scores")
    ap = {c: evaluation.ranking_quality(scored, c, digits=None).first()["average_precision"] for c in ("p_forest", "p_leafwise")}
    assert ap["p_leafwise"] >= 0.9 * ap["p_forest"]
