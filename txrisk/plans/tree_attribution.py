"""Attribution of boosted-tree scores to features.

``shapley_values`` gives the Shapley values of a tree ensemble, the value of a set of
features being the mean over each tree's training rows with these features held (unknown
ones follow both sides of a split by their share of rows). A leaf is reached through few
features; its part of the sum over all subsets is a product of linear terms, one per
feature, whose coefficients the Shapley weights weigh.

``path_credits`` is another, cheaper quantity. On the way from the root to a leaf every split moves the prediction of a tree;
that move is credited to the split's feature. The credits of a row and the bias
add up exactly to the raw score of the model. Spark ML has no such operator, so a
vectorised pandas function walks the trees; ranking stays in SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.scorecard import top_drivers
from txrisk.session import new_path, ship_modules


def model_nodes(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """The nodes of all trees, as the model stores them: one row per node."""
    path = new_path(spark, "tree-model")
    model.write().overwrite().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "tree_weight")
    nodes = spark.read.parquet(f"{path}/data")
    return nodes.join(weights.select("treeID", "tree_weight"), "treeID").select(
        "treeID",
        "tree_weight",
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.get("nodeData.impurityStats", F.lit(0)).alias("cover"),
    )


def _load_trees(nodes: DataFrame) -> list[tuple]:
    # The size of a model is set by its number of trees and their depth.
    table = nodes.toPandas().sort_values(["treeID", "node"])
    return [
        (
            float(tree["tree_weight"].iloc[0]),
            *(tree[c].to_numpy() for c in ("left", "right", "feature", "cut", "value")),
        )
        for _, tree in table.groupby("treeID")
    ]


def _credit(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Credits per row and feature, and the bias in the last column."""
    credit = np.zeros((len(x), x.shape[1] + 1))
    for weight, left, right, feature, cut, value in trees:
        at = np.zeros(len(x), dtype=int)
        credit[:, -1] += weight * value[0]
        rows = np.flatnonzero(left[at] >= 0)
        while len(rows):
            here = at[rows]
            split = feature[here]
            there = np.where(x[rows, split] <= cut[here], left[here], right[here])
            credit[rows, split] += weight * (value[there] - value[here])
            at[rows] = there
            rows = rows[left[there] >= 0]
    return credit


def path_credits(nodes: DataFrame, features: list[str]) -> Column:
    """Array column: one credit per feature, then the bias."""
    trees = _load_trees(nodes)

    @F.pandas_udf("array<double>")
    def credits(values: pd.DataFrame) -> pd.Series:
        found = _credit(values.to_numpy(dtype=float), trees)
        return pd.Series(list(found))

    return credits(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))


#: Features of one leaf up to which its values for every pattern are tabulated beforehand.
TABLED = 8


def leaf_values(held: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 for each row and feature on its path.

    ``held`` says whether the row meets the leaf's conditions on the feature, ``shares``
    which part of the rows does so when the feature is unknown. The product of
    (share + held * t) over the other features has, at t ** k, the sum over subsets of k
    features; the weight of such a subset is k! (m - 1 - k)! / m!.
    """
    rows, m = held.shape
    weights = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    found = np.empty((rows, m))
    for i in range(m):
        product = np.zeros((rows, m))
        product[:, 0] = 1.0
        for j in range(m):
            if j != i:
                longer = product * shares[j]
                longer[:, 1:] += product[:, :-1] * held[:, j : j + 1]
                product = longer
        found[:, i] = (held[:, i] - shares[i]) * (product @ weights)
    return found


class ShapleyTree:
    """One tree as its leaves: path conditions by feature, shares of rows, values."""

    def __init__(self, weight: float, left, right, feature, cut, value, cover):
        self.cut, self.feature = cut, feature
        self.splits = np.flatnonzero(left >= 0)
        self.leaves, self.bias = [], 0.0
        stack = [(0, {}, {})]
        while stack:
            node, conditions, shares = stack.pop()
            if left[node] < 0:
                names = sorted(conditions)
                share = np.array([shares[f] for f in names])
                worth = weight * float(value[node])
                self.bias += worth * float(np.prod(share))
                if names and worth:
                    self.leaves.append((names, [conditions[f] for f in names], share, worth, self._table(share, worth)))
                continue
            for child, goes_left in ((left[node], True), (right[node], False)):
                f = int(feature[node])
                part = float(cover[child]) / float(cover[node]) if cover[node] else 0.0
                stack.append(
                    (child, {**conditions, f: [*conditions.get(f, []), (node, goes_left)]}, {**shares, f: shares.get(f, 1.0) * part})
                )

    @staticmethod
    def _table(share: np.ndarray, worth: float) -> np.ndarray | None:
        m = len(share)
        if m > TABLED:
            return None
        patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        return worth * leaf_values(patterns, share)

    def add_to(self, credit: np.ndarray, x: np.ndarray) -> None:
        lefts = {node: x[:, self.feature[node]] <= self.cut[node] for node in self.splits.tolist()}
        credit[:, -1] += self.bias
        for names, conditions, share, worth, table in self.leaves:
            held = np.ones((len(names), len(x)), dtype=bool)
            for j, path in enumerate(conditions):
                for node, goes_left in path:
                    held[j] &= lefts[node] == goes_left
            if table is None:
                credit[:, names] += worth * leaf_values(held.T.astype(float), share)
            else:
                credit[:, names] += table[(held << np.arange(len(names))[:, None]).sum(axis=0)]


def shapley_values(nodes: DataFrame, features: list[str]) -> Column:
    """Array column: the Shapley value of each feature, then the expected raw score."""
    # The size of a model is set by its number of trees and their leaves.
    table = nodes.toPandas().sort_values(["treeID", "node"])
    trees = [
        (float(tree["tree_weight"].iloc[0]), *(tree[c].to_numpy() for c in ("left", "right", "feature", "cut", "value", "cover")))
        for _, tree in table.groupby("treeID")
    ]

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        prepared = [ShapleyTree(*tree) for tree in trees]
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            credit = np.zeros((len(x), x.shape[1] + 1))
            for tree in prepared:
                tree.add_to(credit, x)
            yield pd.Series(list(credit))

    return values(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))


def with_tree_drivers(
    rows: DataFrame, nodes: DataFrame, features: list[str], n: int = 5, credits=shapley_values
) -> DataFrame:
    """Adds ``credits`` and the ``n`` strongest ``drivers`` of the boosted model; by Shapley
    values, unless ``path_credits`` is asked for."""
    ship_modules(rows.sparkSession)
    credited = rows.withColumn("credits", credits(nodes, features))
    parts = {name: F.col("credits")[i] for i, name in enumerate(features)}
    return credited.withColumn("drivers", top_drivers(parts, n))
