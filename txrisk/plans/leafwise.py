"""Boosted trees grown leaf by leaf on histograms.

Features are cut into bins once and stored. A tree is grown best first: of all leaves the
one whose best split gains most is split next. What a split gains follows from sums of
gradients by (leaf, feature, bin), which Spark adds up in one aggregation over the stored
bins; the driver sees these sums only, a table of leaves x features x bins. One pass also
adds up the children of every split that may come next, so best-first growth of thirty
leaves takes about as many passes as the tree is deep.

Rows carry their score so far. It is written after each tree, so lineage does not grow.
Trees have the same node table as ``tree_attribution`` reads, so Shapley values and path
credits work for them too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.operators.profiles import LABEL
from txrisk.session import materialize, ship_modules

NODE_SCHEMA = (
    "treeID int, tree_weight double, node int, value double, `left` int, `right` int, feature int, cut double, cover double"
)


@dataclass(frozen=True)
class LeafwiseSettings:
    leaves: int = 31
    rounds: int = 200
    rate: float = 0.05
    bins: int = 64
    shrinkage: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 1e-6
    patience: int = 10


@dataclass
class Node:
    """A node of a growing tree; ``path`` are (feature, bin, goes left) from the root."""

    number: int
    path: list[tuple[int, int, bool]]
    sums: np.ndarray
    histogram: np.ndarray | None = None
    split: tuple[float, int, int] | None = None
    left: int = -1
    right: int = -1


@dataclass(frozen=True)
class LeafwiseModel:
    features: list[str]
    start: float
    trees: list[list[tuple]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(k, 1.0, *node) for k, tree in enumerate(self.trees) for node in tree]
        return spark.createDataFrame(rows, NODE_SCHEMA)


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Cuts per feature: between all its values if they are few, else at quantiles.

    The driver receives at most ``bins`` values for each feature.
    """
    few = rows.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    cuts = []
    for f in features:
        values: list[float] = []
        if few[f] <= 2 * bins:
            found = rows.select(F.col(f).cast("double").alias("v")).where("v IS NOT NULL").distinct().limit(bins + 1).collect()
            values = sorted(r.v for r in found) if len(found) <= bins else []
        if not values:
            shares = [k / bins for k in range(1, bins)]
            values = sorted(set(rows.approxQuantile(f, shares, 0.1 / bins)))
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:])])
    return cuts


def with_bins(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    """Adds ``bins``: for each feature the number of its cuts at or below the value. A missing
    value goes to the first bin."""
    cut = {k: points for k, points in enumerate(cuts) if points}
    inputs, outputs = [f"_in{k}" for k in cut], [f"_bin{k}" for k in cut]
    binned = rows.withColumns({f"_in{k}": F.coalesce(F.col(features[k]).cast("double"), F.lit(-math.inf)) for k in cut})
    if cut:
        splits = [[-math.inf, *points, math.inf] for points in cut.values()]
        binned = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=outputs, handleInvalid="keep").transform(binned)
    bins = [F.col(f"_bin{k}").cast("int") if k in cut else F.lit(0) for k in range(len(features))]
    return binned.withColumn("bins", F.array(*bins)).drop(*inputs, *outputs)


def histograms(rows: DataFrame, leaf: Column, *sums: Column) -> DataFrame:
    """Sums by leaf, feature and bin; combined in each task before they are shuffled. Rows
    whose leaf is null take no part."""
    placed = rows.withColumn("leaf", leaf).where("leaf IS NOT NULL")
    return placed.select("*", F.posexplode("bins").alias("feature", "bin")).groupBy("leaf", "feature", "bin").agg(*sums)


def _condition(path: list[tuple[int, int, bool]]) -> Column:
    met = F.lit(True)
    for feature, upto, goes_left in path:
        side = F.get("bins", F.lit(feature)) <= upto
        met = met & (side if goes_left else ~side)
    return met


class _Tree:
    def __init__(self, rows: DataFrame, sizes: list[int], settings: LeafwiseSettings):
        self.rows, self.sizes, self.settings = rows, sizes, settings
        root = Node(0, [], np.zeros(3))
        self.nodes: dict[int, Node] = {0: root}
        self._measure([root])
        root.sums = root.histogram[0].sum(axis=0)
        self._choose(root)

    def _measure(self, wanted: list[Node]) -> None:
        leaf = F
        for node in wanted:
            leaf = leaf.when(_condition(node.path), node.number)
        sums = [F.sum(c).alias(c) for c in ("g", "h")] + [F.count(F.lit(1)).cast("double").alias("n")]
        for node in wanted:
            node.histogram = np.zeros((len(self.sizes), max(self.sizes), 3))
        for r in histograms(self.rows, leaf, *sums).collect():
            self.nodes[r.leaf].histogram[r.feature, r.bin] = (r.g, r.h, r.n)

    def _choose(self, node: Node) -> None:
        """The best split of a node whose sums are known: gain, feature, last bin on the left."""
        s, h = self.settings, node.histogram
        total = h[0].sum(axis=0)
        left = np.cumsum(h, axis=1)[:, :-1]
        right = total - left

        def worth(part: np.ndarray) -> np.ndarray:
            return part[..., 0] ** 2 / (part[..., 1] + s.shrinkage)

        gain = worth(left) + worth(right) - worth(total)
        gain[(left[..., 1] < s.least_weight) | (right[..., 1] < s.least_weight)] = -np.inf
        if gain.size and gain.max() > s.least_gain:
            feature, upto = np.unravel_index(int(gain.argmax()), gain.shape)
            node.split = (float(gain[feature, upto]), int(feature), int(upto))

    def _children(self, node: Node) -> list[Node]:
        if node.left < 0:
            _, feature, upto = node.split
            sums = node.histogram[feature, : upto + 1].sum(axis=0)
            for goes_left, part in ((True, sums), (False, node.histogram[0].sum(axis=0) - sums)):
                child = Node(len(self.nodes), [*node.path, (feature, upto, goes_left)], part)
                self.nodes[child.number] = child
                if goes_left:
                    node.left = child.number
                else:
                    node.right = child.number
        return [self.nodes[node.left], self.nodes[node.right]]

    def grow(self) -> set[int]:
        """Best first until there are enough leaves; the nodes that were split."""
        leaves, done = {0}, set()
        while len(leaves) < self.settings.leaves:
            open_ = [self.nodes[k] for k in leaves if self.nodes[k].split]
            if not open_:
                break
            best = max(open_, key=lambda node: (node.split[0], -node.number))
            if any(child.histogram is None for child in self._children(best)):
                # one pass for the children of every split that may come soon
                open_.sort(key=lambda node: -node.split[0])
                missing = [c for node in open_[: self.settings.leaves - len(leaves)] for c in self._children(node) if c.histogram is None]
                self._measure(missing)
                for child in missing:
                    self._choose(child)
            done.add(best.number)
            leaves = leaves - {best.number} | {best.left, best.right}
        return done

    def table(self, done: set[int], cuts: list[list[float]]) -> list[tuple]:
        """(node, value, left, right, feature, cut, cover), nodes numbered from the root."""
        number, order = {}, [0]
        for at in order:
            number[at] = len(number)
            if at in done:
                order += [self.nodes[at].left, self.nodes[at].right]
        rows = []
        for at in order:
            node = self.nodes[at]
            g, h, n = node.sums
            value = float(-self.settings.rate * g / (h + self.settings.shrinkage))
            if at in done:
                _, feature, upto = node.split
                below = float(np.nextafter(cuts[feature][upto], -np.inf))  # a value at the cut goes right
                rows.append((number[at], value, number[node.left], number[node.right], feature, below, float(n)))
            else:
                rows.append((number[at], value, -1, -1, -1, 0.0, float(n)))
        return rows

    def score(self, done: set[int]) -> Column:
        """The value of a row's leaf, from its bins."""

        def of(at: int) -> Column:
            node = self.nodes[at]
            if at not in done:
                g, h, _ = node.sums
                return F.lit(float(-self.settings.rate * g / (h + self.settings.shrinkage)))
            _, feature, upto = node.split
            return F.when(F.get("bins", F.lit(feature)) <= upto, of(node.left)).otherwise(of(node.right))

        return of(0)


def train(
    rows: DataFrame, features: list[str] = fv.FEATURES, settings: LeafwiseSettings = LeafwiseSettings(), weight: str = "weight"
) -> LeafwiseModel:
    """Boost on the rows whose ``is_validation`` is false; stop when the loss of the others
    no longer falls. Rows without a label are left out."""
    known = rows.where(F.col(LABEL).isNotNull())
    fit_rows = known.where("NOT is_validation")
    cuts = cut_points(fit_rows, features, settings.bins)
    base = fit_rows.agg(F.sum(F.col(weight) * F.col(LABEL)).alias("p"), F.sum(weight).alias("w")).first()
    if not base.w or not 0 < base.p < base.w:
        raise ValueError("training needs rows of both classes")
    start = math.log(base.p / (base.w - base.p))
    kept = with_bins(known, features, cuts).select("bins", F.col(LABEL).alias("y"), F.col(weight).alias("w"), "is_validation")
    current = materialize(kept.withColumn("score", F.lit(start)), "leafwise-rows")
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    trees: list[list[tuple]] = []
    losses: list[float] = []
    sizes = [len(points) + 1 for points in cuts]
    for _ in range(settings.rounds):
        slopes = current.where("NOT is_validation").withColumns(
            {"g": F.col("w") * (chance - F.col("y")), "h": F.col("w") * chance * (1 - chance)}
        )
        tree = _Tree(slopes, sizes, settings)
        done = tree.grow()
        if not done:
            break
        current = materialize(current.withColumn("score", F.col("score") + tree.score(done)), "leafwise-rows")
        trees.append(tree.table(done, cuts))
        held = F.greatest(chance, F.lit(1e-15)), F.greatest(1 - chance, F.lit(1e-15))
        loss = -F.col("w") * (F.col("y") * F.log(held[0]) + (1 - F.col("y")) * F.log(held[1]))
        side = current.where("is_validation").agg(F.sum(loss) / F.sum("w")).first()[0]
        losses.append(float(side) if side is not None else float("nan"))
        best = int(np.nanargmin(losses)) if not all(map(math.isnan, losses)) else len(losses) - 1
        if len(losses) - 1 - best >= settings.patience:
            trees, losses = trees[: best + 1], losses[: best + 1]
            break
    return LeafwiseModel(list(features), start, trees, losses)


def raw_score(model: LeafwiseModel) -> Column:
    """Score of a row before the logistic curve; missing values go left."""
    trees = [tuple(np.array(c) for c in zip(*tree)) for tree in model.trees]
    start = model.start

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.nan_to_num(batch.to_numpy(dtype=float), nan=-np.inf)
            total = np.full(len(x), start)
            for _, value, left, right, feature, cut, _ in trees:
                at = np.zeros(len(x), dtype=int)
                rows = np.flatnonzero(left[at] >= 0)
                while len(rows):
                    here = at[rows]
                    at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
                    rows = rows[left[at[rows]] >= 0]
                total += value[at]
            yield pd.Series(total)

    return score(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))


def add_probability(rows: DataFrame, model: LeafwiseModel, name: str) -> DataFrame:
    ship_modules(rows.sparkSession)
    scored = rows.withColumn("_raw", raw_score(model))
    return scored.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_raw")))).drop("_raw")
