"""Frequent join keys: found by a bounded sketch, joined under explicit sub-keys.

A key that holds a large share of the rows would send them all to one task. Such keys are
found in one pass over the rows that will be joined, by Spark's top-k sketch, whose size
is fixed whatever the table holds. Their rows then carry a sub-key, an even number taken
from the rest of the row, and the other side repeats the few rows of these keys once per
sub-key. Rows without a key match nothing, so they are spread over the sub-keys as well.

The join stays an equality join of two columns, so it works the same way in a batch, where
adaptive execution need not notice anything, and in a stream, where it does not act.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with this share of the rows is frequent; at most 1 / share keys can be.
SHARE = 0.01
#: Keys that the sketch follows. Its counts are off by less than the rows divided by this.
TRACKED = 10_000
#: Sub-keys of a frequent key.
SUBKEYS = 64
SUB = "_sub"


@dataclass(frozen=True)
class HotKeys:
    """Frequent values by column, and the number of sub-keys that each of them gets."""

    values: dict[str, tuple] = field(default_factory=dict)
    subkeys: int = SUBKEYS

    def of(self, keys: list[str]) -> dict[str, tuple]:
        return {key: self.values[key] for key in keys if self.values.get(key)}


def find_hot_keys(
    rows: DataFrame, keys: list[str], share: float = SHARE, tracked: int = TRACKED, subkeys: int = SUBKEYS
) -> HotKeys:
    """One pass over the key columns of ``rows``.

    Every value with at least ``share`` of the rows is found, as the sketch's error is
    below half of it; the driver receives at most 2 / share values for each column.
    """
    if share * tracked < 2:
        raise ValueError("the sketch must follow at least 2 / share keys")
    limit = int(2 / share)
    sketches = [F.expr(f"approx_top_k(`{key}`, {limit}, {tracked})").alias(key) for key in keys]
    found = rows.agg(F.count(F.lit(1)).alias("_n"), *sketches).first()
    least = found["_n"] * share / 2

    def frequent(pairs) -> tuple:
        return tuple(sorted(p["item"] for p in pairs or [] if p["item"] is not None and p["count"] >= least))

    return HotKeys({key: frequent(found[key]) for key in keys}, subkeys)


def _is_hot(keys: list[str], hot: HotKeys) -> Column:
    """Whether the row is spread: each key it is joined on is frequent, or one is missing."""
    missing = F.lit(False)
    frequent = F.lit(True)
    for key in keys:
        missing = missing | F.col(key).isNull()
        frequent = frequent & F.col(key).isin(list(hot.values.get(key, ())))
    return missing | frequent


def with_subkey(rows: DataFrame, keys: list[str], hot: HotKeys, spread_by: list[str]) -> DataFrame:
    """Rows with a sub-key: 0, or for frequent and missing keys an even number from ``spread_by``."""
    number = F.pmod(F.xxhash64(*spread_by), F.lit(hot.subkeys)).cast("int")
    return rows.withColumn(SUB, F.when(_is_hot(keys, hot), number).otherwise(F.lit(0)))


def repeat_hot(table: DataFrame, keys: list[str], hot: HotKeys) -> DataFrame:
    """The other side of the join: a row of a frequent key once per sub-key."""
    known = table.where(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))
    every = F.sequence(F.lit(0), F.lit(hot.subkeys - 1))
    return known.withColumn(SUB, F.explode(F.when(_is_hot(keys, hot), every).otherwise(F.array(F.lit(0)))))


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], hot: HotKeys, spread_by: list[str]) -> DataFrame:
    """Left join of ``rows`` with a table of one row per key, frequent keys split."""
    left = with_subkey(rows, keys, hot, spread_by)
    return left.join(repeat_hot(table, keys, hot), [*keys, SUB], "left").drop(SUB)
