"""Payments stored in buckets of their end points, so that history joins leave them in place.

Every history value of a payment depends on its sender, receiver and bank only. The store
keeps the payments clustered by these three. To attach history, the distinct end points of
the store, a narrow table that is read off the buckets without a shuffle, go through the
joins with the history tables; they come back to the buckets in one narrow shuffle and
meet the payments where they lie. The wide rows are not moved, whatever is broadcast.

End points that hold a large share of all payments are split over sub-keys when they are
stored; frequent accounts in the narrow joins are split by ``hot_keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators.history import History, attach_history, hot_keys_of
from txrisk.operators.hot_keys import SUB, find_hot_keys, with_subkey
from txrisk.sources.bucketed import BucketedTable, Commits

ENDS = ["from_account", "to_account", "from_bank"]
KEY, PIECE = "_ends", "_ends_piece"
BUCKETS = 64


def ends_key(columns: list[str] = ENDS) -> Column:
    """One text for the end points; a length before each value keeps texts apart, and a
    missing value differs from every text."""

    def part(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*[part(name) for name in columns])


class PaymentStore:
    """Payments in a shared folder, added in named batches; a batch added again is ignored."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")
        rows = self.commits.rows()
        self.table: BucketedTable | None = None
        self.buckets = buckets
        if rows:
            count, columns = rows[0].note.split("|", 1)
            self.buckets = int(count)
            self._declare(columns)

    def _declare(self, columns: str) -> None:
        self.table = BucketedTable(
            self.spark, f"{self.path}/payments", f"{columns}, {KEY} STRING, {PIECE} INT", [KEY, PIECE], self.buckets
        )

    def add(self, name: str, tx: DataFrame) -> bool:
        rows = self.commits.rows()
        if any(row.name == name for row in rows):
            return False
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tx.schema.fields)
        if self.table is None:
            self._declare(columns)
        part = 1 + max([row.part for row in rows] + [self.table.last_part()])
        keyed = tx.withColumn(KEY, ends_key())
        hot = find_hot_keys(keyed, [KEY])
        self.table.write_part(with_subkey(keyed, [KEY], hot, tx.columns).withColumnRenamed(SUB, PIECE), part)
        self.commits.add(part, name, note=f"{self.buckets}|{columns}")
        return True

    def _stored(self) -> DataFrame:
        if self.table is None:
            raise ValueError("the store holds no payments yet")
        return self.table.read(Commits.valid(self.commits.rows()))

    def payments(self) -> DataFrame:
        return self._stored().drop(KEY, PIECE)

    def end_points(self) -> DataFrame:
        """Distinct end points with their keys; added up inside the buckets."""
        return self._stored().select(KEY, PIECE, *ENDS).distinct()

    def with_history(self, history: History) -> DataFrame:
        """The stored payments with the columns of ``attach_history``."""
        ends = self.end_points()
        known = attach_history(ends, history, hot_keys_of(ends, tuple(history.parts())))
        # distinct end points are one row per key, so the join neither loses nor repeats rows
        return self._stored().join(known.drop(*ENDS).hint("merge"), [KEY, PIECE]).drop(KEY, PIECE)
