"""History that grows: each batch of payments is read once and added to stored tables.

A batch is reduced to sums by (sender, receiver, bank). From these come its edges, marked
new where no earlier batch had them, and additive changes of the totals of the accounts
and banks that occur in it. All tables are bucketed by their keys, so finding known edges
moves only the batch, and adding up changes moves nothing. Money is summed in decimals:
totals do not depend on the order of tasks or batches.

A batch is named. It counts when its commit is written; adding it again does nothing, and
a batch that failed half-way leaves nothing behind when it is added again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import fixed_values as fv
from txrisk.operators.history import (
    MONEY,
    PARTS,
    SQUARES,
    History,
    bank_sums,
    bank_view,
    batch_sums,
    edges_of,
    job_pool,
    receiver_view,
    sender_view,
    with_hubs,
)
from txrisk.operators.network import DST, SRC
from txrisk.session import materialize
from txrisk.sources.bucketed import BucketedTable, Commits

BANK = "from_bank"
BUCKETS = 64
#: Table of one end of the edges, its key, the other end.
_SIDES = (("senders", SRC, DST), ("receivers", DST, SRC))


class HistoryStore:
    """Edges, account totals, bank totals and reciprocal edges in one shared folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")
        rows = self.commits.rows()
        self.buckets = buckets
        self.tables: dict[str, BucketedTable] | None = None
        if rows:
            self.buckets, account, bank = rows[0].note.split("|")
            self.buckets = int(self.buckets)
            self._declare(account, bank)

    def _declare(self, account: str, bank: str) -> None:
        sums = f"n_tx BIGINT, amount {MONEY}"
        layout = {
            "edges": (f"{SRC} {account}, {DST} {account}, n_laundering BIGINT, is_new INT, {sums}", [SRC, DST]),
            "cycles": (f"{SRC} {account}, {DST} {account}", [SRC, DST]),
            "senders": (f"{SRC} {account}, others BIGINT, {sums}", [SRC]),
            "receivers": (f"{DST} {account}, others BIGINT, {sums}", [DST]),
            "banks": (f"{BANK} {bank}, n_laundering BIGINT, squares {SQUARES}, {sums}", [BANK]),
        }
        self.tables = {
            name: BucketedTable(self.spark, f"{self.path}/{name}", columns, keys, 1 if name == "banks" else self.buckets)
            for name, (columns, keys) in layout.items()
        }

    def declare(self, schema: T.StructType) -> None:
        """Declare the tables for payments of this schema, before the first batch."""
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if self.tables is None:
            self._declare(kinds[SRC], kinds[BANK])

    def _new_part(self, rows: list) -> int:
        """A number that neither a commit nor a leftover of a failed attempt has."""
        return 1 + max([row.part for row in rows] + [table.last_part() for table in self.tables.values()])

    def _read(self, name: str, parts: list[int]) -> DataFrame:
        return self.tables[name].read(parts)

    def add(self, name: str, tx: DataFrame) -> bool:
        """Add a batch of payments; False if it was added before. ``tx`` is read once."""
        rows = self.commits.rows()
        if any(row.name == name for row in rows):
            return False
        self.declare(tx.schema)
        kinds = {f.name: f.dataType.simpleString() for f in tx.schema.fields}
        part, before = self._new_part(rows), Commits.valid(rows)
        sums = materialize(batch_sums(tx), "batch-sums")
        with job_pool(tx) as submit:
            banks = submit(lambda: self._write_banks(sums, part))
            self._write_edges(sums, part, before)
            pending = [submit(lambda: self._write_cycles(part, before))]
            pending += [submit(lambda side=side: self._write_side(part, *side)) for side in _SIDES]
            for job in [banks, *pending]:
                job.result()
        self.commits.add(part, name, note=f"{self.buckets}|{kinds[SRC]}|{kinds[BANK]}")
        return True

    def _write_edges(self, sums: DataFrame, part: int, before: list[int]) -> None:
        day = edges_of(sums)
        known = self._read("edges", before).where("is_new = 1").select(SRC, DST, F.lit(0).alias("_known"))
        marked = day.join(known.hint("merge"), [SRC, DST], "left")
        new = F.coalesce(F.col("_known"), F.lit(1)).alias("is_new")
        self.tables["edges"].write_part(marked.select(SRC, DST, "n_laundering", new, "n_tx", "amount"), part)

    def _write_side(self, part: int, table: str, key: str, other: str) -> None:
        met = F.when(F.col(other).isNotNull(), F.col("is_new")).otherwise(0)
        changed = self._read("edges", [part]).where(F.col(key).isNotNull()).groupBy(key).agg(
            F.sum(met).alias("others"), F.sum("n_tx").alias("n_tx"), F.sum("amount").alias("amount")
        )
        self.tables[table].write_part(changed, part)

    def _write_banks(self, sums: DataFrame, part: int) -> None:
        changed = sums.where(F.col(BANK).isNotNull()).groupBy(BANK).agg(
            F.sum("n_laundering").alias("n_laundering"),
            F.sum("squares").alias("squares"),
            F.sum("n_tx").alias("n_tx"),
            F.sum("amount").alias("amount"),
        )
        self.tables["banks"].write_part(changed, part)

    def _write_cycles(self, part: int, before: list[int]) -> None:
        """A flow becomes reciprocal when its second direction first occurs, so the new edges tell."""
        known = f"is_new = 1 AND {SRC} IS NOT NULL AND {DST} IS NOT NULL"
        new = self._read("edges", [part]).where(known).select(SRC, DST)
        back = self._read("edges", [*before, part]).where(known)
        back = back.select(F.col(SRC).alias(DST), F.col(DST).alias(SRC))
        closed = new.join(back.hint("merge"), [SRC, DST], "left_semi")
        both = closed.union(closed.select(F.col(DST).alias(SRC), F.col(SRC).alias(DST))).distinct()
        self.tables["cycles"].write_part(both, part)

    def compact(self) -> None:
        """Bring all batches together in one part; names of batches stay known."""
        rows = self.commits.rows()
        parts = Commits.valid(rows)
        if len(parts) < 2:
            return
        part = self._new_part(rows)
        for name, table in self.tables.items():
            stored, keys = self._read(name, parts), table.keys
            sums = [F.sum(c).cast(table_type).alias(c) for c, table_type in stored.dtypes if c not in (*keys, "is_new")]
            if name == "edges":
                sums.append(F.max("is_new").alias("is_new"))
            table.write_part(stored.groupBy(*keys).agg(*sums) if sums else stored, part)
        self.commits.add(part, f"compaction {part}", replaces=True, note=rows[0].note)

    def history(
        self, parts: tuple[str, ...] = PARTS, hubs: int = fv.HUB_BANKS, before: str | None = None
    ) -> History:
        """The history of all committed batches, equal to one fit over all their payments.

        ``before`` names a batch: it and those after it are left out, which needs that no
        compaction followed it. Account tables are added up where they lie; nothing is
        shuffled for them.
        """
        rows = self.commits.rows()
        limit = next((row.part for row in rows if row.name == before), None)
        if limit is not None:
            if any(row.replaces and row.part > limit for row in rows):
                raise ValueError(f"batch {before!r} has been compacted with others")
            rows = [row for row in rows if row.part < limit]
        committed = Commits.valid(rows)
        if self.tables is None:
            raise ValueError("the store holds no batch yet")

        def totals(table: str, key: str) -> DataFrame:
            return self._read(table, committed).groupBy(key).agg(
                F.sum("others").alias("others"),
                F.sum("n_tx").alias("n_tx"),
                F.sum("amount").cast("double").alias("amount"),
            )

        build = {
            "sender": lambda: sender_view(totals("senders", SRC)),
            "receiver": lambda: receiver_view(totals("receivers", DST)),
            "bank": lambda: with_hubs(bank_view(bank_sums(self._read("banks", committed))), hubs),
            "cycle": lambda: self._read("cycles", committed).withColumn("is_in_cycle", F.lit(1)),
        }
        return History(**{part: build[part]() for part in parts})

    def batches(self) -> DataFrame:
        return self.spark.createDataFrame(self.commits.rows(), Commits._DDL).select("part", "name", "replaces")
