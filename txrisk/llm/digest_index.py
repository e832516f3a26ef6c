"""Exact duplicates by a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest, in a shared
folder. A batch of documents is reduced to one row per digest before it meets the
index in a sort-merge anti-join; the digests that are new are appended. The index
stays where it is between sessions: opening it again only declares its folder.

Everything is built from DataFrame operations. A group of copies of any size is
counted by partial aggregation. Verdicts go back to the documents by an equality join
of a table with one row per text of the batch; the rows of the few texts that make up a
share of the batch are joined under sub-keys, so they are spread over tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import lower_ascii, materialize, whole_text
from txrisk.operators.hot_keys import HotKeys, join_spread

#: Texts with this share of a batch are spread; there are at most 1 / share of them.
HOT_SHARE = 0.005
FIELDS = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"


def text_digest(text: Column | None = None) -> Column:
    """SHA-256 of the text with A-Z lower-cased; a null text is the empty text."""
    return F.unhex(F.sha2(lower_ascii(whole_text() if text is None else text).cast("binary"), 256))


class DigestIndex:
    """A digest index in a folder.

    ``deduplicate`` gives each row of a batch the columns ``keep_id`` (the document that
    stands for its text), ``group_size`` (rows of the text in the batch that brought it),
    ``kept`` and ``text_sha256``. Of equal texts in one batch the largest ``doc_id`` stays
    (a null doc_id only if there is no other); texts that an earlier batch brought are
    all dropped. Submitting a batch again under its name gives the same verdicts. Rows
    with the same doc_id and text are one document and get the same verdict.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        self.name = "digests_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        self.buckets = buckets or _shuffle_partitions(spark)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({FIELDS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add the texts of (doc_id, digest) rows that the index lacks."""
        groups = digests.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        )
        known = self.table().select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        if self.buckets != _shuffle_partitions(self.spark):
            new = new.repartition(self.buckets, "digest")  # else each task would write every bucket
        new.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def deduplicate(self, docs: DataFrame, batch: str = "first") -> DataFrame:
        digests = materialize(docs.select("doc_id", text_digest().alias("digest")), "digests")
        self.append(digests, batch)
        # One row per text of the batch meets the buckets of the index; then the documents meet it.
        texts = digests.groupBy("digest").agg(F.count("*").alias("n_here"))
        found = materialize(texts.join(self.table().hint("merge"), "digest"), "digest-verdicts")
        verdict = (F.col("batch") == batch) & F.col("keep_id").eqNullSafe(F.col("doc_id"))
        return join_spread(digests, found, ["digest"], self._frequent(found), ["doc_id"]).select(
            "doc_id",
            "keep_id",
            "group_size",
            verdict.alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def _frequent(self, found: DataFrame) -> HotKeys:
        """The digests with HOT_SHARE of the batch or more."""
        total = found.agg(F.sum("n_here")).first()[0] or 0
        often = found.where(F.col("n_here") >= F.lit(max(total * HOT_SHARE, 2.0))).select("digest").collect()
        return HotKeys({"digest": tuple(bytes(row.digest) for row in often)})

    def keep_rows(self, docs: DataFrame, batch: str = "first") -> DataFrame:
        """The rows of a batch that stay, all columns as they came."""
        verdicts = self.deduplicate(docs, batch)
        kept = verdicts.where("kept").select("doc_id").distinct()
        # A doc_id that names several rows, or none, is settled by its digest.
        ids = docs.groupBy("doc_id").count()
        if ids.where((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
            return docs.join(kept, "doc_id", "left_semi")
        marked = docs.withColumn("__digest", text_digest())
        chosen = self.table().where(F.col("batch") == batch)
        chosen = chosen.select(F.col("digest").alias("__chosen"), F.col("keep_id").alias("__keep_id"))
        same = F.col("__digest").eqNullSafe(F.col("__chosen")) & F.col("doc_id").eqNullSafe(F.col("__keep_id"))
        return (
            marked.join(chosen, same, "left_semi")
            .dropDuplicates(["doc_id", "__digest"])
            .drop("__digest")
        )


def _shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
