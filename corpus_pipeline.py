"""A corpus pipeline: toxic documents go, then copies, then near copies; the rest is mixed and encoded.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and returns a table
that is written and read again as the next stage's documents; all but the last keep the
columns of ``documents``. SQL cannot express the first, third and last stage.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txrisk.llm import bpe_codec, curriculum, near_copies, toxicity  # noqa: E402
from txrisk.llm.common import materialize, new_path, read_table, ship_package  # noqa: E402
from txrisk.llm.digest_index import DigestIndex  # noqa: E402

TOKENIZER = "byte_bpe_50k.json"
#: Whole texts are long rows: few of them go through Python at a time, and writers hold
#: short row groups, so that a task's memory does not depend on how long its texts are.
BATCH_ROWS, ROW_GROUP_BYTES = 256, 16 << 20


def _long_rows(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("parquet.block.size", ROW_GROUP_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression model, learned from the labels, calls toxic go."""
    _long_rows(spark)
    return toxicity.keep_ordinary(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    _long_rows(spark)
    return DigestIndex(spark, new_path(spark, "digest-index")).keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles; linked by SimHash, then exactly at Jaccard 0.8 or more) the
    smallest doc_id stays."""
    _long_rows(spark)
    return near_copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training positions."""
    _long_rows(spark)
    return curriculum.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with checksums of the ids and of the text they decode to."""
    _long_rows(spark)
    path = public_tokenizers.path(TOKENIZER)
    return bpe_codec.digests(bpe_codec.encode_and_decode(docs, path, bpe_codec.build_lexicon(docs, path)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
