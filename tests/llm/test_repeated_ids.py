"""Deduplication of rows whose ids repeat or are missing, with clashing column names and hot texts."""

import pytest

from txrisk.llm import near_copies
from txrisk.llm.common import new_path, ship_package
from txrisk.llm.digest_index import DigestIndex

COLUMNS = "doc_id long, text string, digest string, keep_id long, node long, kept boolean, batch string, _kept long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, rows):
    return spark.createDataFrame([(doc, text, "d", 1, 2, True, "b", 3) for doc, text in rows], COLUMNS)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_copies_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a"), (2, "A"), (2, "b"), (None, "B"), (None, "c"), (None, "C"), (3, "d"), (3, "d"), (4, None), (5, "")]
    docs = table(spark, rows)
    found = DigestIndex(spark, new_path(spark, "index"), 4).keep_rows(docs)
    assert found.columns == docs.columns
    by_id = {(doc, (text or "").lower()) for doc, text in kept(found)}
    assert by_id == {(2, "a"), (2, "b"), (None, "c"), (3, "d"), (5, "")} and found.count() == 5


def test_verdicts_of_a_hot_text(spark):
    rows = [(k, "the same" if k % 3 else f"text {k}") for k in range(3000)]
    index = DigestIndex(spark, new_path(spark, "index"), 4)
    verdicts = index.deduplicate(table(spark, rows)).collect()
    assert len(verdicts) == 3000
    hot = [r for r in verdicts if r.group_size == 2000]
    assert len(hot) == 2000 and {r.keep_id for r in hot} == {2999} and [r.doc_id for r in hot if r.kept] == [2999]
    assert all(r.kept for r in verdicts if r.group_size == 1)


def test_near_copies_are_settled_by_id_and_text(spark):
    long = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"thing{k}" for k in range(80))
    docs = table(spark, [(3, long), (5, other), (5, long + " more"), (None, other + " again"), (None, "alone here")])
    assert kept(near_copies.keep_one(docs)) == sorted([(3, long), (5, other), (None, "alone here")], key=repr)
    assert near_copies.keep_one(docs).columns == docs.columns
