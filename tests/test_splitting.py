import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from txrisk.operators import splitting
from txrisk.sources.warehouse import payments

KEYS = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "is_laundering"]


@pytest.fixture(scope="module")
def tx(spark, folder):
    return payments(spark, folder).select(*KEYS)


def test_split_is_whole_disjoint_and_stable(tx):
    parts = splitting.split_stratified(tx)
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    assert train.count() + test.count() == tx.count()
    assert train.drop("split").intersect(test.drop("split")).count() == 0
    again = splitting.split_stratified(tx.repartition(7, "to_account"))
    assert rows_of(again) == rows_of(parts)


def test_each_class_is_cut_alike(tx):
    shares = splitting.split_stratified(tx).groupBy("is_laundering").agg(
        F.avg(F.when(F.col("split") == "train", 1.0).otherwise(0.0)).alias("s")
    )
    assert all(abs(r.s - 0.8) < 0.06 for r in shares.collect())


def test_temporal_split_cuts_the_time_range(make_tx):
    tx = make_tx([{"ts": f"2024-01-{d:02d} 00:00:00"} for d in range(1, 12)])
    parts = {str(r.ts)[8:10]: r.split for r in splitting.split_temporal(tx).collect()}
    assert parts["09"] == "train" and parts["10"] == "test"
    assert list(parts.values()).count("train") == 9


def test_undersample_keeps_every_positive(tx):
    kept = splitting.undersample(tx, ratio=2.0)
    n = kept.groupBy("is_laundering").count().collect()
    counts = {r.is_laundering: r["count"] for r in n}
    positives = tx.where("is_laundering = 1").count()
    assert counts[1] == positives
    assert abs(counts[0] / positives - 2.0) < 0.4
    assert splitting.undersample(tx, ratio=1e9).count() == tx.count()


def test_undersample_without_negatives(make_tx):
    assert splitting.undersample(make_tx([{"is_laundering": 1}])).count() == 1


def test_class_weight(make_tx):
    tx = make_tx([{"is_laundering": 1}] + [{}] * 3)
    assert splitting.class_weight(tx).first().positive_weight == 3.0


def test_split_summary(tx):
    rows = splitting.split_summary(splitting.split_stratified(tx)).collect()
    assert sum(r.n for r in rows) == tx.count()


def test_content_text_ignores_null_and_type_noise(spark):
    df = spark.createDataFrame([(1, 2.5, None)], "a int, b double, c string")
    assert df.select(splitting.content_text(df)).first()[0] == "1|2.500000|null"


def test_undersample_keeps_the_ratio_of_rare_positives(spark):
    """Ten positives among two million rows: about a hundred negatives stay."""
    rows = spark.range(2_000_000).selectExpr("id", "int(id < 10) as is_laundering")
    kept = splitting.undersample(rows, ratio=10.0).where("is_laundering = 0").count()
    assert 60 <= kept <= 150
