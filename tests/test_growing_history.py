"""History added in batches, frequent join keys, payments that stay in their buckets."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from txrisk.operators import history_store
from txrisk.operators.history import PARTS, attach_history, fit_history, hot_keys_of
from txrisk.operators.history_store import HistoryStore
from txrisk.operators.hot_keys import find_hot_keys
from txrisk.plans.catalog_history import with_hot_account
from txrisk.plans.feature_table import transform, transform_stored
from txrisk.session import materialize, new_path
from txrisk.sources.payment_store import PaymentStore
from txrisk.sources.warehouse import payments


@pytest.fixture(scope="module")
def tx(spark, folder):
    return materialize(with_hot_account(payments(spark, folder)), "growing-payments")


@pytest.fixture
def settings(spark):
    """Set configuration for one test."""
    before = {}

    def put(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def pieces(tx, n):
    place = F.pmod(F.xxhash64("ts", "to_account", "amount_paid"), F.lit(n))
    return [tx.where(place == k) for k in range(n)]


def same(store, tx):
    mine, fitted = store.history(), fit_history(tx)
    for part in PARTS:
        columns = [c for c in getattr(fitted, part).columns if c != "n_tx"]
        assert rows_of(getattr(mine, part).select(columns)) == rows_of(getattr(fitted, part).select(columns)), part


def drop_tables(store):
    for table in store.tables.values():
        store.spark.sql(f"DROP TABLE {table.name}")


def test_batches_equal_one_fit_and_survive_failures(spark, tx, monkeypatch):
    store = HistoryStore(spark, new_path(spark, "history"), 4)
    with pytest.raises(ValueError):
        store.history()
    parts = pieces(tx, 3)
    assert store.add("a", parts[0])

    def broken(*_):
        raise RuntimeError("lost half-way")

    with monkeypatch.context() as patch:
        patch.setattr(HistoryStore, "_write_cycles", broken)
        with pytest.raises(RuntimeError):
            store.add("b", parts[1])
    assert store.add("b", parts[1])  # the leftovers of the first attempt do not count
    assert not store.add("b", parts[1])
    assert store.add("none", tx.where("false"))
    drop_tables(store)  # as a later session finds it
    store = HistoryStore(spark, store.path)
    assert store.buckets == 4
    assert store.add("c", parts[2])
    same(store, tx)
    store.compact()
    assert not store.add("a", parts[0])
    same(store, tx)
    assert [row.name for row in store.batches().collect()] == ["a", "b", "none", "c", "compaction 6"]


def test_missing_ends_repeated_edges_and_self_payments(spark, make_tx):
    rows = [
        {"from_account": a, "to_account": b, "from_bank": bank}
        for a, b, bank in [("A", "B", "x"), (None, "B", "x"), ("A", None, None), (None, None, "y"), ("C", "C", "y"), ("A", "B", "y")]
    ]
    later = [{"from_account": a, "to_account": b, "is_laundering": 1} for a, b in [("B", "A"), ("A", "B"), (None, "B"), ("A", None)]]
    store = HistoryStore(spark, new_path(spark, "history"), 2)
    for name, some in (("one", rows), ("two", later), ("three", later)):
        store.add(name, make_tx(some))
    same(store, make_tx([*rows, *later, *later]))


def test_money_is_exact_in_any_order(spark, make_tx):
    amounts = [0.1, 1e9 + 0.07, 0.2, 3e8 + 0.01] * 50
    store = HistoryStore(spark, new_path(spark, "history"), 2)
    store.add("one", make_tx([{"amount_paid": a} for a in amounts]).repartition(7))
    (row,) = store._read("senders", [1]).collect()
    assert str(row.amount) == "65000000019.0000"


def test_stored_history_is_added_up_without_a_shuffle(spark, tx, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    store = HistoryStore(spark, new_path(spark, "history"), 4)
    store.add("a", tx)
    known = store.history(("sender", "receiver", "cycle"))
    for table in known.parts().values():
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    text = known.sender._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text and "PartitionFilters: [isnotnull(part" in text


def test_only_the_batch_is_read(spark, tx, monkeypatch):
    """The payments are the input of one aggregation; all else reads stored sums."""
    seen = []
    whole = history_store.batch_sums
    monkeypatch.setattr(history_store, "batch_sums", lambda rows: seen.append(rows) or whole(rows))
    store = HistoryStore(spark, new_path(spark, "history"), 2)
    first, second = pieces(tx, 2)
    store.add("a", first)
    store.add("b", second)
    assert [rows is some for rows, some in zip(seen, (first, second))] == [True, True]


def test_sketch_finds_every_frequent_key(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, -7).when(F.col("id") % 50 == 1, -8).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k")
    )
    assert find_hot_keys(rows, ["k"]).values["k"] == (-8, -7)
    assert find_hot_keys(rows.where("false"), ["k"]).values["k"] == ()
    with pytest.raises(ValueError):
        find_hot_keys(rows, ["k"], share=0.001, tracked=100)


@pytest.mark.parametrize("part", ["sender", "receiver", "cycle"])
def test_no_task_gets_the_hot_key(spark, tx, settings, part):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="16")
    assert tx.where("from_account = -7").count() > 0.25 * tx.count()
    known = fit_history(tx, (part,))
    joined = attach_history(tx, known, hot_keys_of(tx, (part,)))
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 3 * median(sizes)
    plain = attach_history(tx, known)
    assert rows_of(joined.select(plain.columns)) == rows_of(plain)
    if part == "sender":
        sizes = [r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) > 3 * median(sizes)


def exchanges_above(df, marker):
    """Shuffles between the scan whose line holds ``marker`` and the first join above it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = max(k for k, line in enumerate(lines) if "FileScan" in line and marker in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found, level = 0, depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            found += "Exchange" in line
            if "Join" in line:
                return found
    raise AssertionError("no join above the scan")


def test_payments_stay_in_their_buckets(spark, tx, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    store = PaymentStore(spark, new_path(spark, "payments"), 4)
    first, second = pieces(tx, 2)
    assert store.add("one", first) and store.add("two", second) and not store.add("two", second)
    assert rows_of(store.payments().select(tx.columns)) == rows_of(tx)
    spark.sql(f"DROP TABLE {store.table.name}")
    store = PaymentStore(spark, store.path)
    known = fit_history(tx)
    table = transform_stored(store, known)
    assert rows_of(table) == rows_of(transform(tx, known))
    assert exchanges_above(table, "payment_format") == 0
    assert exchanges_above(transform(tx, known), "payment_format") == 1


def test_stream_scores_with_split_keys(spark, folder):
    from txrisk.plans.catalog_streams import _run, _stream_session
    from txrisk.sources.warehouse import payment_stream
    from txrisk.streaming.scoring import score_stream

    rows = payments(spark, folder)
    known, hot = fit_history(rows, ("sender",)), hot_keys_of(rows, ("sender",), share=0.004)
    assert hot.values["from_account"]
    stream = payment_stream(_stream_session(spark), folder, with_latency=True)
    columns = ["ts", "from_account", "to_account", "risk_score", "verdict"]
    split = _run(score_stream(stream, known, hot=hot).select(*columns), spark, "split-stream")
    plain = _run(score_stream(stream, known).select(*columns), spark, "plain-stream")
    assert rows_of(split) == rows_of(plain)
