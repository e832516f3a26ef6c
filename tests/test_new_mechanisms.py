"""Exact quotas, the log store, sessions, exact quantiles, Shapley and linear attribution, growing streams."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from txrisk.functions.linear import with_linear_contributions
from txrisk.operators import drift, sessions, splitting
from txrisk.operators.history_store import HistoryStore
from txrisk.operators.quantiles import exact_quantiles
from txrisk.plans import tree_attribution
from txrisk.plans.scoring import prediction_log
from txrisk.session import materialize, new_path
from txrisk.sources.bucketed import Commits
from txrisk.sources.log_store import LogStore
from txrisk.sources.prediction_log import lookback
from txrisk.sources.warehouse import payments
from txrisk.streaming.growing import score_and_grow

# exact quotas


def labelled(spark, counts):
    """Rows of (label, text, copies)."""
    rows = [(label, text) for label, text, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "is_laundering int, text string")


def test_quotas_are_exact_with_many_equal_rows(spark):
    rows = labelled(spark, [(0, "same", 700), (0, "other", 50), (1, "same", 33), (1, "x", 9), (None, "n", 5)])
    rows = rows.unionByName(labelled(spark, [(0, f"t{k}", 1) for k in range(250)])).repartition(7)
    for share in (0.0, 0.1, 0.5, 0.8, 1.0):
        cut = splitting.split_exact(rows, share)
        assert Counter(rows_of(cut.drop("split"))) == Counter(rows_of(rows))
        train = Counter(r.is_laundering for r in cut.where("split = 'train'").collect())
        assert (train[0], train[1], train[None]) == (math.floor(1000 * share + 0.5), math.floor(42 * share + 0.5), 0)
        assert rows_of(cut) == rows_of(splitting.split_exact(rows.repartition(3), share))
    kept = Counter(r.is_laundering for r in splitting.undersample_exact(rows, 2.5).collect())
    assert kept == {0: 105, 1: 42}
    assert Counter(r.is_laundering for r in splitting.undersample_exact(rows, 1000).collect()) == {0: 1000, 1: 42}
    assert splitting.split_exact(rows.where("false")).count() == 0
    no_positive = splitting.undersample_exact(rows.where("is_laundering = 0"), 3.0)
    assert no_positive.count() == 0


def test_smaller_hashes_go_first(spark):
    rows = labelled(spark, [(0, f"t{k}", 1) for k in range(300)])
    marked = splitting.take_quota(rows, F.lit(70)).withColumn("h", splitting.content_hash(rows, splitting.SAMPLE_SALT))
    inside, outside = ([r.h for r in marked.where(F.col("taken") == side).collect()] for side in (True, False))
    assert len(inside) == 70 and max(inside) < min(outside)


# the log store


@pytest.fixture(scope="module")
def log(spark, folder):
    return materialize(prediction_log(payments(spark, folder, with_latency=True)), "log-rows")


def test_batches_count_once_and_half_written_ones_do_not(spark, log, monkeypatch):
    store = LogStore(spark, new_path(spark, "log"))
    with pytest.raises(ValueError):
        store.rows()
    first, second = log.where("ts < '1996-01-01'"), log.where("ts >= '1996-01-01'")
    assert store.append("one", first) and not store.append("one", first)

    def broken(*_, **__):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as patch:
        patch.setattr(Commits, "add", broken)
        with pytest.raises(RuntimeError):
            store.append("two", second)
    assert store.rows().count() == first.count()
    store = LogStore(spark, store.path)  # a later session
    assert store.append("two", second) and not store.append("two", second)
    assert rows_of(store.rows().drop("dt")) == rows_of(log)
    assert store.summary().agg(F.sum("n")).first()[0] == log.count()
    assert store.append("none", log.where("false"))


@pytest.mark.parametrize("as_of", ["2001-08-01 00:00:00", "2001-08-01 13:45:10", "1992-02-01 00:00:00"])
def test_summaries_give_the_metrics_of_the_rows(spark, log, as_of):
    store = LogStore(spark, new_path(spark, "log"))
    store.append("all", log)
    assert rows_of(store.drift_metrics(as_of)) == rows_of(drift.drift_metrics(log, as_of))
    assert rows_of(store.recent(as_of, 7).drop("dt")) == rows_of(lookback(log, as_of, 7))


def test_whole_days_come_from_the_summary_alone(spark, log, monkeypatch):
    store = LogStore(spark, new_path(spark, "log"))
    store.append("all", log)
    read = []
    committed = LogStore._committed
    monkeypatch.setattr(LogStore, "_committed", lambda self, kind, at: read.append(kind) or committed(self, kind, at))
    store.drift_metrics("2001-08-01 00:00:00")
    assert read == ["summary"]
    store.drift_metrics("2001-08-01 00:00:01")
    assert read == ["summary", "summary", "rows"]
    text = store.recent("2001-08-01 00:00:00", 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "month" in text.split("PartitionFilters")[1][:200]


# sessions


def session_rows(df):
    return sorted((r.from_account, str(r.session_start), str(r.session_end), r.n_tx, r.is_open) for r in df.collect())


def test_sessions_by_hand(spark, make_tx):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:59:59", "2024-01-01 02:00:00", "2024-01-01 02:10:00", "2024-01-01 03:00:00"]
    tx = make_tx([{"ts": t} for t in times] + [{"from_account": "Z", "ts": t} for t in (times[0], "2024-01-01 01:00:00")] + [{"from_account": None, "ts": times[0]}])
    assert session_rows(sessions.account_sessions(tx, 3600)) == [
        ("A", times[0], "2024-01-01 01:59:59", 2, 0),
        ("A", times[2], "2024-01-01 04:00:00", 3, 1),
        ("Z", times[0], "2024-01-01 02:00:00", 2, 0),
    ]
    assert sessions.account_sessions(tx.where("false"), 3600).count() == 0


def test_pieces_of_batches_join_across_late_payments(spark, make_tx):
    tx = make_tx([{"ts": f"2024-01-0{d} {h:02d}:30:00", "from_account": a} for d in (1, 2) for h in (1, 2, 3, 7, 9) for a in "AB"])
    late = tx.where("hour(ts) = 2 OR hour(ts) = 9")
    early = tx.where("hour(ts) <> 2 AND hour(ts) <> 9")
    pieces = sessions.session_pieces(early, 5400).unionByName(sessions.session_pieces(late, 5400))
    whole = sessions.account_sessions(tx, 5400)
    assert session_rows(sessions.sessions_of_pieces(pieces, 5400)) == session_rows(whole)


def test_watermarked_sessions_are_closed_ones(spark, folder):
    from txrisk.plans.catalog_streams import _run
    from txrisk.sources.warehouse import payment_stream
    from txrisk.plans.catalog_streams import _stream_session

    gap = 7 * 24 * 3600
    stream = sessions.closed_sessions(payment_stream(_stream_session(spark), folder), gap)
    found = {(r.from_account, str(r.session_start), str(r.session_end), r.n_tx) for r in _run(stream, spark, "closed").collect()}
    batch = {row[:4]: row[4] for row in session_rows(sessions.account_sessions(payments(spark, folder), gap))}
    assert found <= set(batch) and not any(batch[row] for row in found)


# exact quantiles


def test_quantiles_of_few_equal_and_missing_values(spark):
    shares = {"low": 0.0, "mid": 0.5, "high": 0.95, "last": 1.0}

    def of(values):
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
        return tuple(exact_quantiles(frame, "v", shares).first())

    rng = np.random.default_rng(1)
    many = (rng.standard_normal(5000) * 10.0 ** rng.integers(-8, 8, 5000)).tolist()
    ordered = sorted(many)
    assert of(many) == (ordered[0], ordered[2500], ordered[4750], ordered[-1], 5000)
    assert of([2.0] * 500 + [1.0]) == (1.0, 2.0, 2.0, 2.0, 501)
    assert of([None, float("nan"), 3.0]) == (3.0, 3.0, 3.0, 3.0, 1)
    assert of([]) == (None, None, None, None, 0)


# attribution


def random_tree(rng, depth, features):
    nodes = {name: [] for name in ("left", "right", "feature", "cut", "value", "cover")}

    def grow(level, cover):
        at = len(nodes["left"])
        for name, value in zip(nodes, (-1, -1, -1, 0.0, rng.normal(), cover)):
            nodes[name].append(value)
        if level and rng.random() < 0.9:
            share = rng.uniform(0.1, 0.9)
            nodes["feature"][at], nodes["cut"][at] = int(rng.integers(features)), rng.normal()
            nodes["left"][at] = grow(level - 1, cover * share)
            nodes["right"][at] = grow(level - 1, cover * (1 - share))
        return at

    grow(depth, 100.0)
    return [np.array(values) for values in nodes.values()]


def held_value(tree, x, known, node=0):
    left, right, feature, cut, value, cover = tree
    if left[node] < 0:
        return value[node]
    if feature[node] in known:
        return held_value(tree, x, known, left[node] if x[feature[node]] <= cut[node] else right[node])
    sides = (left[node], right[node])
    return sum(cover[side] * held_value(tree, x, known, side) for side in sides) / cover[node]


@pytest.mark.parametrize("tabled", [8, 2])
def test_shapley_values_equal_enumeration(monkeypatch, tabled):
    monkeypatch.setattr(tree_attribution, "TABLED", tabled)
    rng, d = np.random.default_rng(tabled), 5
    for _ in range(10):
        tree, x = random_tree(rng, 5, d), rng.normal(size=(4, d))
        credit = np.zeros((4, d + 1))
        tree_attribution.ShapleyTree(2.0, *tree).add_to(credit, x)
        for row, found in zip(x, credit):
            for i in range(d):
                others, want = [j for j in range(d) if j != i], 0.0
                for k in range(d):
                    weight = math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d)
                    for some in itertools.combinations(others, k):
                        want += weight * (held_value(tree, row, {*some, i}) - held_value(tree, row, set(some)))
                assert found[i] == pytest.approx(2 * want, abs=1e-12)
            assert found[-1] == pytest.approx(2 * held_value(tree, row, set()))
            assert found.sum() == pytest.approx(2 * held_value(tree, row, set(range(d))))


def test_linear_contributions_and_missing_values(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (None, 2.0)], "a double, b double")
    known = with_linear_contributions(rows, {"a": 2.0, "b": -1.0}, {"a": 3.0, "b": 1.0}, 0.5).collect()
    assert [tuple(r.contributions) for r in known] == [(-4.0, -3.0), (0.0, -1.0)]
    assert {r.expected for r in known} == {0.5 + 6.0 - 1.0}


# growing streams


def test_a_micro_batch_run_again_sees_the_same_history(spark, folder):
    tx = payments(spark, folder)
    source = new_path(spark, "source")
    for k in range(2):
        tx.where(F.pmod(F.xxhash64("ts", "to_account"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(source)
    store, sink = HistoryStore(spark, new_path(spark, "history"), 2), new_path(spark, "sink")
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for checkpoint in ("first", "again"):  # a lost checkpoint: every batch is run once more
        score_and_grow(stream, store, sink, new_path(spark, checkpoint), parts=("sender",)).awaitTermination()
        scored = spark.read.parquet(sink)
        assert scored.count() == tx.count()
        assert scored.where("batch = 0 AND fan_out_degree > 0").count() == 0
        assert scored.where("batch = 1 AND fan_out_degree > 0").count() > 0
    assert [r.name for r in store.batches().collect()] == ["stream 0", "stream 1"]
