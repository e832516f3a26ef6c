"""Account, bank and cycle history: edge cases, naive equivalents and skew."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from txrisk.operators import history, network, rolling
from txrisk.operators.history import fit_history
from txrisk.plans.feature_table import feature_table, request_features, transform


def skewed_rows(n=3000, seed=7):
    """A third of all payments leave one account, a third reach one account, and
    a third use one bank; some ends are unknown."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        src = "hub" if i % 3 == 0 else f"s{rng.randrange(60)}"
        dst = "sink" if i % 3 == 1 else f"s{rng.randrange(60)}"
        rows.append(
            {
                "ts": f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00",
                "from_account": None if i % 97 == 0 else src,
                "to_account": None if i % 89 == 0 else dst,
                "from_bank": None if i % 83 == 0 else ("big" if i % 3 == 2 else f"b{rng.randrange(30)}"),
                "to_bank": f"b{rng.randrange(30)}",
                "amount_paid": round(rng.random() * 20000, 2),
                "is_laundering": int(rng.random() < 0.1),
            }
        )
    return rows


@pytest.fixture(scope="module")
def skewed(make_tx):
    return make_tx(skewed_rows())


def naive_cycles(tx, self_loops=True):
    e = tx.select("from_account", "to_account").distinct()
    r = e.select(F.col("to_account").alias("from_account"), F.col("from_account").alias("to_account"))
    found = e.join(r, ["from_account", "to_account"])
    return found if self_loops else found.where("from_account != to_account")


@pytest.mark.parametrize("self_loops", [True, False])
def test_cycle_edges_equal_a_self_join(skewed, self_loops):
    mine = network.cycle_edges(network.edges(skewed), self_loops).select("from_account", "to_account")
    assert rows_of(mine) == rows_of(naive_cycles(skewed, self_loops))


def test_cycle_pair_count_equals_a_self_join(skewed):
    f = skewed.select(F.col("from_account").alias("a"), F.col("to_account").alias("b"), "is_laundering")
    r = skewed.select(F.col("to_account").alias("a"), F.col("from_account").alias("b"))
    naive = f.join(r, ["a", "b"]).where("a != b").agg(F.count(F.lit(1)), F.sum("is_laundering")).first()
    mine = network.cycle_pair_counts(network.edges(skewed)).first()
    assert (mine.cycle_pairs, mine.laundering_pairs) == tuple(naive)


def test_cycles_need_both_directions(make_tx):
    tx = make_tx(
        [
            {"from_account": "A", "to_account": "B"},
            {"from_account": "B", "to_account": "A"},
            {"from_account": "A", "to_account": "C"},
            {"from_account": "D", "to_account": "D"},
            {"from_account": None, "to_account": "A"},
            {"from_account": "A", "to_account": None},
        ]
    )
    table = transform(tx, fit_history(tx))
    flagged = {(r.from_account, r.to_account) for r in table.where("is_in_cycle = 1").collect()}
    assert flagged == {("A", "B"), ("B", "A"), ("D", "D")}
    without = transform(tx, fit_history(tx, include_self_loops=False))
    assert without.where("is_in_cycle = 1").count() == 2


def test_empty_cycles(make_tx):
    counts = network.cycle_pair_counts(network.edges(make_tx([{}]))).first()
    assert (counts.cycle_pairs, counts.laundering_pairs, counts.rate_pct) == (0, 0, None)
    loops = network.self_loops(make_tx([{}])).first()
    assert (loops.self_loops, loops.rate_pct) == (0, None)


def test_bank_with_one_payment_and_unknown_bank(make_tx):
    tx = make_tx([{"from_bank": "solo", "amount_paid": 50.0}, {"from_bank": None}])
    table = {r.from_bank: r for r in feature_table(tx).collect()}
    assert table["solo"].amount_zscore_per_bank == 0.0
    assert table[None].bank_risk_score == 0.0 and table[None].is_hub_bank == 0
    assert table[None].amount_zscore_per_bank == 0.0


def test_hub_ties_are_broken_by_bank(make_tx):
    tx = make_tx([{"from_bank": b, "is_laundering": 1} for b in ("c", "a", "b", "b")])
    banks = {r.from_bank: r.is_hub_bank for r in history.bank_history(tx, hubs=2).collect()}
    assert banks == {"b": 1, "a": 1, "c": 0}


def test_unseen_keys_take_the_fill_values(make_tx):
    known = fit_history(make_tx([{}]))
    row = transform(make_tx([{"from_account": "new", "to_account": "new2", "from_bank": "new3"}]), known).first()
    assert (row.fan_out_degree, row.fan_in_degree, row.tx_velocity, row.amount_per_tx) == (0, 0, 1, 0.0)
    assert (row.bank_risk_score, row.amount_zscore_per_bank, row.is_in_cycle, row.is_hub_bank) == (0.0, 0.0, 0, 0)


def test_history_ignores_rows_it_was_not_fitted_on(make_tx):
    past = make_tx([{"is_laundering": 0}])
    future = make_tx([{"is_laundering": 1, "to_account": "C"}])
    row = transform(future, fit_history(past)).first()
    assert (row.fan_out_degree, row.bank_risk_score) == (1, 0.0)


def test_distinct_counts_skip_unknown_receivers(skewed):
    mine = history.sender_history(network.edges(skewed)).select("from_account", "fan_out_degree", "tx_velocity")
    naive = skewed.where("from_account IS NOT NULL").groupBy("from_account").agg(
        F.countDistinct("to_account"), F.count(F.lit(1))
    )
    assert rows_of(mine) == rows_of(naive)


@pytest.fixture
def no_broadcast(spark):
    """Shuffled joins with a skew limit that the fixture's frequent keys pass."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def test_shuffled_history_gives_the_same_table(skewed, no_broadcast, spark):
    shuffled = feature_table(skewed)
    found = rows_of(shuffled)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    plain = feature_table(skewed)
    assert shuffled.columns == plain.columns and found == rows_of(plain)


def test_frequent_keys_are_split(skewed, no_broadcast):
    """Input of several files, so that a frequent key's rows come from more than one map task."""
    table = history.attach_history(skewed.repartition(8), fit_history(skewed, ("sender",)))
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_each_large_part_costs_one_shuffle_of_the_rows(skewed, no_broadcast):
    table = history.attach_history(skewed, fit_history(skewed))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and plan.count("Exchange hashpartitioning") == 8


def test_rolling_risk_counts_strictly_earlier_rows(skewed):
    mine = {
        (r.from_bank, r.ts): (r.past_tx, r.past_laundering)
        for r in rolling.rolling_bank_risk_table(skewed).collect()
    }
    rows = [r for r in skewed.collect() if r.from_bank is not None]
    for (bank, ts), (n, bad) in list(mine.items())[::25]:
        earlier = [r for r in rows if r.from_bank == bank and r.ts < ts]
        assert (n, bad) == (len(earlier), sum(r.is_laundering for r in earlier))
    assert rolling.with_rolling_bank_risk(skewed).count() == skewed.count()


def test_request_features_use_history_when_known(spark, make_tx):
    schema = "payment_format string, amount double, from_bank string, to_bank string, currency string, fan_out int, tx_velocity int"
    requests = spark.createDataFrame([("ACH", 9000.0, "x", "y", "Euro", 3, 0), ("ACH", 5.0, "q", "q", "Euro", 200, 4)], schema)
    plain = request_features(requests).collect()
    assert plain[0].amount_per_tx == 9000.0 and plain[0].bank_risk_score == 0.15
    assert plain[1].is_high_fan_out == 1 and plain[1].is_cross_border == 0
    past = fit_history(make_tx([{"is_laundering": 1}, {}]), ("bank",))
    known = {r.from_bank: r for r in request_features(requests, past).collect()}
    assert known["x"].bank_risk_score == 0.5 and known["x"].is_hub_bank == 1
    assert known["q"].bank_risk_score == 0.15
