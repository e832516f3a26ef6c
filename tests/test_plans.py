"""What the physical plans may and may not contain."""

import re

import pytest

import __spark_entry__ as contract
from txrisk.operators import network, profiles
from txrisk.plans.feature_table import feature_table
from txrisk.plans.scoring import score_payments
from txrisk.sources.warehouse import payments

SAMPLE = ["feature_table", "cycle_pairs", "fan_out_accounts", "rate_by_hour", "drift_alerts", "pr_curve", "case_reports",
          "rolling_bank_risk", "undersample", "report_issues"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_join_and_no_python_in_tasks(spark, folder, name):
    text = plan(contract.queries()[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)


@pytest.mark.parametrize("name", SAMPLE)
def test_tables_too_large_to_broadcast_give_no_products(spark, folder, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(contract.queries()[name](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_live_stats_read_the_payments_once(spark, folder):
    text = plan(contract.queries()["live_stats"](spark, folder))
    assert len(re.findall(r"FileScan parquet .*lineitem\.parquet", text)) == 1


def test_stored_log_reads_its_days_only(spark, folder):
    text = plan(contract.queries()["stored_log"](spark, folder))
    scan = next(line for line in text.splitlines() if "stored-log" in line)
    assert "PartitionFilters: [isnotnull(dt" in scan


def test_small_history_joins_do_not_shuffle_the_payments(spark, folder):
    text = plan(feature_table(payments(spark, folder)))
    assert text.count("BroadcastHashJoin") == 7
    assert "hashpartitioning" not in text


def test_scans_read_only_what_is_needed(spark, folder):
    text = plan(profiles.class_counts(payments(spark, folder)))
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_discount:double,l_returnflag:string>" in scan
    assert "PushedFilters: [IsNotNull(l_orderkey)" in scan


def test_cycles_use_one_shuffle_after_the_edges(spark, folder):
    text = plan(network.cycle_edges(network.edges(payments(spark, folder))))
    assert text.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" not in text


def test_top_k_is_not_a_full_sort(spark, folder):
    tx = payments(spark, folder)
    assert "TakeOrderedAndProject" in plan(profiles.top_by(tx.groupBy("from_bank").count(), "count", 10, "from_bank"))


def test_case_sample_limits_rows_before_the_shuffle(spark, folder):
    from txrisk.operators.cases import case_sample

    text = plan(case_sample(score_payments(payments(spark, folder))))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["split_exact", "undersample_exact", "leafwise_histograms", "features_hot_account"])
def test_queries_that_read_the_payments_often_join_them_once(spark, folder, name):
    assert "lineitem.parquet" not in plan(contract.queries()[name](spark, folder))


@pytest.mark.parametrize("name, sink", [("parquet_overwrite", "write_table"), ("newest_report_run", "write_reports")])
def test_sinks_write_stored_rows(spark, folder, monkeypatch, name, sink):
    from txrisk.plans.catalog_sources import writers

    seen, write = [], getattr(writers, sink)
    monkeypatch.setattr(writers, sink, lambda rows, *args, **more: (seen.append(plan(rows)), write(rows, *args, **more)))
    contract.queries()[name](spark, folder)
    assert len(seen) == 2 and not any("lineitem.parquet" in text or "Join" in text for text in seen)


def test_kept_log_is_scored_once(spark, folder, monkeypatch):
    from txrisk.plans import catalog_monitoring

    seen, append = [], catalog_monitoring.LogStore.append
    watch = lambda store, name, rows: (seen.append(plan(rows)), append(store, name, rows))[1]
    monkeypatch.setattr(catalog_monitoring.LogStore, "append", watch)
    catalog_monitoring._kept(spark, folder)
    assert len(seen) == 4 and not any("Join" in text for text in seen)


def test_buckets_follow_the_rows(spark, monkeypatch):
    from txrisk.plans import catalog_history

    monkeypatch.setattr(catalog_history, "_BUCKET_ROWS", 100)
    assert [catalog_history.buckets_for(spark.range(n)) for n in (0, 5, 801, 3000)] == [8, 8, 9, 30]


def test_a_stretch_of_several_files_is_one_micro_batch(spark, folder, monkeypatch, tmp_path):
    """Also where a stretch has fewer rows than files, or none."""
    from txrisk.plans import catalog_streams

    monkeypatch.setattr(catalog_streams, "_FILE_ROWS", 1000)
    rows = payments(spark, folder)
    early = rows.where("ts < TIMESTAMP_NTZ '1992-02-01'").limit(2).union(rows.where("ts >= TIMESTAMP_NTZ '1998-01-01'"))
    for turn, tx in enumerate((rows, early)):
        counts, cut = [], catalog_streams.stretch_of(tx, 4).groupBy("stretch").count().collect()
        wanted = {r.stretch: r["count"] for r in cut}
        stream = catalog_streams._arriving(tx).writeStream.foreachBatch(lambda batch, _: counts.append(batch.count()))
        stream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / str(turn))).start().awaitTermination()
        assert counts == [wanted.get(k, 0) for k in range(4)]
