"""Streams give the batch result, survive restarts and drop only late rows."""

import glob
import shutil

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from txrisk.operators.history import fit_history
from txrisk.plans.scoring import score_with
from txrisk.sources.warehouse import payment_stream, payments
from txrisk.streaming import monitoring
from txrisk.streaming.scoring import append_log_stream, score_stream, start_file_sink, start_update_sink


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_restart_neither_loses_nor_repeats_rows(spark, folder, tmp_path):
    source = tmp_path / "source"
    spark.read.parquet(f"{folder}/lineitem.parquet").repartition(4).write.parquet(str(source))
    files = sorted(glob.glob(f"{source}/part-*"))
    feed = tmp_path / "feed"
    feed.mkdir()
    schema = spark.read.parquet(str(source)).schema
    known = fit_history(payments(spark, folder))
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    for pair in (files[:2], files[2:]):
        for file in pair:
            shutil.copy(file, feed)
        lines = spark.readStream.schema(schema).parquet(str(feed))
        stream = payments(spark, folder, with_latency=True, lines=lines)
        run(append_log_stream(score_stream(stream, known, extra=("processing_ms",)), log, checkpoint))
    written = spark.read.parquet(log)
    batch = score_with(payments(spark, folder), known)
    assert written.count() == batch.count()
    columns = ["risk_score", "verdict", "amount_log", "is_in_cycle"]
    assert rows_of(written.groupBy(*columns).count()) == rows_of(batch.groupBy(*columns).count())
    assert "dt" in written.columns


def test_events_daily_counts_equal_batch(spark, folder, tmp_path):
    """The event stream replayed as files, per day and type."""
    source = tmp_path / "events"
    spark.read.parquet(f"{folder}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema

    def as_log(df):
        return df.select("ts", F.col("event_type").alias("payment_format"),
                         F.when(F.col("value") > 100, "FLAGGED").otherwise("CLEARED").alias("verdict"))

    stream = monitoring.daily_mix(as_log(spark.readStream.schema(schema).parquet(str(source))))
    run(start_file_sink(stream, str(tmp_path / "mix"), str(tmp_path / "cp")))
    written = spark.read.parquet(str(tmp_path / "mix"))
    events = as_log(spark.read.schema(schema).parquet(str(source)))
    last = events.agg(F.max("ts")).first()[0]
    batch = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"), "payment_format").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("verdict") == "FLAGGED", 1).otherwise(0)).alias("flagged"))
    closed = batch.where(F.col("window_start") + F.expr("INTERVAL 2 DAYS") <= F.lit(last))
    columns = ["window_start", "payment_format", "n", "flagged"]
    assert closed.count() > 50
    assert rows_of(written.select(*columns)) == rows_of(closed.select(*columns))


def test_open_windows_come_out_and_take_later_rows(spark, tmp_path):
    """Two files, two runs: the second changes a window that the first gave out."""
    feed, sink, checkpoint = (str(tmp_path / n) for n in ("feed", "sink", "checkpoint"))
    shape = "ts timestamp_ntz, payment_format string, verdict string"

    def feed_and_run(*times):
        rows = spark.createDataFrame([(t, "ACH", "FLAGGED") for t in times], "t string, payment_format string, verdict string")
        typed = rows.select(F.col("t").cast("timestamp_ntz").alias("ts"), "payment_format", "verdict")
        typed.coalesce(1).write.mode("append").parquet(feed)
        mix = monitoring.daily_mix(spark.readStream.schema(shape).parquet(feed))
        run(start_update_sink(mix, sink, checkpoint))
        keys = ["window_start", "window_end", "payment_format"]
        current = monitoring.latest_windows(spark.read.parquet(sink), keys)
        return {(str(r.window_start)[:10], r.n, r.is_open) for r in current.collect()}

    assert feed_and_run("2024-01-01 10:00:00", "2024-01-02 10:00:00") == {("2024-01-01", 1, 1), ("2024-01-02", 1, 1)}
    assert feed_and_run("2024-01-02 11:00:00", "2024-01-04 10:00:00") == {
        ("2024-01-01", 1, 0),
        ("2024-01-02", 2, 0),
        ("2024-01-04", 1, 1),
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_window_bounds_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-05-05 23:30:00' AS ts")
        start = df.select(monitoring.as_wall(F.window(monitoring.as_instant(F.col("ts")), "1 day")["start"])).first()[0]
        assert str(start) == "2024-05-05 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_stream_joins_history_like_a_table(spark, folder):
    known = fit_history(payments(spark, folder), ("sender",))
    streamed = score_stream(payment_stream(spark, folder), known)
    assert streamed.isStreaming
    assert streamed.columns == score_stream(payments(spark, folder), known).columns
