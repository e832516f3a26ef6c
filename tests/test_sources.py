"""Readers and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from txrisk import schemas
from txrisk.operators import cases, cleaning
from txrisk.plans.scoring import prediction_log, score_payments
from txrisk.sources import prediction_log as log_io
from txrisk.sources import readers, writers
from txrisk.sources.warehouse import payments

HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text(
        "\n".join(
            [
                HEADER,
                "2022/09/01 00:20,010,8000EBD30,010,8000EBD31,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0",
                "2022/09/01 00:26,03208,8000F4580,001,8000F5340,0.01,US Dollar,abc,US Dollar,Cheque,1",
            ]
        )
    )
    return str(path)


def test_csv_with_repeated_header_name(spark, csv):
    tx = readers.read_transactions_csv(spark, csv)
    assert tx.columns == schemas.RAW_TRANSACTIONS.names
    first = cleaning.parse_timestamp(tx).first()
    assert (first.from_account, first.to_account, first.from_bank) == ("8000EBD30", "8000EBD31", "010")
    assert str(first.ts) == "2022-09-01 00:20:00"


def test_csv_corrupt_rows_are_kept_apart(spark, csv):
    tx = readers.read_transactions_csv(spark, csv, keep_corrupt=True)
    rows = tx.collect()
    assert [r[readers.CORRUPT] is None for r in rows] == [True, False]
    assert readers.read_transactions_csv(spark, csv, mode="DROPMALFORMED").collect()[0].to_account == "8000EBD31"


def test_accounts_csv(spark, tmp_path):
    path = tmp_path / "accounts.csv"
    path.write_text("Bank,Account,Name,Street,City,State,Country,Zip\n1,A,N,S,C,ST,CO,00012\n")
    assert readers.read_accounts_csv(spark, str(path)).first().zip == "00012"


def test_table_round_trip_by_partition(spark, folder, tmp_path):
    tx = payments(spark, folder).withColumn("dt", F.to_date("ts"))
    writers.write_table(tx, str(tmp_path / "t"), partition_by=["payment_format"])
    back = readers.read_table(spark, str(tmp_path / "t"), ["amount_paid", "payment_format"])
    assert back.count() == tx.count()
    plan = back.where("payment_format = 'ACH'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(payment_format" in plan


def test_log_append_twice_and_lookback_prunes_days(spark, folder, tmp_path):
    path = str(tmp_path / "log")
    rows = prediction_log(payments(spark, folder, with_latency=True))
    assert rows.schema.names == schemas.PREDICTION_LOG.names
    assert log_io.append_predictions(rows.limit(10), path) and log_io.append_predictions(rows.limit(10), path)
    log = log_io.read_log(spark, path)
    assert log.count() == 20
    recent = log_io.lookback(log, "2001-08-01 00:00:00", 7)
    assert "PartitionFilters: [isnotnull(dt" in recent._jdf.queryExecution().executedPlan().toString()


def test_failed_append_does_not_stop_the_caller(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    rows = spark.createDataFrame([("2024-01-01 00:00:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert log_io.append_predictions(rows, str(blocked / "log")) is False
    with pytest.raises(Exception):
        log_io.append_predictions(rows, str(blocked / "log"), strict=True)


def test_reports_to_json_text_and_newest_run(spark, folder, tmp_path):
    reports = cases.case_reports(score_payments(payments(spark, folder)), per_type=2)
    writers.write_json(reports, str(tmp_path / "json"))
    record = json.loads(writers.as_json_records(reports.where("case_id = 1")).first().record)
    assert record["case_type"] == "TP" and len(record["drivers"]) == 5 and "tx_velocity" in record["features"]
    writers.write_case_report_text(reports, str(tmp_path / "text"))
    body = "\n".join(r.value for r in spark.read.text(str(tmp_path / "text")).collect())
    assert "CASE 01 — TP — TRUE POSITIVE  (Correctly Flagged Fraud)" in body and "Actual Label: FRAUD" in body
    for run in ("20240101_000000", "20240102_000000"):
        writers.write_reports(reports if run.startswith("20240102") else reports.limit(1), str(tmp_path / "runs"), run)
    newest = readers.read_latest_reports(spark, str(tmp_path / "runs"))
    assert {(r.n_reports) for r in newest.collect()} == {6} and newest.count() == 6


def test_csv_sink_and_summary(spark, tmp_path, capsys):
    df = spark.createDataFrame([("a", 0.5)], "feature string, importance double")
    writers.write_csv(df, str(tmp_path / "imp"))
    assert spark.read.option("header", True).csv(str(tmp_path / "imp")).first().feature == "a"
    writers.show_summary(df)
    assert "importance" in capsys.readouterr().out
