"""Named queries: whole tables written by a sink, read back by its source."""

from pyspark.sql import functions as F

from txrisk import schemas
from txrisk.functions.row_features import add_row_features
from txrisk.functions.scalars import amount_from_log
from txrisk.operators import cases
from txrisk.operators.cleaning import TIMESTAMP_PATTERN, parse_timestamp
from txrisk.plans.catalog import query
from txrisk.plans.catalog_texts import CASE_TABLES
from txrisk.plans.oracle import BASE
from txrisk.plans.scoring import score_payments
from txrisk.session import materialize, new_path
from txrisk.sources import readers, writers
from txrisk.sources.warehouse import payments, stored_payments

_RAW = [f.name for f in schemas.RAW_TRANSACTIONS.fields]
_TEXT_IDS = ("from_bank", "from_account", "to_bank", "to_account")
_SCORES = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "risk_score", "verdict"]


def _scored(spark, folder):
    return score_payments(stored_payments(spark, folder))


@query(
    "csv_transactions",
    f"{BASE} SELECT {', '.join(f'{c}::VARCHAR AS {c}' if c in _TEXT_IDS else c for c in _RAW)} FROM tx",
)
def csv_transactions(spark, folder):
    """All payments as CSV text with a header, read with the declared schema and parsed."""
    path = new_path(spark, "transactions-csv")
    raw = payments(spark, folder).withColumn("ts", F.date_format("ts", TIMESTAMP_PATTERN))
    writers.write_csv(raw.select(*_RAW), path)
    parsed = parse_timestamp(readers.read_transactions_csv(spark, path))
    return parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "csv_accounts",
    """SELECT c_nationkey::VARCHAR AS bank, c_custkey::VARCHAR AS account, c_name AS name, NULL::VARCHAR AS street,
    NULL::VARCHAR AS city, c_mktsegment AS state, n_name AS country, NULL::VARCHAR AS zip
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def csv_accounts(spark, folder):
    customers = readers.read_table(spark, f"{folder}/customer.parquet")
    nations = readers.read_table(spark, f"{folder}/nation.parquet", ["n_nationkey", "n_name"])
    missing = F.lit(None).cast("string")
    named = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_nationkey").alias("bank"),
        F.col("c_custkey").alias("account"),
        F.col("c_name").alias("name"),
        missing.alias("street"),
        missing.alias("city"),
        F.col("c_mktsegment").alias("state"),
        F.col("n_name").alias("country"),
        missing.alias("zip"),
    )
    path = new_path(spark, "accounts-csv")
    writers.write_csv(named, path)
    return readers.read_accounts_csv(spark, path)


@query("parquet_overwrite", f"{BASE} SELECT {', '.join(_SCORES)} FROM scored")
def parquet_overwrite(spark, folder):
    """The second write replaces the first; formats become folders."""
    path = new_path(spark, "scored-parquet")
    scored = materialize(_scored(spark, folder).select(*_SCORES), "scored")
    for _ in range(2):
        writers.write_table(scored, path, partition_by=["payment_format"])
    return readers.read_table(spark, path, _SCORES)


@query("json_scores", f"{BASE} SELECT {', '.join(_SCORES)} FROM scored")
def json_scores(spark, folder):
    path = new_path(spark, "scored-json")
    scored = _scored(spark, folder).select(*_SCORES)
    writers.write_json(scored, path)
    return spark.read.schema(scored.schema).json(path)


@query(
    "newest_report_run",
    f"""{BASE}, {CASE_TABLES} SELECT case_type, count(*) AS n, round(sum(risk_score), 4) AS total_score,
    (SELECT count(*) FROM chosen) AS n_reports FROM chosen GROUP BY 1""",
)
def newest_report_run(spark, folder):
    """Two runs are stored side by side; only the newest is read."""
    path = new_path(spark, "report-runs")
    reports = materialize(cases.case_reports(_scored(spark, folder)), "reports")
    for run, rows in (("2001-07-01", cases.reports_of_type(reports, "FN")), ("2001-08-01", reports)):
        writers.write_reports(rows, path, run)
    latest = readers.read_latest_reports(spark, path)
    return latest.groupBy("case_type", "n_reports").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("risk_score"), 4).alias("total_score")
    )


@query(
    "amounts_from_log",
    f"""{BASE} SELECT ts, from_account, to_account, amount_paid, payment_format, is_laundering,
    round(exp(amount_log) - 1e0, 0) AS amount_back FROM rowf""",
)
def amounts_from_log(spark, folder):
    kept = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "is_laundering"]
    rows = add_row_features(payments(spark, folder))
    return rows.select(*kept, amount_from_log(F.col("amount_log")).alias("amount_back"))
