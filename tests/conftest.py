import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from txrisk.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        driver_memory="6g",
        log_level="ERROR",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


TX_COLUMNS = (
    "ts string, from_account string, to_account string, from_bank string, to_bank string, amount_paid double, "
    "payment_format string, payment_currency string, receiving_currency string, is_laundering int"
)


@pytest.fixture(scope="session")
def make_tx(spark):
    """Payments from short tuples; missing places take defaults."""
    defaults = ("2024-01-01 12:00:00", "A", "B", "x", "y", 100.0, "ACH", "US Dollar", "US Dollar", 0)
    names = [c.split()[0] for c in TX_COLUMNS.split(", ")]

    def build(rows):
        full = [tuple({**dict(zip(names, defaults)), **row}[n] for n in names) for row in rows]
        df = spark.createDataFrame(full, TX_COLUMNS)
        return df.withColumn("ts", df.ts.cast("timestamp_ntz"))

    return build


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
