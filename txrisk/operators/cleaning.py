"""Cleaning, typed parsing, validation and column selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv

KEY_COLUMNS = ["from_account", "to_account", "amount_paid", "is_laundering"]
TIMESTAMP_PATTERN = "yyyy/MM/dd HH:mm"


def drop_incomplete(tx: DataFrame, keys: list[str] = KEY_COLUMNS) -> DataFrame:
    return tx.dropna(subset=keys)


def parse_timestamp(tx: DataFrame, column: str = "ts", pattern: str = TIMESTAMP_PATTERN) -> DataFrame:
    """Parse by pattern; text that does not fit becomes null, it never raises."""
    return tx.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(pattern)))


def reject_reasons(tx: DataFrame, keys: list[str] = KEY_COLUMNS, raw_ts: str | None = "ts") -> Column:
    """Array of the reasons why a raw row cannot be used."""
    checks = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in keys]
    if raw_ts:
        parsed = F.try_to_timestamp(F.col(raw_ts), F.lit(TIMESTAMP_PATTERN))
        checks.append(F.when(parsed.isNull(), F.lit(f"bad {raw_ts}")))
    return F.array_compact(F.array(*checks))


def split_rejects(tx: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their reasons)."""
    marked = tx.withColumn("reasons", reasons)
    good = marked.where(F.size("reasons") == 0).drop("reasons")
    return good, marked.where(F.size("reasons") > 0)


def request_violations() -> Column:
    """Array of the rules a scoring request breaks."""
    required = ["payment_format", "amount", "from_bank", "to_bank", "currency", "fan_out", "tx_velocity"]
    checks = [F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in required]
    checks += [
        F.when(F.col("amount") <= 0, F.lit("amount not positive")),
        F.when(F.col("fan_out") < 1, F.lit("fan_out below 1")),
        F.when(F.col("tx_velocity") < 1, F.lit("tx_velocity below 1")),
    ]
    return F.array_compact(F.array(*checks))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def select_existing(df: DataFrame, wanted: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Select the wanted columns that exist; the missing ones are reported."""
    wanted = list(wanted)
    missing = [name for name in wanted if name not in df.columns]
    return df.select(*[name for name in wanted if name not in missing]), missing


def drop_scratch(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def fill_history(df: DataFrame, fills: dict = fv.HISTORY_FILL) -> DataFrame:
    return df.fillna({name: value for name, value in fills.items() if name in df.columns})
