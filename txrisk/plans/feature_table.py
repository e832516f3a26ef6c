"""The eighteen-feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import fixed_values as fv
from txrisk.functions import row_features as rf
from txrisk.functions.scalars import flag
from txrisk.operators.cleaning import fill_history
from txrisk.operators.history import (
    History,
    amount_zscore,
    attach_history,
    fit_history,
    high_fan_out,
)
from txrisk.operators.hot_keys import HotKeys
from txrisk.sources.payment_store import PaymentStore

CARRY = [
    "from_account",
    "to_account",
    "from_bank",
    "to_bank",
    "amount_paid",
    "ts",
    "is_laundering",
    "payment_format",
    "payment_currency",
]


def transform(
    rows: DataFrame,
    history: History,
    high_fan_out_limit: int = fv.HIGH_FAN_OUT,
    fill: bool = True,
    extra: tuple[str, ...] = (),
    hot: HotKeys | None = None,
) -> DataFrame:
    """Row features plus fitted history for any table or stream of payments; keys listed
    in ``hot`` are split over many tasks."""
    joined = attach_history(rf.add_row_features(rows), history, hot)
    return finish(joined, history, high_fan_out_limit, fill, extra)


def transform_stored(store: PaymentStore, history: History, **options) -> DataFrame:
    """The same for stored payments, which stay in their buckets."""
    return finish(rf.add_row_features(store.with_history(history)), history, **options)


def finish(
    joined: DataFrame,
    history: History,
    high_fan_out_limit: int = fv.HIGH_FAN_OUT,
    fill: bool = True,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Derived columns, neutral values and column order, once history is attached."""
    derived: dict[str, Column] = {}
    if history.bank is not None:
        derived["amount_zscore_per_bank"] = amount_zscore()
    if history.sender is not None:
        derived["is_high_fan_out"] = high_fan_out(high_fan_out_limit)
    table = joined.withColumns(derived) if derived else joined
    if fill:
        table = fill_history(table)
    features = [name for name in fv.FEATURES if name in table.columns]
    return table.select(*features, *CARRY, *extra)


def feature_table(tx: DataFrame, **options) -> DataFrame:
    """Features with history fitted on the whole table."""
    return transform(tx, fit_history(tx), **options)


def request_features(requests: DataFrame, history: History | None = None) -> DataFrame:
    """Features of scoring requests, which carry no history of their own.

    Every value the request cannot supply takes its neutral default; fitted
    history, where given and where it knows the key, takes precedence.
    """
    amount, velocity = F.col("amount"), F.greatest(F.col("tx_velocity"), F.lit(1))
    known: dict[str, Column] = {}
    if history is not None:
        if history.bank is not None:
            requests = requests.join(
                history.bank.select(
                    "from_bank",
                    F.col("bank_avg_amount"),
                    F.col("bank_std_amount"),
                    (F.col("bank_risk_score") / 100.0).alias("_bank_risk"),
                    F.col("is_hub_bank").alias("_hub"),
                ),
                "from_bank",
                "left",
            )
            known["bank_risk_score"] = F.col("_bank_risk")
            known["is_hub_bank"] = F.col("_hub")
            deviation = F.when(F.col("bank_std_amount") > 0, F.col("bank_std_amount")).otherwise(1.0)
            known["amount_zscore_per_bank"] = F.round((amount - F.col("bank_avg_amount")) / deviation, 4)

    def default(name: str) -> Column:
        fallback = F.lit(fv.REQUEST_DEFAULTS[name])
        return F.coalesce(known[name], fallback) if name in known else fallback

    values = {
        "is_cross_border": flag(F.col("from_bank") != F.col("to_bank")),
        "hour_of_day": default("hour_of_day"),
        "is_peak_hour": flag(default("hour_of_day").between(*fv.PEAK_HOURS)),
        "day_of_week": default("day_of_week"),
        "is_weekend": default("is_weekend"),
        "payment_format_risk": rf.payment_format_risk(F.col("payment_format")),
        "currency_risk_score": rf.currency_risk_score(F.col("currency")),
        "amount_log": rf.amount_log(amount),
        "is_near_threshold": rf.is_near_threshold(amount),
        "fan_out_degree": F.col("fan_out").cast(T.LongType()),
        "fan_in_degree": default("fan_in_degree").cast(T.LongType()),
        "amount_per_tx": F.round(amount / velocity, 2),
        "amount_zscore_per_bank": default("amount_zscore_per_bank"),
        "bank_risk_score": default("bank_risk_score"),
        "is_high_fan_out": flag(F.col("fan_out") > fv.HIGH_FAN_OUT),
        "is_in_cycle": default("is_in_cycle"),
        "is_hub_bank": default("is_hub_bank"),
    }
    carried = [F.col(c) for c in ("payment_format", "amount", "from_bank", "to_bank", "currency")]
    columns = [
        F.col("tx_velocity").cast(T.LongType()).alias(name) if name == "tx_velocity" else values[name].alias(name)
        for name in fv.FEATURES
    ]
    return requests.select(*columns, *carried)
