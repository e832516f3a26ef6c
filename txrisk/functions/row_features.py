"""Features that depend on one row only: a single narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.scalars import flag, lookup


def payment_format_risk(payment_format: Column) -> Column:
    return lookup(payment_format, fv.PAYMENT_FORMAT_RISK, fv.PAYMENT_FORMAT_RISK_DEFAULT)


def currency_risk_score(currency: Column) -> Column:
    return lookup(currency, fv.CURRENCY_RISK, fv.CURRENCY_RISK_DEFAULT)


def in_half_open(amount: Column, low: float, high: float) -> Column:
    return (amount >= low) & (amount < high)


def is_near_threshold(amount: Column) -> Column:
    return flag(in_half_open(amount, *fv.STRUCTURING_RANGE))


def amount_log(amount: Column) -> Column:
    return F.round(F.log1p(amount), 4)


def row_feature_columns(peak_hours: tuple[int, int] = fv.PEAK_HOURS) -> dict[str, Column]:
    hour, day = F.hour("ts"), F.dayofweek("ts")
    return {
        "is_cross_border": flag(F.col("from_bank") != F.col("to_bank")),
        "hour_of_day": hour,
        "is_peak_hour": flag(hour.between(*peak_hours)),
        "day_of_week": day,
        "is_weekend": flag(day.isin(1, 7)),
        "payment_format_risk": payment_format_risk(F.col("payment_format")),
        "currency_risk_score": currency_risk_score(F.col("payment_currency")),
        "amount_log": amount_log(F.col("amount_paid")),
        "is_near_threshold": is_near_threshold(F.col("amount_paid")),
    }


def add_row_features(tx: DataFrame, peak_hours: tuple[int, int] = fv.PEAK_HOURS) -> DataFrame:
    return tx.withColumns(row_feature_columns(peak_hours))
