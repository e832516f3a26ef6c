"""Small shared column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk import fixed_values as fv


def lookup(key: Column, table: dict, default) -> Column:
    """Value of ``key`` in a fixed table, else ``default`` (also for null keys)."""
    groups: dict = {}
    for name, value in table.items():
        groups.setdefault(value, []).append(name)
    chain = None
    for value, names in groups.items():
        hit = key.isin(names)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(F.lit(default))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as 0)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def guarded_div(top: Column, bottom: Column) -> Column:
    """Division that gives null, not an error, for a zero or null divisor."""
    return F.when(bottom != 0, top / bottom)


def mean_of_sum(total: Column, n: Column, digits: int = 4) -> Column:
    """Rounded mean. The sum is cleared of the noise that depends on the order of
    addition first, so that a mean on a rounding edge always falls alike."""
    return F.round(F.round(total, 6) / n, digits)


def share_pct(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(guarded_div(part.cast("double"), whole.cast("double")) * 100.0, digits)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")), F.lit(0).cast("bigint"))


def fx_rate(currency: Column) -> Column:
    rates = {name: rate for name, (rate, _) in fv.FX_TO_USD.items()}
    return lookup(currency, rates, fv.FX_DEFAULT[0])


def fx_rate_text(currency: Column) -> Column:
    texts = {name: text for name, (_, text) in fv.FX_TO_USD.items()}
    return lookup(currency, texts, fv.FX_DEFAULT[1])


def to_usd(amount: Column, currency: Column) -> Column:
    return amount * fx_rate(currency)


def size_band(amount: Column) -> Column:
    return (
        F.when(amount < 1000, "small")
        .when(amount < 10000, "moderate")
        .when(amount < 100000, "large")
        .otherwise("very large")
    )


def amount_from_log(amount_log: Column, base: float | None = None) -> Column:
    """Undo log1p. ``base=2.718`` reproduces readers that used a short e."""
    real = F.expm1(amount_log) if base is None else F.pow(F.lit(base), amount_log) - 1.0
    return F.round(real, 0)


def decile(score: Column) -> Column:
    return F.least(F.floor(score * 10.0), F.lit(9)).cast("int")


def decile_label(bucket: Column) -> Column:
    low = (bucket * 10).cast("string")
    high = ((bucket + 1) * 10).cast("string")
    return F.concat(low, F.lit("-"), high, F.lit("%"))


def verdict(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "FLAGGED").otherwise("CLEARED")


def case_type(score: Column, label: Column, threshold: float) -> Column:
    flagged = score >= threshold
    return (
        F.when(flagged & (label == 1), "TP")
        .when(flagged & (label == 0), "FP")
        .when(~flagged & (label == 1), "FN")
        .when(~flagged & (label == 0), "TN")
    )


def needs_escalation(
    fan_out: Column,
    velocity: Column,
    min_fan_out: int = fv.ESCALATE_FAN_OUT,
    min_velocity: int = fv.ESCALATE_VELOCITY,
) -> Column:
    """Rule that sends a payment to manual review whatever its score is."""
    return flag((fan_out > min_fan_out) & (velocity > min_velocity))


def pair_label(src: Column, dst: Column) -> Column:
    return F.concat_ws(" → ", src.cast("string"), dst.cast("string"))


def plain_name(feature: Column) -> Column:
    return F.initcap(F.replace(feature, F.lit("_"), F.lit(" ")))


def with_commas(whole: Column) -> Column:
    return F.format_number(whole.cast("bigint"), 0)
