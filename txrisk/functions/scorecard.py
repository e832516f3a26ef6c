"""Additive rule scorecard and its per-row explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.scalars import clamp, flag, verdict


def scorecard_terms(amount_usd: str = "amount_usd") -> dict[str, Column]:
    """The additive terms, in the order in which they are summed."""
    fan, velocity = F.col("fan_out_degree"), F.col("tx_velocity")
    amount = F.col(amount_usd)
    crypto_spread = (F.col("payment_format") == "Bitcoin") & (fan > 50)
    return {
        "payment_format": F.col("payment_format_risk") * F.lit(0.16),
        "fan_out": F.least(fan / F.lit(60.0), F.lit(0.22)),
        "velocity": F.least(velocity / F.lit(2000.0), F.lit(0.10)),
        "amount": F.when(amount > 100000, 0.10)
        .when(amount > 10000, 0.06)
        .when(amount > 1000, 0.03)
        .otherwise(0.01),
        "crypto_spread": F.when(crypto_spread, 0.08).otherwise(0.0),
        "cross_border": F.col("is_cross_border") * F.lit(0.03),
        "currency": F.col("currency_risk_score") * F.lit(0.02),
        "near_threshold": F.col("is_near_threshold") * F.lit(0.01),
    }


def scorecard(amount_usd: str = "amount_usd", digits: int = 4) -> Column:
    total = F.lit(0.0)
    for term in scorecard_terms(amount_usd).values():
        total = total + term
    return F.round(clamp(total), digits)


def with_score(
    features: DataFrame,
    threshold: float = fv.SCORECARD_THRESHOLD,
    amount_usd: str = "amount_usd",
) -> DataFrame:
    scored = features.withColumn("risk_score", scorecard(amount_usd))
    return scored.withColumns(
        {
            "verdict": verdict(F.col("risk_score"), threshold),
            "threshold": F.lit(float(threshold)),
        }
    )


def signed_contributions() -> dict[str, Column]:
    """The five named contributions shown to a reader, centred per feature."""
    return {
        "payment_format_risk": F.col("payment_format_risk") * F.lit(0.8),
        "currency_risk_score": (F.col("currency_risk_score") - 3) * F.lit(0.15),
        "is_cross_border": F.when(F.col("is_cross_border") == 1, 0.3).otherwise(-0.2),
        "fan_out_degree": F.least(F.col("fan_out_degree") / F.lit(50.0), F.lit(2.0)) - 0.3,
        "is_near_threshold": F.col("is_near_threshold") * F.lit(0.3),
    }


def linear_attribution(weights: dict[str, float], means: dict[str, float]) -> dict[str, Column]:
    """Exact attribution of a linear model: weight times distance to the mean."""
    return {
        name: (F.col(name).cast("double") - F.lit(float(means[name]))) * F.lit(float(weight))
        for name, weight in weights.items()
    }


def top_drivers(contributions: dict[str, Column], n: int = 5, digits: int = 4) -> Column:
    """The ``n`` contributions of largest size; equal sizes keep the given order.

    Sorting is done inside the row on a (size, position) key. ``sort_array`` and
    plain element access stay in generated code, unlike ``array_sort`` and
    ``transform``.
    """
    ranked = F.sort_array(
        F.array(
            *[
                F.struct(
                    (-F.abs(value)).cast("double").alias("size"),
                    F.lit(position).alias("position"),
                    F.lit(name).alias("feature"),
                    F.round(value.cast("double"), digits).alias("shap_val"),
                    F.when(value > 0, "increases").otherwise("decreases").alias("direction"),
                )
                for position, (name, value) in enumerate(contributions.items())
            ]
        )
    )
    fields = ("feature", "shap_val", "direction")
    return F.array(
        *[
            F.struct(*[ranked[place][name].alias(name) for name in fields])
            for place in range(min(n, len(contributions)))
        ]
    )


def contribution_total(terms: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for term in terms.values():
        total = total + term
    return total


def is_flagged(threshold: float = fv.SCORECARD_THRESHOLD) -> Column:
    return flag(F.col("risk_score") >= threshold)
