"""Batch scoring of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.scalars import needs_escalation, to_usd
from txrisk.functions.scorecard import with_score
from txrisk.operators.history import PARTS, History, fit_history
from txrisk.operators.hot_keys import HotKeys
from txrisk.plans.feature_table import transform
from txrisk.sources.prediction_log import to_log

# The scorecard looks at the sender's history only.
SCORECARD_PARTS = ("sender",)


def score_with(
    rows: DataFrame,
    history: History,
    threshold: float = fv.SCORECARD_THRESHOLD,
    extra: tuple[str, ...] = (),
    hot: HotKeys | None = None,
) -> DataFrame:
    """Features and scorecard for a table or stream, with fitted history."""
    table = transform(rows, history, extra=extra, hot=hot)
    table = table.withColumn("amount_usd", to_usd(F.col("amount_paid"), F.col("payment_currency")))
    return with_score(table, threshold)


def score_payments(
    tx: DataFrame,
    parts: tuple[str, ...] = SCORECARD_PARTS,
    threshold: float = fv.SCORECARD_THRESHOLD,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Score a table with history fitted on itself."""
    return score_with(tx, fit_history(tx, parts), threshold, extra)


def prediction_log(tx: DataFrame, threshold: float = fv.SCORECARD_THRESHOLD) -> DataFrame:
    """Scored payments in the shape of the prediction log. ``tx`` carries
    ``processing_ms``."""
    parts = tuple(p for p in PARTS if p != "receiver")
    return to_log(score_payments(tx, parts, threshold, extra=("processing_ms",)))


def escalations(scored: DataFrame, min_fan_out: int, min_velocity: int) -> DataFrame:
    rule = needs_escalation(F.col("fan_out_degree"), F.col("tx_velocity"), min_fan_out, min_velocity)
    return scored.withColumn("manual_review", rule)
