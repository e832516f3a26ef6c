"""Plain-language text from feature values, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.scalars import fx_rate_text, lookup, plain_name, size_band, with_commas


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled by columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def listed(*pieces: tuple[Column, Column]) -> Column:
    """Array of the texts whose condition holds, in the given order.

    ``array_except`` drops the nulls inside generated code; ``array_compact`` is a
    higher-order function and would be interpreted, once per use of each text.
    """
    chosen = F.array(*[F.when(condition, text) for condition, text in pieces])
    return F.array_except(chosen, F.array(F.lit(None).cast("string")))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


# --- decoding and bands ----------------------------------------------------
def payment_name(risk: Column) -> Column:
    return lookup(risk, fv.PAYMENT_NAME, "Unknown")


def payment_description(risk: Column) -> Column:
    return lookup(risk, fv.PAYMENT_DESCRIPTION, fv.PAYMENT_DESCRIPTION_DEFAULT)


def currency_description(risk: Column) -> Column:
    return lookup(risk, fv.CURRENCY_DESCRIPTION, fv.CURRENCY_DESCRIPTION_DEFAULT)


def velocity_description(velocity: Column) -> Column:
    number = F.when(velocity < fv.VELOCITY_COMMAS_FROM, velocity.cast("string")).otherwise(with_commas(velocity))
    chain = F
    for limit, text in fv.VELOCITY_DESCRIPTION:
        filled = fill(text, v=number)
        chain = chain.when(velocity < limit, filled) if limit is not None else chain.otherwise(filled)
    return chain


def fan_out_description(fan: Column) -> Column:
    chain = F
    for limit, text in fv.FAN_OUT_DESCRIPTION:
        filled = fill(text, n=fan)
        chain = chain.when(fan <= limit, filled) if limit is not None else chain.otherwise(filled)
    return chain


def bank_description(risk: Column, percent: bool = True) -> Column:
    """Band of the bank risk; ``percent`` says in which unit the column is."""
    value = risk / 100.0 if percent else risk
    chain = F
    for limit, text in fv.BANK_DESCRIPTION:
        chain = chain.when(value < limit, text) if limit is not None else chain.otherwise(text)
    return chain


def confidence(score: Column, moderate_from: float = 0.70) -> Column:
    return (
        F.when(score >= 0.95, "very high")
        .when(score >= 0.85, "high")
        .when(score >= moderate_from, "moderate")
        .otherwise("low")
    )


def strength(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size > 1.5, "strongly").when(size > 0.5, "moderately").otherwise("slightly")


# --- sentences -------------------------------------------------------------
def driver_sentence(driver: Column, payment: Column, fan: Column) -> Column:
    values = {
        "strength": strength(driver["shap_val"]),
        "direction": F.when(driver["shap_val"] > 0, "increased").otherwise("reduced"),
        "payment": payment,
        "fan": fan,
        "name": plain_name(driver["feature"]),
    }
    chain = F
    for feature, template in fv.DRIVER_SENTENCES.items():
        chain = chain.when(driver["feature"] == feature, fill(template, **values))
    return chain.otherwise(fill(fv.DRIVER_SENTENCE_DEFAULT, **values))


def driver_sentences(drivers: Column, payment: Column, fan: Column, n: int = 3, min_abs: float = 0.0) -> Column:
    """Sentences for the first ``n`` drivers; ``min_abs`` leaves out weak ones."""
    if min_abs > 0:
        drivers = F.filter(drivers, lambda d: F.abs(d["shap_val"]) > min_abs)
    return F.transform(F.slice(drivers, 1, n), lambda d: driver_sentence(d, payment, fan))


# --- report ----------------------------------------------------------------
def _risk_level(value: Column, high: int, moderate: int) -> Column:
    return (
        F.when(value >= high, "high-risk").when(value == moderate, "moderate-risk").otherwise("low-risk")
    )


def _amount_text(native: Column, usd: Column, currency: Column) -> Column:
    values = {
        "usd": with_commas(F.round(usd)),
        "plain": F.call_function("format_number", native, F.lit("0.##########")),
        "native": F.call_function("format_number", native, F.lit("#,##0.##")),
        "symbol": lookup(currency, fv.CURRENCY_SYMBOL, fv.CURRENCY_SYMBOL_DEFAULT),
        "currency": currency,
        "rate": fx_rate_text(currency),
    }
    foreign = F.coalesce(currency != "US Dollar", F.lit(False))
    return (
        F.when(native.isNull() | (native == 0), fv.REPORT["amount_none"])
        .when(~foreign, fill(fv.REPORT["amount_usd"], **values))
        .when(currency == "Bitcoin", fill(fv.REPORT["amount_crypto"], **values))
        .otherwise(fill(fv.REPORT["amount_foreign"], **values))
    )


def _margin_text(score: Column, threshold: float) -> Column:
    """Points below the threshold with one decimal, rounded half up on the
    four-decimal score."""
    units = F.round((F.lit(threshold) - score) * 10000.0).cast("bigint")
    tenths = F.floor((units + 5) / 10)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _sentence_pair(reasons: Column) -> Column:
    first, second = F.get(reasons, F.lit(0)), F.get(reasons, F.lit(1))
    return F.when(
        F.size(reasons) >= 2, F.concat(capital(first), F.lit(", and "), second, F.lit(". "))
    ).otherwise("")


def _report_values(threshold: float) -> dict[str, Column]:
    """What the report texts are filled with."""
    score, currency = F.col("risk_score"), F.col("payment_currency")
    pfr, cr, fan = F.col("payment_format_risk"), F.col("currency_risk_score"), F.col("fan_out_degree")
    return {
        "payment": payment_name(pfr),
        "payment_level": _risk_level(pfr, 3, 2),
        "currency": F.coalesce(currency, F.lit("")),
        "currency_level": _risk_level(cr, 4, 3),
        "amount": _amount_text(F.col("amount_paid"), F.col("amount_usd"), currency),
        "size": size_band(F.col("amount_usd")),
        "fan": fan.cast("string"),
        "velocity": with_commas(F.col("tx_velocity")),
        "confidence": capital(confidence(score, 0.65)),
        "margin": _margin_text(score, threshold),
        "plural": F.when(fan == 1, "").otherwise("s"),
    }


def add_case_report(
    scored: DataFrame, column: str = "explanation", threshold: float = fv.SCORECARD_THRESHOLD
) -> DataFrame:
    """Template report for every row, in the flagged or the cleared variant.

    The texts share their values, so these are projected first and computed once.
    """
    shared = {f"_report_{name}": value for name, value in _report_values(threshold).items()}
    values = {name: F.col(f"_report_{name}") for name in _report_values(threshold)}
    return scored.withColumns(shared).withColumn(column, _report(values, threshold)).drop(*shared)


def _report(values: dict[str, Column], threshold: float) -> Column:
    r = fv.REPORT
    score, currency = F.col("risk_score"), F.col("payment_currency")
    pfr, cr = F.col("payment_format_risk"), F.col("currency_risk_score")
    fan, velocity = F.col("fan_out_degree"), F.col("tx_velocity")
    near, cross = F.col("is_near_threshold") == 1, F.col("is_cross_border") == 1
    foreign = F.coalesce(currency != "US Dollar", F.lit(False))
    crypto = F.coalesce(currency == "Bitcoin", F.lit(False))
    many = fan > 20

    def text(key: str, **more: Column) -> Column:
        return fill(r[key], **{**values, **more})

    def bank(name: str, fallback: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(r[fallback]))

    origin = F.when(foreign, values["amount"]).otherwise(text("origin_usd"))

    def currency_note(variant: str) -> Column:
        conversion = (
            F.when(crypto, r[f"conversion_crypto_{variant}"])
            .when(foreign, r[f"conversion_foreign_{variant}"])
            .otherwise("")
        )
        return fill(r["currency_note"], origin=origin, conversion=conversion)

    # flagged
    compound = listed(
        (cross, text("compound_cross")),
        (near, text("compound_near")),
        (many, text("compound_fan")),
        (cr >= 4, text("compound_currency")),
    )
    compound_text = F.when(
        F.size(compound) > 0, F.concat(F.lit(r["compound_lead"]), F.array_join(compound, " and "))
    ).otherwise("")
    found = listed(
        (pfr == 3, text("evidence_payment")),
        (near, text("evidence_near")),
        (
            cross,
            text(
                "evidence_cross",
                from_bank=bank("from_bank", "sending_bank"),
                to_bank=bank("to_bank", "other_bank"),
            ),
        ),
        (many, text("evidence_fan")),
        (cr >= 4, text("evidence_currency")),
    )
    evidence = F.slice(F.array_append(found, F.lit(r["evidence_fallback"])), 1, 2)
    note = F.concat(
        F.lit(r["note_flagged"]),
        F.when(near, text("note_near")).otherwise(""),
        F.when(many, text("note_fan")).otherwise(""),
        F.when(cross, text("note_cross", to_bank=bank("to_bank", "receiving_bank"))).otherwise(
            r["note_same_bank"]
        ),
    )
    flagged_report = F.concat_ws(
        "\n\n",
        text("status_flagged"),
        currency_note("flagged"),
        text("concern_flagged", compound=compound_text),
        F.concat(F.lit(r["evidence_lead"]), F.array_join(evidence, " ")),
        note,
    )

    # cleared
    reasons = listed(
        (pfr <= 1, text("clear_payment")),
        (~cross, text("clear_same_bank")),
        (~near, text("clear_amount")),
        (fan <= 5, text("clear_fan")),
        (cr <= 2, text("clear_currency")),
    )
    concern = F.when(
        F.size(reasons) > 0, F.concat(capital(F.get(reasons, F.lit(0))), F.lit("."))
    ).otherwise(r["concern_normal"])
    cleared_report = F.concat_ws(
        "\n\n",
        F.lit(r["status_cleared"]),
        currency_note("cleared"),
        F.concat(F.lit(r["concern_cleared"]), concern),
        F.concat(F.lit(r["evidence_lead"]), _sentence_pair(reasons), text("clear_margin")),
        F.concat(
            F.lit(r["note_cleared"]),
            F.when(velocity > 500, text("note_volume")).otherwise(r["note_routine"]),
        ),
    )
    return F.when(score >= threshold, flagged_report).otherwise(cleared_report)


# --- consistency check -----------------------------------------------------
def text_issues(text: Column, batch: bool = False) -> Column:
    """Array of the contradictions between a text and its row's flags."""
    lower = F.lower(text)

    def says(word: str) -> Column:
        return lower.contains(word.lower())

    checks: list[tuple[Column, Column]] = []
    if not batch:
        checks += [(says(term), F.lit(fv.ISSUE_TERM + term)) for term in fv.BANNED_TERMS]
        checks.append((text.rlike(fv.DOLLAR_FIGURE_PATTERN), F.lit(fv.ISSUE_DOLLAR)))
    else:
        figures = F.regexp_extract_all(text, F.lit(f"({fv.DOLLAR_FIGURE_PATTERN_BATCH})"), F.lit(1))
        checks.append(
            (F.size(figures) > 0, F.concat(F.lit(fv.ISSUE_DOLLAR_BATCH), F.array_join(figures, " ")))
        )
    checks += [
        (says("per hour") | says("per minute"), F.lit(fv.ISSUE_RATE)),
        ((F.col("is_near_threshold") == 0) & says("structur"), F.lit(fv.ISSUE_STRUCTURING)),
        ((F.col("is_cross_border") == 0) & says("cross-border"), F.lit(fv.ISSUE_CROSS_BORDER)),
        ((F.col("is_in_cycle") == 0) & says("circular"), F.lit(fv.ISSUE_CIRCULAR)),
    ]
    return listed(*checks)


def with_warning(text: Column, issues: Column) -> Column:
    """The text, followed by a warning line when there are issues."""
    warning = F.concat(F.lit(fv.WARNING_PREFIX), F.array_join(issues, "; "))
    return F.concat(text, F.when(F.size(issues) > 0, warning).otherwise(""))


