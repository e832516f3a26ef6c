"""Drivers, reports and text checks."""

import pytest
from pyspark.sql import functions as F

from txrisk.functions import text
from txrisk.functions.scorecard import (
    contribution_total,
    linear_attribution,
    scorecard_terms,
    signed_contributions,
    top_drivers,
)
from txrisk.operators import cases
from txrisk.plans.catalog_texts import count_and_first_digest

BASE = {
    "risk_score": 0.9,
    "payment_format_risk": 3,
    "currency_risk_score": 5,
    "is_cross_border": 1,
    "is_near_threshold": 1,
    "is_in_cycle": 0,
    "fan_out_degree": 25,
    "tx_velocity": 80,
    "payment_format": "ACH",
    "payment_currency": "UK Pound",
    "from_bank": "b1",
    "to_bank": "b2",
    "amount_paid": 7000.5,
    "amount_usd": 8890.635,
}
SCHEMA = (
    "risk_score double, payment_format_risk int, currency_risk_score int, is_cross_border int, is_near_threshold int, "
    "is_in_cycle int, fan_out_degree long, tx_velocity long, payment_format string, payment_currency string, "
    "from_bank string, to_bank string, amount_paid double, amount_usd double"
)


@pytest.fixture
def row(spark):
    def build(**changes):
        values = {**BASE, **changes}
        return spark.createDataFrame([tuple(values[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)

    return build


def report(df):
    return text.add_case_report(df).first().explanation.split("\n\n")


def test_flagged_report(row):
    status, note, concern, evidence, advice = report(row())
    amount = "£7,000.5 UK Pound (approximately $8,891 USD equivalent, at an approximate rate of 1 UK Pound = $1.27 USD)"
    assert status == "ALERT STATUS: FLAGGED — High-confidence suspicious activity detected"
    assert note.startswith(f"CURRENCY NOTE: Transaction originated as {amount}. All amounts have been converted")
    assert concern == (
        "PRIMARY CONCERN: The use of ACH as the payment method is the strongest indicator of risk here, further "
        "compounded by an inter-bank transfer and a structuring-range amount and a high number of recipients and "
        "high-risk currency."
    )
    assert evidence.startswith("SUPPORTING EVIDENCE: ACH is a high-risk payment method")
    assert evidence.endswith("mandatory $10,000 reporting threshold.")
    assert "whether " + amount in advice and "25 recipient accounts" in advice and "records from b2" in advice


def test_flagged_report_without_other_factors(row):
    plain = row(is_cross_border=0, is_near_threshold=0, fan_out_degree=2, currency_risk_score=3, payment_currency="US Dollar")
    _, note, concern, evidence, advice = report(plain)
    assert note == "CURRENCY NOTE: Transaction originated as a moderate USD transaction. "
    assert concern.endswith("risk here.")
    assert evidence.endswith("in the training dataset.")
    assert advice.endswith("pending review.")


def test_cleared_report(row):
    clear = row(risk_score=0.4025, payment_format_risk=0, is_cross_border=0, is_near_threshold=0, fan_out_degree=1,
                currency_risk_score=1, payment_currency="Bitcoin", tx_velocity=1500, amount_paid=0.25, amount_usd=24000.0)
    status, note, concern, evidence, advice = report(clear)
    assert status == "ALERT STATUS: CLEARED — No suspicious activity detected"
    assert "0.25 BTC (approximately $24,000 USD at the time of the transaction)" in note
    assert concern == "PRIMARY CONCERN: None. Wire / Reinvestment is a low-risk payment method with strong traceability."
    assert ", and both sender and receiver" in evidence and "24.8 points below" in evidence
    assert "1,500 total transactions" in advice


def test_cleared_report_with_no_reason(row):
    busy = row(risk_score=0.1, payment_format_risk=2)
    _, _, concern, evidence, _ = report(busy)
    assert concern.endswith("normal behavioural parameters.")
    assert evidence.startswith("SUPPORTING EVIDENCE: The overall risk level is 55.0 points")


def test_zero_amount(row):
    assert "an unspecified amount" in report(row(amount_paid=0.0))[1]


def test_drivers_are_ranked_by_size_then_position(row):
    drivers = row(fan_out_degree=30).select(top_drivers(signed_contributions())).first()[0]
    assert [(d.feature, d.shap_val, d.direction) for d in drivers] == [
        ("payment_format_risk", 2.4, "increases"),
        ("currency_risk_score", 0.3, "increases"),
        ("is_cross_border", 0.3, "increases"),
        ("fan_out_degree", 0.3, "increases"),
        ("is_near_threshold", 0.3, "increases"),
    ]


def test_published_case_keeps_its_driver_order(spark):
    """Attribution values of a published sample case."""
    values = {"payment_format_risk": 2.6847, "is_in_cycle": 2.1013, "bank_risk_score": 1.9636,
              "is_cross_border": -1.3646, "fan_out_degree": -0.9839}
    shuffled = {k: F.lit(values[k]) for k in sorted(values)}
    drivers = spark.range(1).select(top_drivers(shuffled)).first()[0]
    assert [(d.feature, d.shap_val) for d in drivers] == list(values.items())
    assert [d.direction for d in drivers] == ["increases"] * 3 + ["decreases"] * 2


def test_terms_add_up_and_linear_attribution_is_exact(row):
    total, score = row().select(contribution_total(scorecard_terms()), F.lit(1)).first()
    assert total == pytest.approx(0.48 + 0.22 + 0.04 + 0.03 + 0.03 + 0.10 + 0.01)
    parts = linear_attribution({"fan_out_degree": 2.0}, {"fan_out_degree": 20.0})
    assert row().select(parts["fan_out_degree"]).first()[0] == 10.0


@pytest.mark.parametrize("value,word", [(1.51, "strongly"), (1.5, "moderately"), (-0.51, "moderately"), (0.5, "slightly")])
def test_strength(spark, value, word):
    assert spark.range(1).select(text.strength(F.lit(value))).first()[0] == word


def test_driver_sentences(spark):
    drivers = "array(named_struct('feature', 'fan_out_degree', 'shap_val', -0.6D), named_struct('feature', 'hour_of_day', 'shap_val', 0.01D))"
    df = spark.range(1).select(F.expr(drivers).alias("d"))
    sentences = text.driver_sentences(F.col("d"), F.lit("ACH"), F.lit(7))
    assert df.select(sentences).first()[0] == [
        "The number of different recipients this account has sent to (7) moderately reduced the risk",
        "Hour Of Day slightly increased the risk",
    ]
    strong = text.driver_sentences(F.col("d"), F.lit("ACH"), F.lit(7), min_abs=0.05)
    assert len(df.select(strong).first()[0]) == 1


@pytest.mark.parametrize("risk,percent,words", [(9.9, True, "clean record"), (0.1, False, "minor historical concerns"),
                                                (29.0, True, "moderate laundering history")])
def test_bank_band_units(spark, risk, percent, words):
    assert spark.range(1).select(text.bank_description(F.lit(risk), percent)).first()[0] == words


def issues(row, body, **options):
    return row.select(text.text_issues(F.lit(body), **options)).first()[0]


def test_issues(row):
    clean = row(is_near_threshold=0, is_cross_border=0)
    assert issues(clean, "An ordinary transfer of a small amount.") == []
    assert issues(clean, "Shap says TX_VELOCITY is 9 per hour") == [
        "technical term leaked: SHAP", "technical term leaked: tx_velocity", "transaction count described as a rate"]
    assert issues(clean, "Structuring, cross-border and circular") == [
        "structuring mentioned but amount not near threshold",
        "cross-border mentioned but same-bank transaction",
        "circular pattern mentioned but none detected"]
    assert issues(row(is_in_cycle=1), "Structuring, cross-border and circular") == []
    assert issues(clean, "$99,999") == ["hallucinated large dollar amount"]
    assert issues(clean, "$9,999") == []
    assert issues(clean, "$9,999 and SHAP", batch=True) == ["hallucinated dollar amounts: $9,999"]


def test_warning_is_appended_only_for_issues(row):
    found = text.text_issues(F.col("body"))
    for body, tail in (("fine", "fine"), ("per hour", "per hour\n\nVALIDATION WARNING: transaction count described as a rate")):
        df = row().withColumn("body", F.lit(body))
        assert df.select(text.with_warning(F.col("body"), found)).first()[0] == tail


def test_reports_of_type(spark):
    reports = spark.createDataFrame([("TP",), ("FN",)], "case_type string")
    assert cases.reports_of_type(reports).count() == 2
    assert cases.reports_of_type(reports, "FN").count() == 1


def test_first_digests_need_no_sort_of_the_rows(spark):
    keyed = spark.range(3000).select((F.col("id") % 7).cast("string").alias("key"), F.md5(F.col("id").cast("string")).alias("md5"))
    ends = [("ends", "f" * 32), ("ends", "f" * 31 + "e"), ("zero", "0" * 32), ("zero", "0" * 31 + "1"), ("none", None), ("word", "0" * 15 + "f" * 17), ("word", "0" * 14 + "1" + "0" * 17)]
    rows = keyed.union(spark.createDataFrame(ends, "key string, md5 string"))
    found = count_and_first_digest(rows, "key", "md5")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(") == 2 and plan.count("SortAggregate(") == 2  # the latter on 16 rows a key
    wanted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("md5").alias("first_digest"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert found.schema["n"].dataType == wanted.schema["n"].dataType
