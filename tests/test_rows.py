import math

import pytest
from pyspark.sql import functions as F

from txrisk.functions import row_features as rf
from txrisk.functions.scalars import (
    amount_from_log,
    decile,
    decile_label,
    lookup,
    needs_escalation,
    plain_name,
    size_band,
    to_usd,
)
from txrisk.operators import cleaning, profiles


def features(make_tx, **row):
    return rf.add_row_features(make_tx([row])).first()


@pytest.mark.parametrize("amount,near", [(7999.99, 0), (8000.0, 1), (9999.99, 1), (10000.0, 0)])
def test_structuring_range_is_half_open(make_tx, amount, near):
    assert features(make_tx, amount_paid=amount).is_near_threshold == near


@pytest.mark.parametrize("hour,peak", [(10, 0), (11, 1), (13, 1), (14, 0)])
def test_peak_hours_are_closed(make_tx, hour, peak):
    row = features(make_tx, ts=f"2024-01-01 {hour:02d}:59:00")
    assert (row.hour_of_day, row.is_peak_hour) == (hour, peak)


@pytest.mark.parametrize("day,number,weekend", [("06", 7, 1), ("07", 1, 1), ("08", 2, 0)])
def test_days_count_from_sunday(make_tx, day, number, weekend):
    row = features(make_tx, ts=f"2024-01-{day} 00:00:00")
    assert (row.day_of_week, row.is_weekend) == (number, weekend)


@pytest.mark.parametrize("name,risk", [("ACH", 3), ("Bitcoin", 2), ("Cheque", 1), ("Wire", 0), ("Barter", 1), (None, 1)])
def test_format_risk(make_tx, name, risk):
    assert features(make_tx, payment_format=name).payment_format_risk == risk


@pytest.mark.parametrize("name,risk", [("Ruble", 5), ("Yen", 4), ("Rupee", 3), ("Bitcoin", 1), ("Dinar", 2), (None, 2)])
def test_currency_risk(make_tx, name, risk):
    assert features(make_tx, payment_currency=name).currency_risk_score == risk


def test_cross_border_with_unknown_bank_is_zero(make_tx):
    assert features(make_tx, from_bank=None).is_cross_border == 0
    assert features(make_tx, from_bank="y").is_cross_border == 0
    assert features(make_tx).is_cross_border == 1


def test_amount_log(make_tx):
    assert features(make_tx, amount_paid=0.0).amount_log == 0.0
    assert features(make_tx, amount_paid=1234.5).amount_log == round(math.log1p(1234.5), 4)


def test_small_scalars(spark):
    one = spark.range(1)
    row = one.select(
        decile(F.lit(1.0)).alias("top"),
        decile_label(F.lit(9)).alias("label"),
        lookup(F.lit(None).cast("string"), {"a": 1}, 7).alias("default"),
        to_usd(F.lit(100.0), F.lit("Yen")).alias("usd"),
        to_usd(F.lit(100.0), F.lit("Shekel")).alias("same"),
        size_band(F.lit(1000.0)).alias("band"),
        plain_name(F.lit("fan_out_degree")).alias("name"),
        amount_from_log(F.log1p(F.lit(5000.0))).alias("exact"),
        amount_from_log(F.log1p(F.lit(5000.0)), 2.718).alias("short_e"),
        needs_escalation(F.lit(501), F.lit(10001)).alias("up"),
        needs_escalation(F.lit(500), F.lit(10001)).alias("down"),
    ).first()
    assert (row.top, row.label, row.default) == (9, "90-100%", 7)
    assert row.usd == pytest.approx(0.67) and row.same == 100.0
    assert (row.band, row.name, row.exact) == ("moderate", "Fan Out Degree", 5000.0)
    assert row.short_e < 5000.0
    assert (row.up, row.down) == (1, 0)


def test_bad_timestamps_become_null_and_are_quarantined(spark):
    raw = spark.createDataFrame(
        [("2022/09/01 00:20", "A", "B", 1.0, 0), ("yesterday", "A", "B", 1.0, 0), ("2022/09/01 00:20", None, "B", None, 1)],
        "ts string, from_account string, to_account string, amount_paid double, is_laundering int",
    )
    good, bad = cleaning.split_rejects(raw, cleaning.reject_reasons(raw))
    assert good.count() == 1
    assert sorted(r.reasons for r in bad.collect()) == [["bad ts"], ["missing from_account", "missing amount_paid"]]
    assert cleaning.parse_timestamp(raw).where("ts IS NULL").count() == 1
    assert cleaning.drop_incomplete(raw).count() == 2


def test_request_rules(spark):
    schema = "payment_format string, amount double, from_bank string, to_bank string, currency string, fan_out int, tx_velocity int"
    requests = spark.createDataFrame(
        [("ACH", 1.0, "a", "b", "Euro", 1, 1), ("ACH", 0.0, "a", "b", "Euro", 0, 1), (None, 1.0, "a", "b", "Euro", 1, None)],
        schema,
    )
    broken = [r[0] for r in requests.select(cleaning.request_violations()).collect()]
    assert broken == [
        [],
        ["amount not positive", "fan_out below 1"],
        ["missing payment_format", "missing tx_velocity"],
    ]


def test_select_existing_reports_missing(spark):
    chosen, missing = cleaning.select_existing(spark.range(1), ["id", "gone"])
    assert chosen.columns == ["id"] and missing == ["gone"]


def test_rates_survive_an_absent_class(make_tx):
    tx = make_tx([{"payment_format": "ACH"}, {"payment_format": "Wire"}])
    wide = {r.payment_format: (r.legitimate, r.laundering) for r in profiles.pivot_by_class(tx, "payment_format").collect()}
    assert wide == {"ACH": (1, 0), "Wire": (1, 0)}
    rates = profiles.rate_by(tx, F.col("payment_format"), "f").collect()
    assert all(r.laundering == 0 and r.rate_pct == 0.0 for r in rates)


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "k string, n int")
    assert [r.k for r in profiles.top_by(df, "n", 2, "k").collect()] == ["c", "a"]


def test_lift_guards(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.0)], "is_laundering int, f double")
    assert profiles.feature_lift(rows, ["f"]).first().lift == 5000.0
    tiny = spark.createDataFrame([(1, 0.5), (0, 0.00001)], "is_laundering int, f double")
    assert profiles.feature_lift(tiny, ["f"], only_zero=True).first().lift == 5000.0
