"""The published numbers written out, since the SQL of the queries takes them from the library."""

from txrisk import fixed_values as fv

BASELINES = {
    "flag_rate": 0.0146,
    "avg_risk_score": 0.312,
    "score_p95": 0.891,
    "pct_ach": 0.18,
    "pct_wire": 0.22,
    "pct_bitcoin": 0.035,
    "pct_cash": 0.18,
    "avg_payment_format_risk": 1.82,
    "avg_currency_risk": 2.94,
    "pct_cross_border": 0.48,
    "pct_near_threshold": 0.031,
    "pct_in_cycle": 0.004,
    "avg_fan_out": 2.21,
    "avg_bank_risk": 0.089,
    "avg_processing_ms": 2800,
}
RATES = {
    "US Dollar": 1,
    "UK Pound": 1.27,
    "Euro": 1.08,
    "Yen": 0.0067,
    "Ruble": 0.011,
    "Yuan": 0.138,
    "Rupee": 0.012,
    "Australian Dollar": 0.63,
    "Canadian Dollar": 0.74,
    "Bitcoin": 96000,
}


def test_drift_baselines_and_thresholds():
    assert fv.DRIFT_BASELINES == BASELINES
    expected = {
        "flag_rate": 0.30,
        "avg_risk_score": 0.20,
        "pct_ach": 0.25,
        "avg_payment_format_risk": 0.20,
        "pct_cross_border": 0.25,
        "pct_bitcoin": 0.50,
        "pct_near_threshold": 0.40,
        "avg_fan_out": 0.30,
        "avg_currency_risk": 0.25,
        "pct_in_cycle": 0.60,
        "avg_bank_risk": 0.30,
        "score_p95": 0.15,
    }
    assert {m: fv.DRIFT_THRESHOLDS.get(m, fv.DRIFT_THRESHOLD_DEFAULT) for m in BASELINES} == {
        m: expected.get(m, 0.25) for m in BASELINES
    }


def test_rates_and_limits():
    assert {name: rate for name, (rate, _) in fv.FX_TO_USD.items() if name in RATES} == RATES
    assert (fv.MODEL_THRESHOLD, fv.SCORECARD_THRESHOLD) == (0.8514, 0.65)
    assert (fv.HUB_BANKS, fv.HIGH_FAN_OUT, fv.MIN_ROWS_FOR_DRIFT) == (20, 100, 20)
    assert tuple(fv.STRUCTURING_RANGE) == (8000, 10000)
    assert list(fv.LOOKBACK_DAYS) == [1, 7, 14, 30]
