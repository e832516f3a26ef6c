"""Named queries: scorecard, evaluation, case comparison."""

from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.linear import feature_means, with_linear_contributions
from txrisk.functions.scorecard import contribution_total, scorecard_terms
from txrisk.operators import cases, evaluation, quantiles
from txrisk.operators.cleaning import select_existing
from txrisk.plans.catalog import query
from txrisk.plans.oracle import BASE, mean4
from txrisk.plans.scoring import escalations as escalation_flags
from txrisk.plans.scoring import score_payments
from txrisk.sources.warehouse import stored_payments

CUT = fv.SCORECARD_THRESHOLD
_KEYS = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "is_laundering"]
_KEY_SQL = ", ".join(_KEYS)


def _scored(spark, folder, parts=("sender",)):
    return score_payments(stored_payments(spark, folder), parts)


@query(
    "scorecard",
    f"{BASE} SELECT {_KEY_SQL}, amount_usd, risk_score, verdict, 65e-2 AS threshold FROM scored",
)
def scorecard(spark, folder):
    return _scored(spark, folder).select(*_KEYS, "amount_usd", "risk_score", "verdict", "threshold")


@query(
    "scorecard_terms",
    f"""{BASE} SELECT {_KEY_SQL}, round(payment_format_risk * 16e-2, 6) AS payment_format_term,
    round(least(fan_out_degree / 60e0, 22e-2), 6) AS fan_out_term,
    round(least(tx_velocity / 2000e0, 10e-2), 6) AS velocity_term,
    abs(risk_score - round(0e0 + payment_format_risk * 16e-2 + least(fan_out_degree / 60e0, 22e-2)
      + least(tx_velocity / 2000e0, 10e-2)
      + CASE WHEN amount_usd > 100000 THEN 10e-2 WHEN amount_usd > 10000 THEN 6e-2
             WHEN amount_usd > 1000 THEN 3e-2 ELSE 1e-2 END
      + CASE WHEN payment_format = 'Bitcoin' AND fan_out_degree > 50 THEN 8e-2 ELSE 0e0 END
      + is_cross_border * 3e-2 + currency_risk_score * 2e-2 + is_near_threshold * 1e-2, 4)) AS rest FROM scored""",
)
def scorecard_additive_terms(spark, folder):
    """Terms of the score, and what the terms leave unexplained."""
    scored = _scored(spark, folder)
    terms = scorecard_terms()
    return scored.select(
        *_KEYS,
        *[F.round(terms[n], 6).alias(f"{n}_term") for n in ("payment_format", "fan_out", "velocity")],
        F.abs(F.col("risk_score") - F.round(contribution_total(terms), 4)).alias("rest"),
    )


@query(
    "escalations",
    f"""{BASE} SELECT {_KEY_SQL}, risk_score, verdict,
    CASE WHEN fan_out_degree > 50 AND tx_velocity > 50 THEN 1 ELSE 0 END AS manual_review FROM scored""",
)
def escalations(spark, folder):
    """Manual-review rule with limits that occur at small scale."""
    flagged = escalation_flags(_scored(spark, folder), min_fan_out=50, min_velocity=50)
    return flagged.select(*_KEYS, "risk_score", "verdict", "manual_review")


def _rounded_curve(curve):
    return curve.select(
        "threshold", "tp", "fp", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")]
    )


_CURVE_SQL = """SELECT threshold, tp, fp, round(precision, 8) AS precision, round(recall, 8) AS recall,
    round(f1, 8) AS f1 FROM curve"""


@query("pr_curve", f"{BASE} {_CURVE_SQL}")
def pr_curve(spark, folder):
    return _rounded_curve(evaluation.precision_recall_curve(_scored(spark, folder)))


@query("best_f1", f"{BASE} {_CURVE_SQL} ORDER BY curve.f1 DESC, threshold LIMIT 1")
def best_f1(spark, folder):
    return _rounded_curve(evaluation.best_f1(evaluation.precision_recall_curve(_scored(spark, folder))))


_AP_SQL = "round(sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(all_pos), 8)"
_AUC_SQL = "round(sum(neg * (tp - pos + pos / 2e0)) / (any_value(all_pos)::DOUBLE * any_value(all_neg)), 8)"


@query("average_precision", f"{BASE} SELECT any_value(all_pos) AS positives, {_AP_SQL} AS average_precision FROM cum")
def average_precision(spark, folder):
    return evaluation.ranking_quality(_scored(spark, folder)).select("positives", "average_precision")


@query(
    "roc_auc",
    f"""{BASE} SELECT any_value(all_pos) AS positives, any_value(all_neg) AS negatives, {_AUC_SQL} AS roc_auc FROM cum""",
)
def roc_auc(spark, folder):
    return evaluation.ranking_quality(_scored(spark, folder)).select("positives", "negatives", "roc_auc")


@query(
    "confusion",
    f"""{BASE} SELECT 65e-2 AS threshold, tp, fp, fn, tn,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0e0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0e0) AS recall,
    coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1
    FROM (SELECT count(*) FILTER (case_type = 'TP') AS tp, count(*) FILTER (case_type = 'FP') AS fp,
      count(*) FILTER (case_type = 'FN') AS fn, count(*) FILTER (case_type = 'TN') AS tn FROM scored)""",
)
def confusion(spark, folder):
    return evaluation.confusion(_scored(spark, folder), CUT)


def _search_sql(recall: str, precision: str) -> str:
    good = f"recall >= {recall} AND precision >= {precision}"
    return f"""{BASE}, good AS (SELECT *, 1 AS meets_both FROM curve WHERE {good}),
    best AS (SELECT *, 0 AS meets_both FROM curve ORDER BY f1 DESC, threshold LIMIT 1)
    SELECT threshold, tp, fp, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, meets_both
    FROM (SELECT * FROM good UNION ALL SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM good))"""


def _search(spark, folder, recall, precision):
    curve = evaluation.precision_recall_curve(_scored(spark, folder))
    met = evaluation.thresholds_meeting(curve, recall, precision)
    rounded = [F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")]
    return met.select("threshold", "tp", "fp", *rounded, "meets_both")


@query("threshold_search", _search_sql("6e-1", "3e-1"))
def threshold_search(spark, folder):
    return _search(spark, folder, 0.60, 0.30)


@query("threshold_search_met", _search_sql("6e-1", "4e-2"))
def threshold_search_met(spark, folder):
    return _search(spark, folder, 0.60, 0.04)


_CALIBRATION = """SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(is_laundering * 100e0), 3) AS actual_pct,
    bin * 10e0 + 5e0 AS expected_pct,
    CASE WHEN abs(avg(is_laundering * 100e0) - (bin * 10e0 + 5e0)) > 20 THEN 1 ELSE 0 END AS off"""


@query("calibration", f"{BASE} {_CALIBRATION} FROM (SELECT *, least(floor(risk_score * 10e0), 9) AS bin FROM scored) GROUP BY bin")
def calibration(spark, folder):
    return evaluation.calibration(_scored(spark, folder))


@query(
    "calibration_binary_edges",
    f"""{BASE}, edges AS (SELECT i, i * 1e-1 AS lo FROM range(1, 10) t(i)),
    binned AS (SELECT s.*, (SELECT count(*) FROM edges WHERE s.risk_score >= lo) AS bin FROM scored s
      WHERE risk_score >= 0 AND risk_score < 1)
    {_CALIBRATION} FROM binned GROUP BY bin""",
)
def calibration_binary_edges(spark, folder):
    return evaluation.calibration(_scored(spark, folder), binary_edges=True)


@query(
    "score_density",
    f"""{BASE}, b AS (SELECT is_laundering, least(floor(risk_score * 50e0), 49)::INTEGER AS bin, count(*) AS n
      FROM scored GROUP BY 1, 2)
    SELECT is_laundering, bin, n, round(n / sum(n) OVER (PARTITION BY is_laundering) * 50e0, 6) AS density FROM b""",
)
def score_density(spark, folder):
    return evaluation.score_density(_scored(spark, folder))


@query(
    "score_summary",
    f"""{BASE} SELECT is_laundering, count(*) AS n, {mean4('risk_score')} AS mean_score,
    round(quantile_cont(risk_score, 0.5), 4) AS median_score,
    count(*) FILTER (risk_score > 5e-1) AS n_above_50, count(*) FILTER (risk_score > 85e-2) AS n_above_85,
    CASE is_laundering WHEN 1 THEN 'Laundering' ELSE 'Legitimate' END AS label FROM scored GROUP BY is_laundering""",
)
def score_summary(spark, folder):
    return evaluation.score_summary(_scored(spark, folder))


_CASE_MEANS = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, round(avg(CASE WHEN case_type = 'TP' THEN {n} END), 4) AS tp_mean,
    round(avg(CASE WHEN case_type = 'FP' THEN {n} END), 4) AS fp_mean,
    round(avg(CASE WHEN case_type = 'FN' THEN {n} END), 4) AS fn_mean FROM scored"""
    for n in fv.CASE_MEAN_FEATURES
)


@query("case_means", f"{BASE} {_CASE_MEANS}")
def case_means(spark, folder):
    return cases.case_means(_scored(spark, folder, ("sender", "bank", "cycle")))


_ORDER = "ts, from_account, to_account, amount_paid, payment_format, is_laundering"


@query(
    "top_scores",
    f"""{BASE} SELECT risk_score, is_laundering, {', '.join(fv.TOP_SCORE_FIELDS)} FROM scored
    ORDER BY risk_score DESC, {_ORDER} LIMIT 10""",
)
def top_scores(spark, folder):
    return cases.top_scores(_scored(spark, folder, ("sender", "bank", "cycle")))


@query(
    "case_sample",
    f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY {_ORDER}) AS case_rank
      FROM scored WHERE case_type <> 'TN')
    SELECT {_KEY_SQL}, risk_score, case_type, case_rank::INTEGER AS case_rank FROM r WHERE case_rank <= 10""",
)
def case_sample(spark, folder):
    sample = cases.case_sample(_scored(spark, folder))
    chosen, _ = select_existing(sample, [*_KEYS, "risk_score", "case_type", "case_rank", "not_there"])
    return chosen


_LEAK = f"""
lt AS (SELECT round(bank_risk_score, 6) AS v, sum(is_laundering)::BIGINT AS pos, sum(1 - is_laundering)::BIGINT AS neg
  FROM feat GROUP BY 1),
lc AS (SELECT *, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(neg) OVER (ORDER BY v DESC) AS fp,
  (SELECT sum(pos) FROM lt) AS p, (SELECT sum(neg) FROM lt) AS n FROM lt)
"""


@query(
    "leakage_single_feature",
    f"""{BASE}, {_LEAK}, q AS (SELECT
      round((sum(neg * (tp - pos + pos / 2e0)) / (any_value(p)::DOUBLE * any_value(n)))::DOUBLE, 8) AS roc_auc,
      round((sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(p))::DOUBLE, 8) AS average_precision FROM lc)
    SELECT 'bank_risk_score' AS feature, roc_auc, average_precision,
      CASE WHEN roc_auc > 8e-1 THEN 'very high' WHEN roc_auc > 65e-2 THEN 'moderate' ELSE 'low' END AS suspicion FROM q""",
)
def leakage_single_feature(spark, folder):
    scored = _scored(spark, folder, ("sender", "bank"))
    return evaluation.single_feature_leakage(scored, "bank_risk_score")


# --- unrounded values and linear attribution ---------------------------------
_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@query(
    "raw_quantiles",
    f"""{BASE}, v AS (SELECT amount_usd / (1 + fan_out_degree) AS v FROM scored),
    r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place, count(*) OVER () AS n FROM v)
    SELECT {', '.join(f"min(v) FILTER (place = least(floor(n * {share!r}::DOUBLE), n - 1)) AS {name}" for name, share in _SHARES.items())},
      count(*) AS n FROM r""",
)
def raw_quantiles(spark, folder):
    """Exact quantiles of unrounded values, nearly all of them different."""
    value = F.col("amount_usd") / (1 + F.col("fan_out_degree"))
    return quantiles.exact_quantiles(_scored(spark, folder).select(value.alias("v")), "v", _SHARES)


_LINEAR = {"payment_format_risk": 0.16, "is_cross_border": 0.03, "currency_risk_score": 0.02, "is_near_threshold": 0.01}


@query(
    "linear_attribution",
    f"""{BASE}, m AS (SELECT {', '.join(f"avg({f}::DOUBLE) AS {f}" for f in _LINEAR)} FROM rowf),
    c AS (SELECT is_laundering, {', '.join(f"{w!r}::DOUBLE * (r.{f} - m.{f}) AS {f}" for f, w in _LINEAR.items())},
      {' + '.join(f"{w!r}::DOUBLE * r.{f}" for f, w in _LINEAR.items())} AS score,
      {' + '.join(f"{w!r}::DOUBLE * m.{f}" for f, w in _LINEAR.items())} AS expected FROM rowf r, m)
    SELECT is_laundering, {', '.join(f"round(avg({f}), 6) + 0e0 AS {f}" for f in _LINEAR)},
      round(max(abs(score - expected - ({' + '.join(_LINEAR)}))), 6) AS worst_gap FROM c GROUP BY 1""",
)
def linear_attribution(spark, folder):
    """Mean contribution per class of the linear part of the score; contributions add up to the score."""
    rows = _scored(spark, folder)
    means = feature_means(rows, list(_LINEAR)).first().asDict()
    known = with_linear_contributions(rows, _LINEAR, means)
    score = sum((F.lit(w) * F.col(f) for f, w in _LINEAR.items()), F.lit(0.0))
    total = sum((F.col(f"contributions.{f}") for f in _LINEAR), F.col("expected"))
    averages = [(F.round(F.avg(f"contributions.{f}"), 6) + F.lit(0.0)).alias(f) for f in _LINEAR]
    return known.groupBy("is_laundering").agg(*averages, F.round(F.max(F.abs(score - total)), 6).alias("worst_gap"))
