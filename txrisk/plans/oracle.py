"""The same results in plain SQL over the same tables, written independently.

Literals with an exponent are doubles. Rounding that can meet an exact half goes
through the decimal text of the number.
"""

from __future__ import annotations

from txrisk import fixed_values as fv

AS_OF = "2001-08-01 00:00:00"


def half_up(expression: str, digits: int) -> str:
    return f"round(({expression})::VARCHAR::DECIMAL(38,18), {digits})::DOUBLE"


def mean4(column: str) -> str:
    return half_up(f"round(sum({column}), 6) / count(*)", 4)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_of(column: str, table: dict, default, text: bool = True) -> str:
    def literal(value) -> str:
        if isinstance(value, str):
            return quoted(value)
        return f"{value!r}e0" if isinstance(value, float) else str(value)

    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {literal(default)} END"


_FORMATS = "['ACH','Bitcoin','Cash','Cheque','Credit Card','Wire','Reinvestment','Other']"
_CURRENCIES = (
    "['UK Pound','Ruble','Euro','Yen','US Dollar','Yuan','Rupee','Australian Dollar',"
    "'Canadian Dollar','Shekel','Brazil Real','Mexican Peso','Saudi Riyal','Swiss Franc','Bitcoin','Dinar']"
)
_FX = {name: rate for name, (rate, _) in fv.FX_TO_USD.items()}

BASE = f"""
WITH tx AS (
  SELECT l_shipdate + to_hours(((l_orderkey * 7 + l_linenumber * 5) % 24)::INTEGER) AS ts,
         o_custkey AS from_account, l_suppkey AS to_account,
         c_nationkey AS from_bank, s_nationkey AS to_bank,
         l_extendedprice AS amount_paid, l_extendedprice AS amount_received,
         {_FORMATS}[(l_partkey % 8)::INTEGER + 1] AS payment_format,
         {_CURRENCIES}[(o_custkey % 16)::INTEGER + 1] AS payment_currency,
         {_CURRENCIES}[((o_custkey + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END) % 16)::INTEGER + 1]
           AS receiving_currency,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 9e-2 THEN 1 ELSE 0 END AS is_laundering,
         (l_partkey % 50)::INTEGER AS processing_ms
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey
),
rowf AS (
  SELECT *,
    CASE WHEN from_bank <> to_bank THEN 1 ELSE 0 END AS is_cross_border,
    hour(ts)::INTEGER AS hour_of_day,
    CASE WHEN hour(ts) IN (11, 12, 13) THEN 1 ELSE 0 END AS is_peak_hour,
    (dayofweek(ts) + 1)::INTEGER AS day_of_week,
    CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN payment_format = 'ACH' THEN 3 WHEN payment_format = 'Bitcoin' THEN 2
         WHEN payment_format IN ('Wire', 'Reinvestment') THEN 0 ELSE 1 END AS payment_format_risk,
    CASE WHEN payment_currency IN ('UK Pound', 'Ruble') THEN 5
         WHEN payment_currency IN ('Euro', 'Yen') THEN 4
         WHEN payment_currency IN ('US Dollar', 'Yuan', 'Rupee') THEN 3
         WHEN payment_currency IN ('Shekel', 'Brazil Real', 'Mexican Peso', 'Saudi Riyal',
                                   'Swiss Franc', 'Bitcoin') THEN 1
         ELSE 2 END AS currency_risk_score,
    round(ln(1e0 + amount_paid), 4) AS amount_log,
    CASE WHEN amount_paid >= 8000 AND amount_paid < 10000 THEN 1 ELSE 0 END AS is_near_threshold
  FROM tx
),
sender AS (
  SELECT from_account, count(DISTINCT to_account) AS fan_out_degree, count(*) AS tx_velocity,
         round(sum(amount_paid), 2) AS total_sent,
         {half_up('round(sum(amount_paid), 6) / count(*)', 2)} AS avg_sent,
         {half_up('round(sum(amount_paid), 2) / greatest(count(*), 1)', 2)} AS amount_per_tx
  FROM tx GROUP BY from_account
),
receiver AS (
  SELECT to_account, count(DISTINCT from_account) AS fan_in_degree,
         round(sum(amount_paid), 2) AS total_received,
         {half_up('round(sum(amount_paid), 6) / count(*)', 2)} AS avg_received
  FROM tx GROUP BY to_account
),
bank0 AS (
  SELECT from_bank, round(avg(amount_paid), 2) AS bank_avg_amount,
         round(stddev_samp(amount_paid), 2) AS bank_std_amount,
         count(*) AS bank_total_tx, sum(is_laundering)::BIGINT AS bank_laund_tx
  FROM tx GROUP BY from_bank
),
bank AS (
  SELECT *, round(bank_laund_tx::DOUBLE / bank_total_tx * 100e0, 6) AS bank_risk_score,
         CASE WHEN bank_laund_tx > 0
               AND row_number() OVER (ORDER BY bank_laund_tx DESC, from_bank) <= 20
              THEN 1 ELSE 0 END AS is_hub_bank
  FROM bank0
),
edge AS (
  SELECT from_account, to_account, count(*) AS n_tx, sum(is_laundering)::BIGINT AS n_laundering
  FROM tx GROUP BY from_account, to_account
),
cycle AS (
  SELECT a.from_account, a.to_account, a.n_tx
  FROM edge a JOIN edge b ON a.from_account = b.to_account AND a.to_account = b.from_account
),
feat AS (
  SELECT r.is_cross_border, r.hour_of_day, r.is_peak_hour, r.day_of_week, r.is_weekend,
         r.payment_format_risk, r.currency_risk_score, r.amount_log, r.is_near_threshold,
         s.fan_out_degree, v.fan_in_degree, s.tx_velocity, s.amount_per_tx,
         round((r.amount_paid - b.bank_avg_amount)
               / CASE WHEN b.bank_std_amount > 0 THEN b.bank_std_amount ELSE 1e0 END, 4) + 0e0
           AS amount_zscore_per_bank,
         b.bank_risk_score,
         CASE WHEN s.fan_out_degree > 100 THEN 1 ELSE 0 END AS is_high_fan_out,
         CASE WHEN c.from_account IS NULL THEN 0 ELSE 1 END AS is_in_cycle,
         b.is_hub_bank,
         r.from_account, r.to_account, r.from_bank, r.to_bank, r.amount_paid, r.ts, r.is_laundering,
         r.payment_format, r.payment_currency, r.processing_ms
  FROM rowf r
  LEFT JOIN sender s USING (from_account)
  LEFT JOIN receiver v USING (to_account)
  LEFT JOIN bank b USING (from_bank)
  LEFT JOIN cycle c ON c.from_account = r.from_account AND c.to_account = r.to_account
),
usd AS (
  SELECT *, amount_paid * {case_of('payment_currency', _FX, 1.0)} AS amount_usd FROM feat
),
score AS (
  SELECT *, round(least(greatest(
      0e0 + payment_format_risk * 16e-2
      + least(fan_out_degree / 60e0, 22e-2)
      + least(tx_velocity / 2000e0, 10e-2)
      + CASE WHEN amount_usd > 100000 THEN 10e-2 WHEN amount_usd > 10000 THEN 6e-2
             WHEN amount_usd > 1000 THEN 3e-2 ELSE 1e-2 END
      + CASE WHEN payment_format = 'Bitcoin' AND fan_out_degree > 50 THEN 8e-2 ELSE 0e0 END
      + is_cross_border * 3e-2 + currency_risk_score * 2e-2 + is_near_threshold * 1e-2
    , 0e0), 1e0), 4) AS risk_score
  FROM usd
),
scored AS (
  SELECT *, CASE WHEN risk_score >= 65e-2 THEN 'FLAGGED' ELSE 'CLEARED' END AS verdict,
         CASE WHEN risk_score >= 65e-2 AND is_laundering = 1 THEN 'TP'
              WHEN risk_score >= 65e-2 THEN 'FP'
              WHEN is_laundering = 1 THEN 'FN' ELSE 'TN' END AS case_type
  FROM score
),
thr AS (
  SELECT risk_score AS threshold, sum(is_laundering)::BIGINT AS pos,
         (count(*) - sum(is_laundering))::BIGINT AS neg
  FROM scored GROUP BY risk_score
),
cum AS (
  SELECT threshold, pos, neg,
         (sum(pos) OVER (ORDER BY threshold DESC))::BIGINT AS tp,
         (sum(neg) OVER (ORDER BY threshold DESC))::BIGINT AS fp,
         (SELECT sum(pos) FROM thr)::BIGINT AS all_pos, (SELECT sum(neg) FROM thr)::BIGINT AS all_neg
  FROM thr
),
curve0 AS (
  SELECT threshold, tp, fp, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / all_pos AS recall FROM cum
),
curve AS (
  SELECT *, 2e0 * precision * recall / (precision + recall + 1e-8) AS f1 FROM curve0
),
log AS (
  SELECT ts, payment_format, payment_currency AS currency, amount_usd,
         from_bank::VARCHAR AS from_bank, to_bank::VARCHAR AS to_bank,
         payment_format_risk::DOUBLE AS payment_format_risk,
         currency_risk_score::DOUBLE AS currency_risk_score,
         is_cross_border, is_near_threshold, amount_log, bank_risk_score / 100e0 AS bank_risk_score,
         is_in_cycle, fan_out_degree::DOUBLE AS fan_out_degree, tx_velocity::DOUBLE AS tx_velocity_feat,
         risk_score, verdict, processing_ms
  FROM scored
),
spans AS (SELECT unnest([1, 7, 14, 30])::INTEGER AS period_days),
recent AS (
  SELECT s.period_days, l.*
  FROM spans s JOIN log l
    ON l.ts < TIMESTAMP '{AS_OF}' AND l.ts >= TIMESTAMP '{AS_OF}' - to_days(s.period_days)
),
ranked AS (
  SELECT period_days, risk_score,
         row_number() OVER (PARTITION BY period_days ORDER BY risk_score) - 1 AS pos,
         count(*) OVER (PARTITION BY period_days) AS n
  FROM recent
),
pct AS (
  SELECT period_days,
         min(CASE WHEN pos = floor(n * 95e-2) THEN risk_score END) AS score_p95,
         min(CASE WHEN pos = floor(n * 99e-2) THEN risk_score END) AS score_p99
  FROM ranked GROUP BY period_days
),
metrics AS (
  SELECT period_days, count(*) AS n_transactions,
    count(*) FILTER (verdict = 'FLAGGED')::DOUBLE / count(*) AS flag_rate,
    {mean4('risk_score')} AS avg_risk_score,
    any_value(score_p95) AS score_p95,
    count(*) FILTER (payment_format = 'ACH')::DOUBLE / count(*) AS pct_ach,
    count(*) FILTER (payment_format = 'Wire')::DOUBLE / count(*) AS pct_wire,
    count(*) FILTER (payment_format = 'Bitcoin')::DOUBLE / count(*) AS pct_bitcoin,
    count(*) FILTER (payment_format = 'Cash')::DOUBLE / count(*) AS pct_cash,
    {mean4('payment_format_risk')} AS avg_payment_format_risk,
    {mean4('currency_risk_score')} AS avg_currency_risk,
    {mean4('is_cross_border')} AS pct_cross_border,
    {mean4('is_near_threshold')} AS pct_near_threshold,
    {mean4('is_in_cycle')} AS pct_in_cycle,
    {mean4('fan_out_degree')} AS avg_fan_out,
    {mean4('bank_risk_score')} AS avg_bank_risk,
    round(avg(CASE WHEN processing_ms > 0 THEN processing_ms END), 1) AS avg_processing_ms
  FROM recent JOIN pct USING (period_days) GROUP BY period_days
)
"""

_METRIC_ROWS = ", ".join(
    f"({i}, {quoted(m)}, {b!r}::DOUBLE, {fv.DRIFT_THRESHOLDS.get(m, fv.DRIFT_THRESHOLD_DEFAULT)!r}::DOUBLE)"
    for i, (m, b) in enumerate(fv.DRIFT_BASELINES.items())
)
_UP = {m: a[0] for m, a in fv.DRIFT_ACTIONS.items()}
_DOWN = {m: a[1] for m, a in fv.DRIFT_ACTIONS.items()}


def drift_ctes(source: str, keys: str) -> str:
    """Comparison, alerts and status of the metrics in ``source``, per ``keys``."""
    return f"""base(position, metric, baseline, threshold) AS (VALUES {_METRIC_ROWS}),
long AS (
  UNPIVOT {source} ON COLUMNS(* EXCLUDE ({keys}, n_transactions)) INTO NAME metric VALUE current
),
compared AS (
  SELECT {keys}, l.n_transactions, b.position::INTEGER AS position, l.metric, b.baseline, b.threshold,
         l.current, (l.current - b.baseline) / abs(b.baseline) AS change
  FROM long l JOIN base b USING (metric) WHERE l.current IS NOT NULL
),
alerts AS (
  SELECT {keys}, metric, position, baseline, current,
         round(abs(change) * 100e0, 1) AS change_pct,
         CASE WHEN current > baseline THEN '{fv.DIRECTION_UP}' ELSE '{fv.DIRECTION_DOWN}' END AS direction,
         CASE WHEN abs(change) / threshold >= 2 THEN 'CRITICAL'
              WHEN abs(change) / threshold >= 15e-1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         {case_of('metric', fv.DRIFT_EXPLANATIONS, fv.DRIFT_EXPLANATION_DEFAULT)} AS explanation,
         CASE WHEN current > baseline THEN {case_of('metric', _UP, fv.DRIFT_ACTION_DEFAULT)}
              ELSE {case_of('metric', _DOWN, fv.DRIFT_ACTION_DEFAULT)} END AS action
  FROM compared WHERE n_transactions >= 20 AND abs(change) > threshold
),
counted AS (
  SELECT {keys}, count(*) AS n_alerts,
         count(*) FILTER (severity = 'CRITICAL') AS n_critical,
         count(*) FILTER (severity = 'HIGH') AS n_high,
         string_agg(metric, ', ' ORDER BY position) FILTER (severity = 'HIGH') AS high_metrics
  FROM alerts GROUP BY {keys}
),
status AS (
  SELECT {keys}, n_transactions, coalesce(n_alerts, 0)::BIGINT AS n_alerts, high_metrics,
         CASE WHEN n_transactions < 20 THEN 'INSUFFICIENT_DATA'
              WHEN n_critical > 0 THEN 'CRITICAL_DRIFT'
              WHEN n_high > 0 THEN 'DRIFT_DETECTED'
              WHEN n_alerts > 0 THEN 'MINOR_DRIFT' ELSE 'STABLE' END AS status
  FROM {source} LEFT JOIN counted USING ({keys})
)
"""


DRIFT = f"{BASE}, {drift_ctes('metrics', 'period_days')}"


def rate_sql(dimension: str, name: str) -> str:
    return f"""{BASE}
SELECT {dimension} AS {name},
       count(*) FILTER (is_laundering = 0) AS legitimate,
       count(*) FILTER (is_laundering = 1) AS laundering,
       round(count(*) FILTER (is_laundering = 1)::DOUBLE / count(*)::DOUBLE * 100e0, 3) AS rate_pct
FROM rowf GROUP BY 1"""
