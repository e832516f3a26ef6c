"""Fixed values.

Everything in this module is a constant that results depend on: risk tables,
rates, limits, baselines and report wording. They are data, not logic, and are
kept together in natural order so that they can be reviewed at a glance.
"""

# --- names of payment formats and currencies -------------------------------
WAREHOUSE_FORMATS = ["ACH", "Bitcoin", "Cash", "Cheque", "Credit Card", "Wire", "Reinvestment", "Other"]
WAREHOUSE_CURRENCIES = [
    "UK Pound",
    "Ruble",
    "Euro",
    "Yen",
    "US Dollar",
    "Yuan",
    "Rupee",
    "Australian Dollar",
    "Canadian Dollar",
    "Shekel",
    "Brazil Real",
    "Mexican Peso",
    "Saudi Riyal",
    "Swiss Franc",
    "Bitcoin",
    "Dinar",
]

# --- risk tables -----------------------------------------------------------
PAYMENT_FORMAT_RISK = {
    "ACH": 3,
    "Bitcoin": 2,
    "Cash": 1,
    "Cheque": 1,
    "Credit Card": 1,
    "Wire": 0,
    "Reinvestment": 0,
}
PAYMENT_FORMAT_RISK_DEFAULT = 1

CURRENCY_RISK = {
    "UK Pound": 5,
    "Ruble": 5,
    "Euro": 4,
    "Yen": 4,
    "US Dollar": 3,
    "Yuan": 3,
    "Rupee": 3,
    "Australian Dollar": 2,
    "Canadian Dollar": 2,
    "Shekel": 1,
    "Brazil Real": 1,
    "Mexican Peso": 1,
    "Saudi Riyal": 1,
    "Swiss Franc": 1,
    "Bitcoin": 1,
}
CURRENCY_RISK_DEFAULT = 2

# US dollars per unit; the text form is what reports print.
FX_TO_USD = {
    "US Dollar": (1.0, "1"),
    "UK Pound": (1.27, "1.27"),
    "Euro": (1.08, "1.08"),
    "Yen": (0.0067, "0.0067"),
    "Ruble": (0.011, "0.011"),
    "Yuan": (0.138, "0.138"),
    "Rupee": (0.012, "0.012"),
    "Australian Dollar": (0.63, "0.63"),
    "Canadian Dollar": (0.74, "0.74"),
    "Bitcoin": (96000.0, "96000"),
}
FX_DEFAULT = (1.0, "1")

CURRENCY_SYMBOL = {
    "US Dollar": "$",
    "UK Pound": "£",
    "Euro": "€",
    "Yen": "¥",
    "Ruble": "₽",
    "Yuan": "¥",
    "Rupee": "₹",
    "Australian Dollar": "A$",
    "Canadian Dollar": "C$",
    "Bitcoin": "₿",
}
CURRENCY_SYMBOL_DEFAULT = "$"

# --- limits ----------------------------------------------------------------
STRUCTURING_RANGE = (8000.0, 10000.0)
PEAK_HOURS = (11, 13)
HIGH_FAN_OUT = 100
HUB_BANKS = 20
MODEL_THRESHOLD = 0.8514
SCORECARD_THRESHOLD = 0.65
ESCALATE_FAN_OUT = 500
ESCALATE_VELOCITY = 10000
MIN_ROWS_FOR_DRIFT = 20
DRIVER_MIN_ABS = 0.05

# --- column lists ----------------------------------------------------------
FEATURES = [
    "is_cross_border",
    "hour_of_day",
    "is_peak_hour",
    "day_of_week",
    "is_weekend",
    "payment_format_risk",
    "currency_risk_score",
    "amount_log",
    "is_near_threshold",
    "fan_out_degree",
    "fan_in_degree",
    "tx_velocity",
    "amount_per_tx",
    "amount_zscore_per_bank",
    "bank_risk_score",
    "is_high_fan_out",
    "is_in_cycle",
    "is_hub_bank",
]
HISTORY_FILL = {
    "fan_in_degree": 0,
    "fan_out_degree": 0,
    "tx_velocity": 1,
    "amount_per_tx": 0.0,
    "amount_zscore_per_bank": 0.0,
    "bank_risk_score": 0.0,
    "is_high_fan_out": 0,
    "is_in_cycle": 0,
    "is_hub_bank": 0,
}
LIFT_FEATURES = [
    "is_in_cycle",
    "is_cross_border",
    "is_near_threshold",
    "is_weekend",
    "is_hub_bank",
    "is_high_fan_out",
    "payment_format_risk",
    "currency_risk_score",
]
CASE_MEAN_FEATURES = [
    "payment_format_risk",
    "fan_out_degree",
    "bank_risk_score",
    "is_in_cycle",
    "is_cross_border",
    "amount_log",
    "tx_velocity",
    "amount_per_tx",
    "is_near_threshold",
]
TOP_SCORE_FIELDS = [
    "payment_format_risk",
    "fan_out_degree",
    "bank_risk_score",
    "is_in_cycle",
    "is_cross_border",
    "amount_log",
    "tx_velocity",
]

# Values used when a payment is scored with no history at hand.
REQUEST_DEFAULTS = {
    "amount_zscore_per_bank": 0.0,
    "bank_risk_score": 0.15,
    "hour_of_day": 12,
    "day_of_week": 2,
    "is_weekend": 0,
    "is_hub_bank": 0,
    "is_in_cycle": 0,
    "fan_in_degree": 1,
}

# --- names -----------------------------------------------------------------
CLASS_NAMES = {0: "Legitimate", 1: "Laundering"}
DAY_NAMES = {
    1: "Sunday",
    2: "Monday",
    3: "Tuesday",
    4: "Wednesday",
    5: "Thursday",
    6: "Friday",
    7: "Saturday",
}
CASE_NAMES = {
    "TP": "TRUE POSITIVE  (Correctly Flagged Fraud)",
    "FP": "FALSE POSITIVE (Wrongly Flagged Legitimate)",
    "FN": "FALSE NEGATIVE (Missed Fraud)",
}
PAYMENT_NAME = {
    3: "ACH",
    2: "Bitcoin",
    1: "Cash / Cheque / Credit Card",
    0: "Wire / Reinvestment",
}

# --- monitoring ------------------------------------------------------------
DRIFT_BASELINES = {
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
    "avg_processing_ms": 2800.0,
}
DRIFT_THRESHOLDS = {
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
DRIFT_THRESHOLD_DEFAULT = 0.25
SEVERITY_RATIOS = {"CRITICAL": 2.0, "HIGH": 1.5}
LOOKBACK_DAYS = [1, 7, 14, 30]

FORMAT_MIX_BASELINE = {
    "ACH": 18.0,
    "Wire": 22.0,
    "Bitcoin": 3.5,
    "Cash": 18.0,
    "Credit Card": 20.0,
    "Reinvestment": 10.0,
    "Cheque": 8.5,
}
FORMAT_MIX_DEFAULT = 10.0

DRIFT_EXPLANATIONS = {
    "flag_rate": "Alert rate has shifted significantly. If rising: launderers may be using riskier patterns or threshold needs adjustment. If falling: model may be missing new laundering techniques.",
    "avg_risk_score": "Average risk score distribution has shifted. Could indicate data distribution change or model miscalibration.",
    "pct_ach": "ACH transaction share has changed. Critical — ACH is your most important feature (40% importance). If ACH drops heavily, model loses its strongest signal.",
    "avg_payment_format_risk": "Overall payment format risk mix has shifted. Launderers may be switching to lower-risk payment methods.",
    "pct_cross_border": "Cross-border transaction share changed. May indicate new transaction routing patterns.",
    "pct_near_threshold": "Structuring pattern frequency changed. If dropping: launderers may have changed amount strategies. If rising: potential coordinated structuring campaign.",
    "pct_in_cycle": "Circular transaction frequency changed. This is your 154x lift signal — any drift here is high priority. If dropping: launderers may have stopped cycling, model loses key signal.",
    "avg_fan_out": "Account fan-out distribution shifted. If rising: potential increase in smurfing activity. If falling: launderers may be using fewer recipient accounts.",
    "pct_bitcoin": "Bitcoin transaction share changed. Crypto adoption or mixer activity may be increasing.",
}
DRIFT_EXPLANATION_DEFAULT = "Feature distribution has shifted from training baseline."

# metric -> (action when above the baseline, action when below)
DRIFT_ACTIONS = {
    "flag_rate": (
        "Review recent flagged transactions manually. Consider threshold recalibration.",
        "Investigate whether new laundering patterns are evading detection. Consider retraining.",
    ),
    "pct_ach": (
        "ACH volume increased — monitor closely as this is your top feature.",
        "ACH volume dropping — model's strongest signal weakening. Consider retraining if sustained.",
    ),
    "pct_in_cycle": (
        "Circular transactions increasing — potential coordinated laundering campaign. Escalate.",
        "Circular patterns dropping. Launderers may have adapted. Retrain if sustained >14 days.",
    ),
    "avg_risk_score": (
        "Score inflation detected. Check if threshold needs adjustment upward.",
        "Score deflation detected. Model may be missing new fraud patterns.",
    ),
    "pct_near_threshold": (
        "Structuring activity increasing. Consider lowering detection threshold temporarily.",
        "Structuring patterns decreasing. Launderers may have shifted amount ranges.",
    ),
}
DRIFT_ACTION_DEFAULT = "Monitor for 7 more days. If drift persists, schedule model retraining."

# {metrics} is replaced by the HIGH metrics, comma separated.
DRIFT_RECOMMENDATIONS = {
    "STABLE": "Model is performing within expected parameters. Continue standard monitoring.",
    "MINOR_DRIFT": "Minor distributional shifts detected. No immediate action required. Review in 7 days.",
    "DRIFT_DETECTED": "Significant drift detected in: {metrics}. Schedule model retraining within 30 days. Increase manual review rate for flagged transactions in the interim.",
    "CRITICAL_DRIFT": "CRITICAL: Model may no longer be reliable. Immediately increase manual review to 100% of flagged transactions. Initiate emergency retraining procedure. Notify compliance team.",
}
DIRECTION_UP = "↑ HIGHER"
DIRECTION_DOWN = "↓ LOWER"

# --- explanation wording ---------------------------------------------------
PAYMENT_DESCRIPTION = {
    3: "high-risk — difficult to reverse, commonly used in layering schemes",
    2: "moderate-risk — pseudonymous digital currency with limited traceability",
    1: "low-risk — standard consumer payment methods",
    0: "low-risk — highly traceable institutional payment method",
}
PAYMENT_DESCRIPTION_DEFAULT = "unknown risk level"
CURRENCY_DESCRIPTION = {
    5: "very high risk — jurisdiction has weak AML oversight",
    4: "high risk — limited regulatory transparency",
    3: "moderate risk — standard international currency",
    2: "low risk — strong regulatory oversight",
    1: "very low risk — highly regulated jurisdiction",
}
CURRENCY_DESCRIPTION_DEFAULT = "moderate risk"
BANK_DESCRIPTION = [
    (0.1, "clean record"),
    (0.2, "minor historical concerns"),
    (0.3, "moderate laundering history"),
    (None, "significant laundering history — high risk institution"),
]

# {strength} {direction} {payment} {fan} are filled per row.
DRIVER_SENTENCES = {
    "payment_format_risk": "The payment method ({payment}) {strength} {direction} the risk assessment",
    "is_in_cycle": "A circular transaction pattern — money sent and returned between the same accounts — {strength} {direction} the risk",
    "bank_risk_score": "The originating bank's history of involvement in suspicious activity {strength} {direction} the risk",
    "is_cross_border": "The fact that funds cross between different banks {strength} {direction} the risk",
    "fan_out_degree": "The number of different recipients this account has sent to ({fan}) {strength} {direction} the risk",
    "tx_velocity": "The account's overall transaction volume {strength} {direction} the risk",
    "amount_log": "The transaction amount {strength} {direction} the risk",
    "amount_per_tx": "The average amount sent per transaction {strength} {direction} the risk",
    "currency_risk_score": "The currency used {strength} {direction} the risk due to the regulatory environment of its jurisdiction",
    "is_near_threshold": "The transaction amount being close to the mandatory reporting limit {strength} {direction} the risk",
    "is_high_fan_out": "The unusually large number of recipients {strength} {direction} the risk",
}
DRIVER_SENTENCE_DEFAULT = "{name} {strength} {direction} the risk"

BANNED_TERMS = [
    "SHAP",
    "shap_val",
    "feature importance",
    "fan_out_degree",
    "tx_velocity",
    "payment_format_risk",
    "is_in_cycle",
    "is_cross_border",
    "amount_log",
    "bank_risk_score",
]
DOLLAR_FIGURE_PATTERN = r"\$[\d,]{6,}"
DOLLAR_FIGURE_PATTERN_BATCH = r"\$[\d,]{5,}"
ISSUE_TERM = "technical term leaked: "
ISSUE_DOLLAR = "hallucinated large dollar amount"
ISSUE_DOLLAR_BATCH = "hallucinated dollar amounts: "
ISSUE_RATE = "transaction count described as a rate"
ISSUE_STRUCTURING = "structuring mentioned but amount not near threshold"
ISSUE_CROSS_BORDER = "cross-border mentioned but same-bank transaction"
ISSUE_CIRCULAR = "circular pattern mentioned but none detected"
WARNING_PREFIX = "\n\nVALIDATION WARNING: "

REPORT = {
    "status_flagged": "ALERT STATUS: FLAGGED — {confidence}-confidence suspicious activity detected",
    "status_cleared": "ALERT STATUS: CLEARED — No suspicious activity detected",
    "currency_note": "CURRENCY NOTE: Transaction originated as {origin}. {conversion}",
    "origin_usd": "a {size} USD transaction",
    "conversion_foreign_flagged": "All amounts have been converted to USD equivalent for analysis purposes using approximate market rates.",
    "conversion_crypto_flagged": "Cryptocurrency amounts are converted to USD equivalent at approximate market rates and may differ from the rate at time of transaction.",
    "conversion_foreign_cleared": "All amounts converted to USD equivalent for analysis using approximate market rates.",
    "conversion_crypto_cleared": "Cryptocurrency amount converted to USD equivalent at approximate market rates.",
    "amount_none": "an unspecified amount",
    "amount_usd": "${usd} USD",
    "amount_crypto": "{plain} BTC (approximately ${usd} USD at the time of the transaction)",
    "amount_foreign": "{symbol}{native} {currency} (approximately ${usd} USD equivalent, at an approximate rate of 1 {currency} = ${rate} USD)",
    "concern_flagged": "PRIMARY CONCERN: The use of {payment} as the payment method is the strongest indicator of risk here{compound}.",
    "compound_lead": ", further compounded by ",
    "compound_cross": "an inter-bank transfer",
    "compound_near": "a structuring-range amount",
    "compound_fan": "a high number of recipients",
    "compound_currency": "{currency_level} currency",
    "evidence_lead": "SUPPORTING EVIDENCE: ",
    "evidence_payment": "{payment} is a {payment_level} payment method frequently used in layering schemes because it is harder to reverse and easier to route through multiple accounts.",
    "evidence_near": "The transaction amount of {amount} falls within the $8,000–$10,000 USD range, which is a well-known indicator of structuring — deliberately sizing transactions to stay below the mandatory $10,000 reporting threshold.",
    "evidence_cross": "The transfer moves funds from {from_bank} to {to_bank}, crossing institutional boundaries. Inter-bank transfers are a common technique for obscuring the origin of funds.",
    "evidence_fan": "This account has sent money to {fan} different recipients over its lifetime. Distributing funds across a large number of recipients is a hallmark of smurfing.",
    "evidence_currency": "{currency} is a {currency_level} currency associated with jurisdictions that have weaker anti-money laundering oversight.",
    "evidence_fallback": "The combination of risk factors present in this transaction is statistically consistent with patterns observed in confirmed money laundering cases in the training dataset.",
    "note_flagged": "INVESTIGATOR NOTE: Escalate immediately to the AML compliance team for manual review. ",
    "note_near": "Obtain the full transaction history for this account over the past 90 days to determine whether {amount} reflects a deliberate pattern of threshold avoidance. ",
    "note_fan": "Investigate whether the {fan} recipient accounts share beneficial owners or show coordinated activity. ",
    "note_cross": "Request transaction records from {to_bank} to verify the ultimate destination of these funds.",
    "note_same_bank": "Document all associated accounts and consider account suspension pending review.",
    "concern_cleared": "PRIMARY CONCERN: None. ",
    "concern_normal": "This transaction falls within normal behavioural parameters.",
    "clear_payment": "{payment} is a {payment_level} payment method with strong traceability",
    "clear_same_bank": "both sender and receiver are at the same institution, reducing the opportunity for layering",
    "clear_amount": "the transaction amount does not fall in the structuring range",
    "clear_fan": "the account has only sent to {fan} recipient{plural} in total, which is consistent with normal activity",
    "clear_currency": "{currency} is a {currency_level} currency with strong regulatory oversight",
    "clear_margin": "The overall risk level is {margin} points below the alert threshold, indicating this transaction is consistent with legitimate activity.",
    "note_cleared": "INVESTIGATOR NOTE: No action required at this time. ",
    "note_volume": "This account has a high transaction volume ({velocity} total transactions) — ensure it remains on the standard periodic review schedule.",
    "note_routine": "Continue routine monitoring in line with standard AML policy.",
    "sending_bank": "the sending bank",
    "other_bank": "a different institution",
    "receiving_bank": "the receiving institution",
}

# --- sentences on activity and recipients ----------------------------------
# Upper limit, text; the last one holds for all larger values.
VELOCITY_DESCRIPTION = [
    (50, "low activity account ({v} total transactions)"),
    (500, "moderate activity account ({v} total transactions)"),
    (5000, "high activity account ({v} total transactions)"),
    (None, "very high volume account ({v} total transactions — warrants scrutiny)"),
]
# From this many transactions on, numbers are written with commas.
VELOCITY_COMMAS_FROM = 500
FAN_OUT_DESCRIPTION = [
    (3, "very low ({n} recipients — consistent with personal account)"),
    (10, "normal ({n} recipients — consistent with small business)"),
    (50, "elevated ({n} recipients — warrants review)"),
    (None, "very high ({n} recipients — strongly associated with smurfing and layering)"),
]
