"""Named queries: drivers, reports and text checks."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions import text
from txrisk.functions.scalars import plain_name
from txrisk.operators import cases
from txrisk.plans.catalog import query
from txrisk.plans.oracle import BASE, case_of, quoted
from txrisk.plans.scoring import score_payments
from txrisk.session import new_path
from txrisk.sources import writers
from txrisk.sources.warehouse import stored_payments

_KEYS = ["ts", "from_account", "to_account", "amount_paid", "payment_format", "is_laundering"]
_KEY_SQL = ", ".join(_KEYS)
_ORDER = _KEY_SQL


def _scored(spark, folder, parts=("sender",)):
    return score_payments(stored_payments(spark, folder), parts)


_CONTRIB = [
    ("payment_format_risk", "payment_format_risk * 8e-1"),
    ("currency_risk_score", "(currency_risk_score - 3) * 15e-2"),
    ("is_cross_border", "CASE WHEN is_cross_border = 1 THEN 3e-1 ELSE -2e-1 END"),
    ("fan_out_degree", "least(fan_out_degree / 50e0, 2e0) - 3e-1"),
    ("is_near_threshold", "is_near_threshold * 3e-1"),
]
_DRIVERS = f"""
part AS ({" UNION ALL ".join(
    f"SELECT scored.*, {i} AS place, '{n}' AS feature, {e} AS v FROM scored" for i, (n, e) in enumerate(_CONTRIB)
)}),
driver AS (SELECT *, round(v, 4) + 0e0 AS shap_val, CASE WHEN v > 0 THEN 'increases' ELSE 'decreases' END AS direction,
  (row_number() OVER (PARTITION BY {_KEY_SQL} ORDER BY abs(v) DESC, place))::INTEGER AS driver_rank FROM part)
"""


@query(
    "top_drivers",
    f"""{BASE}, {_DRIVERS} SELECT driver_rank, feature, direction, count(*) AS n, min(shap_val) AS min_value,
    max(shap_val) AS max_value FROM driver GROUP BY 1, 2, 3""",
)
def top_drivers(spark, folder):
    """Which features drive the rows, by rank and direction, over all rows.

    Every row has drivers, so the outer form of explode gives the same rows; the
    inner form would make Spark evaluate the ranking once more, in a filter.
    """
    ranked = cases.with_drivers(_scored(spark, folder)).select(F.posexplode_outer("drivers").alias("place", "d"))
    return ranked.groupBy(
        (F.col("place") + 1).alias("driver_rank"),
        F.col("d.feature").alias("feature"),
        F.col("d.direction").alias("direction"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("d.shap_val").alias("min_value"),
        F.max("d.shap_val").alias("max_value"),
    )


CASE_TABLES = f"""
ranked_case AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY {_ORDER}) AS case_rank FROM scored
  WHERE case_type <> 'TN'),
chosen AS (SELECT *, (row_number() OVER (ORDER BY CASE case_type WHEN 'TP' THEN 1 WHEN 'FP' THEN 2 ELSE 3 END,
  case_rank))::INTEGER AS case_id FROM ranked_case WHERE case_rank <= 10)
"""


@query(
    "case_drivers",
    f"""{BASE}, {_DRIVERS}, {CASE_TABLES} SELECT case_id, c.case_type, driver_rank, feature, shap_val, direction
    FROM chosen c JOIN driver d USING ({_KEY_SQL})""",
)
def case_drivers(spark, folder):
    reports = cases.case_reports(_scored(spark, folder))
    return reports.select("case_id", "case_type", F.posexplode_outer("drivers").alias("place", "d")).select(
        "case_id",
        "case_type",
        (F.col("place") + 1).alias("driver_rank"),
        "d.feature",
        "d.shap_val",
        "d.direction",
    )


@query(
    "case_top_driver_counts",
    f"""{BASE}, {_DRIVERS}, {CASE_TABLES} SELECT feature, count(*) AS n FROM chosen c JOIN driver d USING ({_KEY_SQL})
    WHERE driver_rank = 1 GROUP BY feature ORDER BY n DESC, feature LIMIT 5""",
)
def case_top_driver_counts(spark, folder):
    return cases.top_driver_counts(cases.case_reports(_scored(spark, folder)))


_LIST = "list_filter([{}], lambda x: x IS NOT NULL)"


def _piece(condition: str, template: str, **values: str) -> str:
    return f"CASE WHEN {condition} THEN {_fill(template, **values)} END"


def _fill(template: str, **values: str) -> str:
    """SQL expression for a template with its places replaced by expressions."""
    expression = quoted(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            expression = f"replace({expression}, '{{{name}}}', {value})"
    return expression


_R = fv.REPORT
_CENTS = "round(amount_paid * 100)::BIGINT"
_TRIMMED = f"""CASE WHEN {_CENTS} % 100 = 0 THEN '' WHEN {_CENTS} % 10 = 0 THEN '.' || ({_CENTS} % 100 // 10)::VARCHAR
  ELSE '.' || lpad(({_CENTS} % 100)::VARCHAR, 2, '0') END"""
_V = {
    "payment": case_of("payment_format_risk", fv.PAYMENT_NAME, "Unknown"),
    "payment_level": "CASE payment_format_risk WHEN 3 THEN 'high-risk' WHEN 2 THEN 'moderate-risk' ELSE 'low-risk' END",
    "currency_level": "CASE WHEN currency_risk_score >= 4 THEN 'high-risk' WHEN currency_risk_score = 3 THEN 'moderate-risk' ELSE 'low-risk' END",
    "currency": "payment_currency",
    "usd": "format('{:,}', round(amount_usd)::BIGINT)",
    "plain": f"({_CENTS} // 100)::VARCHAR || {_TRIMMED}",
    "native": f"format('{{:,}}', {_CENTS} // 100) || {_TRIMMED}",
    "symbol": case_of("payment_currency", fv.CURRENCY_SYMBOL, fv.CURRENCY_SYMBOL_DEFAULT),
    "rate": case_of("payment_currency", {n: t for n, (_, t) in fv.FX_TO_USD.items()}, "1"),
    "fan": "fan_out_degree::VARCHAR",
    "velocity": "format('{:,}', tx_velocity)",
    "from_bank": "from_bank::VARCHAR",
    "to_bank": "to_bank::VARCHAR",
    "plural": "CASE WHEN fan_out_degree = 1 THEN '' ELSE 's' END",
    "size": "CASE WHEN amount_usd < 1000 THEN 'small' WHEN amount_usd < 10000 THEN 'moderate' WHEN amount_usd < 100000 THEN 'large' ELSE 'very large' END",
    "confidence": "CASE WHEN risk_score >= 95e-2 THEN 'Very high' WHEN risk_score >= 85e-2 THEN 'High' WHEN risk_score >= 65e-2 THEN 'Moderate' ELSE 'Low' END",
    "amount": "amount_text",
    "origin": "origin_text",
    "margin": "(((round((65e-2 - risk_score) * 10000e0)::BIGINT + 5) // 10) // 10)::VARCHAR || '.' || (((round((65e-2 - risk_score) * 10000e0)::BIGINT + 5) // 10) % 10)::VARCHAR",
}
_NEAR, _CROSS, _MANY = "is_near_threshold = 1", "is_cross_border = 1", "fan_out_degree > 20"


def _list(*pieces: str) -> str:
    return _LIST.format(", ".join(pieces))


def _cap(x: str) -> str:
    return f"(upper({x}[1:1]) || {x}[2:])"


def _conversion(variant: str) -> str:
    return f"""CASE WHEN payment_currency = 'US Dollar' THEN '' WHEN payment_currency = 'Bitcoin'
      THEN {quoted(_R['conversion_crypto_' + variant])} ELSE {quoted(_R['conversion_foreign_' + variant])} END"""


_REPORTS = f"""
t0 AS MATERIALIZED (SELECT *, CASE WHEN amount_paid = 0 THEN {quoted(_R['amount_none'])}
    WHEN payment_currency = 'US Dollar' THEN {_fill(_R['amount_usd'], **_V)}
    WHEN payment_currency = 'Bitcoin' THEN {_fill(_R['amount_crypto'], **_V)}
    ELSE {_fill(_R['amount_foreign'], **_V)} END AS amount_text FROM scored),
t1 AS MATERIALIZED (SELECT *, CASE WHEN payment_currency = 'US Dollar' THEN {_fill(_R['origin_usd'], **_V)} ELSE amount_text END AS origin_text,
    {_list(_piece(_CROSS, _R['compound_cross']), _piece(_NEAR, _R['compound_near']), _piece(_MANY, _R['compound_fan']),
           _piece('currency_risk_score >= 4', _R['compound_currency'], **_V))} AS compound,
    {_list(_piece('payment_format_risk = 3', _R['evidence_payment'], **_V), _piece(_NEAR, _R['evidence_near'], **_V),
           _piece(_CROSS, _R['evidence_cross'], **_V), _piece(_MANY, _R['evidence_fan'], **_V),
           _piece('currency_risk_score >= 4', _R['evidence_currency'], **_V), quoted(_R['evidence_fallback']))} AS evidence,
    {_list(_piece('payment_format_risk <= 1', _R['clear_payment'], **_V), _piece(f'NOT ({_CROSS})', _R['clear_same_bank']),
           _piece(f'NOT ({_NEAR})', _R['clear_amount']), _piece('fan_out_degree <= 5', _R['clear_fan'], **_V),
           _piece('currency_risk_score <= 2', _R['clear_currency'], **_V))} AS reasons
  FROM t0),
report AS MATERIALIZED (SELECT *, CASE WHEN risk_score >= 65e-2 THEN
    {_fill(_R['status_flagged'], **_V)} || chr(10) || chr(10)
    || {_fill(_R['currency_note'], origin='origin_text', conversion=_conversion('flagged'))} || chr(10) || chr(10)
    || {_fill(_R['concern_flagged'], payment=_V['payment'],
              compound=f"CASE WHEN len(compound) > 0 THEN {quoted(_R['compound_lead'])} || array_to_string(compound, ' and ') ELSE '' END")}
    || chr(10) || chr(10) || {quoted(_R['evidence_lead'])} || array_to_string(evidence[1:2], ' ')
    || chr(10) || chr(10) || {quoted(_R['note_flagged'])}
    || CASE WHEN {_NEAR} THEN {_fill(_R['note_near'], **_V)} ELSE '' END
    || CASE WHEN {_MANY} THEN {_fill(_R['note_fan'], **_V)} ELSE '' END
    || CASE WHEN {_CROSS} THEN {_fill(_R['note_cross'], **_V)} ELSE {quoted(_R['note_same_bank'])} END
  ELSE
    {quoted(_R['status_cleared'])} || chr(10) || chr(10)
    || {_fill(_R['currency_note'], origin='origin_text', conversion=_conversion('cleared'))} || chr(10) || chr(10)
    || {quoted(_R['concern_cleared'])}
    || CASE WHEN len(reasons) > 0 THEN {_cap('reasons[1]')} || '.' ELSE {quoted(_R['concern_normal'])} END
    || chr(10) || chr(10) || {quoted(_R['evidence_lead'])}
    || CASE WHEN len(reasons) >= 2 THEN {_cap('reasons[1]')} || ', and ' || reasons[2] || '. ' ELSE '' END
    || {_fill(_R['clear_margin'], **_V)}
    || chr(10) || chr(10) || {quoted(_R['note_cleared'])}
    || CASE WHEN tx_velocity > 500 THEN {_fill(_R['note_volume'], **_V)} ELSE {quoted(_R['note_routine'])} END
  END AS explanation FROM t1)
"""


@query("report_texts", f"{BASE}, {_REPORTS} SELECT {_KEY_SQL}, verdict, md5(explanation) AS report_md5, length(explanation) AS n_chars FROM report")
def report_texts(spark, folder):
    """A report for every payment, compared by digest."""
    explained = cases.with_explanation(_scored(spark, folder))
    return explained.select(
        *_KEYS, "verdict", F.md5("explanation").alias("report_md5"), F.length("explanation").cast("bigint").alias("n_chars")
    )


@query(
    "case_reports",
    f"""{BASE}, {_REPORTS}, {CASE_TABLES} SELECT case_id, c.case_type, c.risk_score, is_laundering AS actual_label,
    c.verdict, r.explanation FROM chosen c JOIN report r USING ({_KEY_SQL})""",
)
def case_reports(spark, folder):
    reports = cases.case_reports(_scored(spark, folder))
    return cases.reports_of_type(reports).select(
        "case_id", "case_type", "risk_score", "actual_label", "verdict", "explanation"
    )


_STRENGTH = "CASE WHEN abs(shap_val) > 15e-1 THEN 'strongly' WHEN abs(shap_val) > 5e-1 THEN 'moderately' ELSE 'slightly' END"
_DIRECTION = "CASE WHEN shap_val > 0 THEN 'increased' ELSE 'reduced' END"


def _sentence_sql() -> str:
    values = {"strength": _STRENGTH, "direction": _DIRECTION, "payment": _V["payment"], "fan": _V["fan"]}
    arms = " ".join(
        f"WHEN '{name}' THEN {_fill(fv.DRIVER_SENTENCES[name], **values)}" for name, _ in _CONTRIB
    )
    return f"CASE feature {arms} END"


@query(
    "driver_sentences",
    f"""{BASE}, {_DRIVERS} SELECT sentence, count(*) AS n FROM
    (SELECT {_sentence_sql()} AS sentence FROM driver WHERE driver_rank <= 3) GROUP BY sentence""",
)
def driver_sentences(spark, folder):
    """Sentences for the three strongest drivers of every row, counted."""
    sentences = text.driver_sentences(F.col("drivers"), text.payment_name(F.col("payment_format_risk")), F.col("fan_out_degree"))
    rows = cases.with_drivers(_scored(spark, folder)).select(F.explode_outer(sentences).alias("sentence"))
    return rows.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "description_bands",
    f"""{BASE}, d AS (SELECT {_V['payment']} AS payment,
      {case_of('payment_format_risk', fv.PAYMENT_DESCRIPTION, fv.PAYMENT_DESCRIPTION_DEFAULT)} AS payment_risk,
      {case_of('currency_risk_score', fv.CURRENCY_DESCRIPTION, fv.CURRENCY_DESCRIPTION_DEFAULT)} AS currency_risk,
      CASE WHEN bank_risk_score / 100e0 < 1e-1 THEN 'clean record' WHEN bank_risk_score / 100e0 < 2e-1 THEN 'minor historical concerns'
           WHEN bank_risk_score / 100e0 < 3e-1 THEN 'moderate laundering history'
           ELSE 'significant laundering history — high risk institution' END AS bank,
      CASE WHEN tx_velocity < 50 THEN 'low activity account (' || tx_velocity || ' total transactions)'
           WHEN tx_velocity < 500 THEN 'moderate activity account (' || tx_velocity || ' total transactions)'
           WHEN tx_velocity < 5000 THEN 'high activity account (' || format('{{:,}}', tx_velocity) || ' total transactions)'
           ELSE 'very high volume account (' || format('{{:,}}', tx_velocity) || ' total transactions — warrants scrutiny)' END AS activity,
      CASE WHEN fan_out_degree <= 3 THEN 'very low (' || fan_out_degree || ' recipients — consistent with personal account)'
           WHEN fan_out_degree <= 10 THEN 'normal (' || fan_out_degree || ' recipients — consistent with small business)'
           WHEN fan_out_degree <= 50 THEN 'elevated (' || fan_out_degree || ' recipients — warrants review)'
           ELSE 'very high (' || fan_out_degree || ' recipients — strongly associated with smurfing and layering)' END AS recipients,
      CASE WHEN risk_score >= 95e-2 THEN 'very high' WHEN risk_score >= 85e-2 THEN 'high' WHEN risk_score >= 7e-1 THEN 'moderate' ELSE 'low' END AS confidence
      FROM scored)
    SELECT *, count(*) AS n FROM d GROUP BY ALL""",
)
def description_bands(spark, folder):
    scored = _scored(spark, folder, ("sender", "bank"))
    described = scored.select(
        text.payment_name(F.col("payment_format_risk")).alias("payment"),
        text.payment_description(F.col("payment_format_risk")).alias("payment_risk"),
        text.currency_description(F.col("currency_risk_score")).alias("currency_risk"),
        text.bank_description(F.col("bank_risk_score")).alias("bank"),
        text.velocity_description(F.col("tx_velocity")).alias("activity"),
        text.fan_out_description(F.col("fan_out_degree")).alias("recipients"),
        text.confidence(F.col("risk_score")).alias("confidence"),
    )
    return described.groupBy(*described.columns).agg(F.count(F.lit(1)).alias("n"))


def _issue_sql() -> str:
    terms = [f"CASE WHEN contains(low, '{t.lower()}') THEN '{fv.ISSUE_TERM}{t}' END" for t in fv.BANNED_TERMS]
    return ", ".join(
        [
            *terms,
            f"CASE WHEN regexp_matches(body, '\\$[0-9,]{{6,}}') THEN '{fv.ISSUE_DOLLAR}' END",
            f"CASE WHEN contains(low, 'per hour') OR contains(low, 'per minute') THEN '{fv.ISSUE_RATE}' END",
            f"CASE WHEN is_near_threshold = 0 AND contains(low, 'structur') THEN '{fv.ISSUE_STRUCTURING}' END",
            f"CASE WHEN is_cross_border = 0 AND contains(low, 'cross-border') THEN '{fv.ISSUE_CROSS_BORDER}' END",
            f"CASE WHEN is_in_cycle = 0 AND contains(low, 'circular') THEN '{fv.ISSUE_CIRCULAR}' END",
        ]
    )


_ISSUE_BODY = "explanation || CASE WHEN to_account % 5 = 0 THEN ' circular cross-border tx_velocity per hour' ELSE '' END"


def count_and_first_digest(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows and the smallest MD5 (32 hexadecimal digits) per key.

    The smallest of texts is found by sorting the rows. So the first 31 digits are compared as
    a number, which a hash aggregate keeps, for each last digit; texts are compared among those.
    """
    word, last = F.lit(Decimal(1 << 64)).cast("decimal(20,0)"), F.substring(digest, 32, 1)

    def digits(start: int, n: int) -> Column:
        return F.conv(F.substring(digest, start, n), 16, 10)

    number = digits(1, 15).cast("decimal(19,0)") * word + digits(16, 16).cast("decimal(20,0)")
    least = rows.groupBy(key, last.alias("_last")).agg(
        F.count(F.lit(1)).alias("n"), F.min(number.cast("decimal(38,0)")).alias("_number")
    )
    high = F.expr(f"_number div cast({1 << 64} as decimal(20,0))").cast("decimal(19,0)")
    low = F.col("_number") - high * word
    pieces = [F.lpad(F.lower(F.conv(part.cast("string"), 10, 16)), n, "0") for part, n in ((high, 15), (low, 16))]
    return least.groupBy(key).agg(F.sum("n").alias("n"), F.min(F.concat(*pieces, "_last")).alias("first_digest"))


@query(
    "report_issues",
    f"""{BASE}, {_REPORTS}, body AS MATERIALIZED (SELECT *, {_ISSUE_BODY} AS body, lower({_ISSUE_BODY}) AS low FROM report),
    found AS MATERIALIZED (SELECT *, list_filter([{_issue_sql()}], lambda x: x IS NOT NULL) AS issues FROM body)
    SELECT array_to_string(issues, '; ') AS issues, count(*) AS n, min(md5(body || CASE WHEN len(issues) > 0
      THEN chr(10) || chr(10) || 'VALIDATION WARNING: ' || array_to_string(issues, '; ') ELSE '' END)) AS first_digest
    FROM found GROUP BY 1""",
)
def report_issues(spark, folder):
    """Contradictions in the report texts, some of them planted, over all rows."""
    planted = F.when(F.col("to_account") % 5 == 0, " circular cross-border tx_velocity per hour").otherwise("")
    explained = cases.with_explanation(_scored(spark, folder, ("sender", "cycle")))
    body = explained.withColumn("body", F.concat("explanation", planted))
    checked = body.withColumn("issues", text.text_issues(F.col("body")))
    warned = checked.withColumn("warned", text.with_warning(F.col("body"), F.col("issues")))
    return count_and_first_digest(warned.select(F.array_join("issues", "; ").alias("issues"), F.md5("warned").alias("md5")), "issues", "md5")


@query(
    "feature_titles",
    f"""{BASE}, {_DRIVERS} SELECT DISTINCT feature, array_to_string(list_transform(string_split(feature, '_'),
    lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM driver""",
)
def feature_titles(spark, folder):
    drivers = cases.with_drivers(_scored(spark, folder)).select(F.explode_outer("drivers").alias("d"))
    names = drivers.select(F.col("d.feature").alias("feature")).distinct()
    return names.withColumn("title", plain_name(F.col("feature")))


@query(
    "text_reports_read_back",
    f"""{BASE}, {_REPORTS}, {CASE_TABLES} SELECT c.case_type, count(*) AS n,
    count(*) FILTER (c.is_laundering = 1) AS n_fraud, sum(len(string_split(r.explanation, chr(10))))::BIGINT AS n_lines
    FROM chosen c JOIN report r USING ({_KEY_SQL}) GROUP BY c.case_type""",
)
def text_reports_read_back(spark, folder):
    """Case reports written as text and counted from the files: headings, labels, lines of explanation."""
    reports = cases.case_reports(_scored(spark, folder))
    path = new_path(spark, "case-texts")
    writers.write_case_report_text(reports, path)
    blocks = spark.read.option("lineSep", "=" * 65 + "\n").text(path).where(F.col("value").contains("CASE "))
    heading = F.regexp_extract("value", r"CASE \d+ — (\w+) —", 1)
    body = F.regexp_extract("value", r"(?s)Explanation:\n(.*)\n\n$", 1)
    return blocks.groupBy(heading.alias("case_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("value").contains("Actual Label: FRAUD"), 1).otherwise(0)).alias("n_fraud"),
        F.sum(F.size(F.split(body, "\n"))).alias("n_lines"),
    )
