"""Quality rules of documents and of their hosts.

Every document is measured with array and string functions of Spark. Failures of each
rule are summed by host, the host's rate is shrunk towards the rate of all hosts by an
empirical beta prior (method of moments), and a host whose shrunk rate of any rule
passes the limit is rejected with all its documents. A host of few documents therefore
needs far more evidence than a large one.

The measures are written once as a narrow table; texts are read once. Sums by host
combine before the shuffle, the prior is one row, and verdicts go back by an equality
join whose host side has one row per host.

Null texts have no words. A null host is a host of its own. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import SPACE_TEXT, materialize, whole_text, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host is rejected when the shrunk failure rate of a rule is above this.
MAX_HOST_RATE = 0.5
#: The weight of the prior in documents stays within these.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6


def rules() -> dict[str, Column]:
    """Rule name to failure condition over the measures; a document may fail several."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * words,
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row per document: counts of words, symbols, lines and repeats.

    ``n_repeat_words`` counts the words inside 3-word windows that occur at least twice:
    windows are sorted with their places, equal neighbours mark their places, and the
    union of the marked places is counted. The work for a text is n log n.
    """
    base = docs.select("doc_id", F.col(host).alias("host"), whole_text().alias("text"))
    split = base.withColumn("words", words_of(F.col("text"))).withColumn(
        "lines",
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE_TEXT)) != ""),
    )
    words, windows = F.col("words"), F.col("windows")
    counted = split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.transform(
                F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                lambda word, at: F.struct(
                    F.concat_ws(" ", word, F.get(words, at + 1), F.get(words, at + 2)).alias("window"),
                    at.alias("at"),
                ),
            )
        ).alias("windows"),
    )
    marked = counted.withColumn(
        "starts",
        F.transform(
            F.filter(
                windows,
                lambda one, k: (one.window == F.get(windows, k + 1).window)
                | (one.window == F.get(windows, k - 1).window),
            ),
            lambda one: one["at"],
        ),
    )
    covered = F.array_distinct(
        F.concat(
            "starts",
            F.transform("starts", lambda at: at + 1),
            F.transform("starts", lambda at: at + 2),
        )
    )
    return marked.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("windows", "starts")


def host_counts(measured: DataFrame) -> DataFrame:
    fails = [F.count_if(failed).alias(name) for name, failed in rules().items()]
    return measured.groupBy("host").agg(F.count("*").alias("n"), *fails)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Alpha and beta of each rule, from one row of sums over all hosts.

    The variance of host rates beyond what chance gives for hosts of these sizes sets
    the strength of the prior.
    """
    names = list(rules())
    sums = [F.sum(name).alias(name) for name in names]
    squares = [F.sum(F.col(name) * F.col(name) / F.col("n")).alias(f"{name}_sq") for name in names]
    row = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *sums, *squares).first()
    priors = {}
    for name in names:
        if not row["n"]:
            priors[name] = (1.0, 1.0)
            continue
        mean = row[name] / row["n"]
        spread = row[f"{name}_sq"] / row["n"] - mean * mean
        chance = mean * (1 - mean) * row["hosts"] / row["n"]
        between = spread - chance
        strength = mean * (1 - mean) / between - 1 if between > 0 else math.inf
        strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
        priors[name] = (mean * strength, (1 - mean) * strength)
    return priors


def host_verdicts(hosts: DataFrame, limit: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts with shrunk rates and the verdict."""
    shrunk = {
        f"{name}_rate": (F.col(name) + alpha) / (F.col("n") + alpha + beta)
        for name, (alpha, beta) in beta_priors(hosts).items()
    }
    rated = hosts.withColumns(shrunk)
    worst = F.greatest(*[F.col(name) for name in shrunk])
    return rated.withColumn("host_rejected", worst > limit)


def apply_rules(docs: DataFrame, host: str = "source", limit: float = MAX_HOST_RATE) -> DataFrame:
    """Measures, ``base_failed``, ``host_rejected`` and ``kept`` for each document."""
    measured = materialize(measure(docs, host), "measures")
    hosts = materialize(host_verdicts(materialize(host_counts(measured), "hosts"), limit), "host-verdicts")
    checks = rules()
    verdicts = hosts.select(F.col("host").alias("judged"), "host_rejected")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("judged"))).drop("judged")
    failed = joined.withColumn("base_failed", checks["short"] | checks["repeats"])
    return failed.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
