"""The named queries of the text operators, whole tables in and whole results out, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import (
    bpe_codec,
    chaining,
    cross_entropy,
    curriculum,
    host_rules,
    packing,
    pii_crf,
    pii_rules,
    ranked_search,
    simhash,
    token_files,
    toxicity,
    whitening,
)
from txrisk.llm.common import materialize, new_path, read_table, ship_package
from txrisk.llm.digest_index import DigestIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: (ship_package(spark), function(spark, sf_dir))[1]
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 2
BYTE_TOKENIZER = "byte_bpe_50k.json"


@query("op1_token_files")
def op1_token_files(spark, sf_dir):
    folder = new_path(spark, "token-files")
    docs = read_table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, folder, public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return token_files.read_tokens(spark, folder, digest_only=True)


@query("op2_bpe_codec")
def op2_bpe_codec(spark, sf_dir):
    docs, path = read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER)
    return bpe_codec.digests(bpe_codec.encode_and_decode(docs, path, bpe_codec.build_lexicon(docs, path)))


@query("op3_compression_toxicity")
def op3_compression_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", hexed, "component_id")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_HOST_RULES = ("short", "repeats", "symbols", "lines")


def _rate(name: str) -> str:
    mean, chance = f"sum({name}) / sum(n)", "count(*) / sum(n)"
    return f"""(SELECT {mean} AS m, sum({name} * {name} / n) / sum(n) - ({mean}) * ({mean})
        - ({mean}) * (1 - {mean}) * {chance} AS between_hosts FROM h)"""


@query(
    "op5_host_rules",
    rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
    g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS window_text
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window_text) AS n FROM g),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, range(3) t(k) WHERE n > 1 GROUP BY 1),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
    m AS (SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
      100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines FROM m),
    h AS (SELECT source, count(*)::DOUBLE AS n,
      {', '.join(f'count(*) FILTER ({name})::DOUBLE AS {name}' for name in _HOST_RULES)} FROM f GROUP BY 1),
    p AS (SELECT source, {' OR '.join(
        f'''(SELECT ({name} + m * s) / (n + s) > 0.5 FROM (SELECT m, CASE WHEN between_hosts > 0
        THEN least(greatest(m * (1 - m) / between_hosts - 1, 1), 1e6) ELSE 1e6 END AS s FROM {_rate(name)}))'''
        for name in _HOST_RULES)} AS host_rejected FROM h)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
      n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, short OR repeats AS base_failed,
      NOT (short OR repeats) AND NOT host_rejected AS kept, host_rejected
    FROM f JOIN p ON f.source IS NOT DISTINCT FROM p.source""",
)
def op5_host_rules(spark, sf_dir):
    judged = host_rules.apply_rules(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "host_rejected",
    )


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _of_kind(kind):
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")


@query("op6_pii_crf")
def op6_pii_crf(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = pii_crf.find_personal_data(docs, pii_crf.fit(docs))
    counts = [_of_kind(kind).alias(f"n_{kind}") for kind in pii_rules.KINDS]
    base = F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, _written(F.col("spans")).alias("spans"))


@query("op7_cross_entropy")
def op7_cross_entropy(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return cross_entropy.score_documents(docs, cross_entropy.fit(docs, read_table(spark, sf_dir, "labels")))


@query("op8_chaining")
def op8_chaining(spark, sf_dir):
    return chaining.passages(read_table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query(
    "op9_curriculum",
    rf"""WITH s AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(doc_id::VARCHAR) AS place FROM documents),
    r AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
      FROM s GROUP BY source),
    w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM r),
    -- the level at which shares by weight, each stopped at its cap, use up all words
    l AS (SELECT a.rank, (SELECT sum(source_size) FROM w)::BIGINT AS total,
      coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight
        OR b.cap / b.weight = a.cap / a.weight AND b.rank < a.rank), 0)::BIGINT AS capped,
      sum(b.weight) FILTER (b.cap / b.weight > a.cap / a.weight
        OR b.cap / b.weight = a.cap / a.weight AND b.rank >= a.rank)::BIGINT AS open,
      any_value(a.cap) AS cap, any_value(a.weight) AS weight FROM w a, w b GROUP BY a.rank),
    v AS (SELECT min((total - capped)::DOUBLE / open) AS level FROM l
      WHERE cap > (total - capped)::DOUBLE / open * weight
        AND cap / weight = (SELECT min(cap / weight) FROM l WHERE cap > (total - capped)::DOUBLE / open * weight)),
    t AS (SELECT source, source_size, rank, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM w, v),
    d AS (SELECT doc_id, size, source_size, target, rank, coalesce(sum(size) OVER (PARTITION BY s.source
      ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2 AS middle
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
    k AS (SELECT *, CASE WHEN size > 0 THEN (middle < target)::INT + (middle + source_size < target)::INT
      + (middle + 2 * source_size < target)::INT ELSE 0 END AS copies, middle / target AS y FROM d)
    SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
      CASE WHEN copies = 0 THEN NULL
        WHEN rank % 3 = 1 THEN round(y, 6)
        WHEN rank % 3 = 2 THEN round(1.5::DOUBLE - sqrt(2.25::DOUBLE - 2 * y), 6)
        WHEN y * 0.875::DOUBLE <= 0.25 THEN round(y * 0.875::DOUBLE / 0.5::DOUBLE, 6)
        ELSE round(0.5::DOUBLE + (sqrt(0.25::DOUBLE + 6 * (y * 0.875::DOUBLE - 0.25::DOUBLE)) - 0.5::DOUBLE) / 3, 6)
      END AS first_position
    FROM k""",
)
def op9_curriculum(spark, sf_dir):
    assigned = materialize(curriculum.assign(read_table(spark, sf_dir, "documents")), "assigned")
    return curriculum.taken_by(assigned, curriculum.mix(assigned)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.round("first_position", 6).alias("first_position"),
    )


@query(
    "op10_digest_index",
    """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256 FROM n WINDOW g AS (PARTITION BY text)""",
)
def op10_digest_index(spark, sf_dir):
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    return index.deduplicate(read_table(spark, sf_dir, "documents"))


PACK_END_ID = 0


@query("op11_packing")
def op11_packing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_TOKENIZER), PACK_END_ID)


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    "op12_ranked_search",
    f"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
    d AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM w WHERE len(terms) > 0),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
    q AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS item, item_id,
      unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM w)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
    r AS (SELECT item, item_id, row, doc_id, sum(q * weight * ((1000000000 * tf)
      // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN p USING (term) JOIN d USING (row), s GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM r WHERE score > 0 QUALIFY rank <= 10""",
)
def op12_ranked_search(spark, sf_dir):
    index = ranked_search.build_index(read_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, read_table(spark, sf_dir, "benchmark"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))
