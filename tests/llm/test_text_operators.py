"""The text operators against brute force, the tokenizers library, planted cases and odd inputs."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from compare import connect, differences
from txrisk.llm import (
    bpe_codec,
    chaining,
    cross_entropy,
    curriculum,
    host_rules,
    pii_crf,
    pii_rules,
    simhash,
    token_files,
    toxicity,
)
from txrisk.llm.common import new_path, ship_package
from txrisk.llm.components import components
from txrisk.llm.digest_index import DigestIndex
from txrisk.llm.queries import ORACLES, QUERIES
from txrisk.llm.transducer import Transducer

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, words int, fp long, seed int, batch string, n int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def table(spark, texts, sources=None):
    rows = [
        (k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", (sources or ["s"])[k % len(sources or "s")], 0, 1, 2, 3, 4, "b", 5)
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, repeated and null-keyed rows, clashing column names."""
    long_text = " ".join(f"w{k % 977}" for k in range(60_000)) + " " + "x" * 30_000
    texts = [None, "", " \t\n", long_text, "A b c", "a B c", (7, "same row"), (7, "same row"), (None, "no id"), "ünï cødé 🙂 İ Σ"]
    return table(spark, texts, ["s", None, "t"])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, connection, name):
    assert differences(QUERIES[name](spark, folder), connection, ORACLES[name]) is None


def documents(folder):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet' ORDER BY 1").fetchall()


# exact dedup


def test_digest_index_odd_rows(spark, odd, empty):
    index = DigestIndex(spark, new_path(spark, "index"), buckets=4)
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.deduplicate(odd).collect()}
    assert {(0, 1, 2, False), (1, 1, 2, True), (4, 5, 2, False), (5, 5, 2, True), (7, 7, 2, True), (None, None, 1, True)} <= rows
    assert index.deduplicate(empty, "second").count() == 0
    kept = DigestIndex(spark, new_path(spark, "index")).keep_rows(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 2, 3, 5, 7, 9]


def test_digest_index_persists_and_later_batches_lose(spark):
    path = new_path(spark, "index")
    DigestIndex(spark, path, 4).deduplicate(table(spark, ["a", "b"]), "one").collect()
    later = DigestIndex(spark, path, 4).deduplicate(table(spark, [(8, "A"), (9, "c")]), "two")
    for _ in range(2):  # a batch submitted again gives the same verdicts
        assert {(r.doc_id, r.keep_id, r.kept) for r in later.collect()} == {(8, 0, False), (9, 9, True)}
        later = DigestIndex(spark, path, 4).deduplicate(table(spark, [(8, "A"), (9, "c")]), "two")
    assert DigestIndex(spark, path, 4).table().count() == 3


# quality rules


def test_host_rules_odd_rows_and_bad_host(spark, odd, empty):
    assert host_rules.apply_rules(odd).count() == 10
    assert host_rules.apply_rules(empty).count() == 0
    good = " ".join(f"word{k}" for k in range(60))
    bad = " ".join(["again and again"] * 20)
    texts = [good] * 60 + [bad] * 59 + [good]
    rows = [(k, t, "en", "good" if k < 60 else "bad", *range(4), 0, "b", 5) for k, t in enumerate(texts)]
    judged = host_rules.apply_rules(spark.createDataFrame(rows, COLUMNS))
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in judged.collect()}
    assert verdicts[0] == (False, True) and verdicts[60] == (True, False) and verdicts[119] == (False, False)


# mixing


def test_curriculum_targets_and_order(spark, odd, empty, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mix = curriculum.assign(docs).toPandas()
    for _, part in mix.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()
    assert (mix.taken <= 3 * mix["size"]).all()
    assert mix.positions.map(lambda p: all(0 <= t <= 1 for t in p) and list(p) == sorted(p)).all()
    assert curriculum.assign(odd).count() == 10 and curriculum.assign(empty).count() == 0
    order = curriculum.training_order(docs)
    assert order.columns == docs.columns and order.count() == mix.positions.map(len).sum()
    assert [r.doc_id for r in order.collect()] == [r.doc_id for r in curriculum.training_order(docs).collect()]
    assert curriculum.training_order(odd).columns == odd.columns


# encoding

PIECES = ["a", "B", "é", "É", " ", "  ", "\n", "\x1c", "\x85", "\xa0", " ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "12", "½", "…", "...", "!", "ß", "İ", "Σ", "é", "가", "中文", "🙂", "\x00", "K", "_", "﻿"]


def fuzz(n, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choices(PIECES, k=pick.randint(0, 25))) for _ in range(n)] + ["", "a" * 3000, "ab" * 2000]


def test_word_encoder_equals_library():
    library, mine = Tokenizer.from_file(WORD_BPE), token_files.TextEncoder(WORD_BPE, "<u2")
    for text in fuzz(1500):
        assert np.frombuffer(mine.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_byte_codec_equals_library():
    library, words = Tokenizer.from_file(BYTE_BPE), bpe_codec.Vocabulary(BYTE_BPE)
    lexicon = sorted({w.encode() for t in fuzz(200, 1) for w in bpe_codec.words_of_text(t)})
    automaton = Transducer.build(lexicon, [words.merge(w) for w in lexicon])
    texts = fuzz(1500)
    for codec in (bpe_codec.Codec(words), bpe_codec.Codec(words, automaton)):
        for text, ids in zip(texts, codec.encode_many(texts)):
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert words.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_transducer_is_minimal_and_exact(tmp_path):
    words = sorted({(a + b).encode() for a in ("re", "un", "pre", "") for b in ("do", "doing", "make", "making")})
    built = Transducer.build(words, [(k, k + 1) for k in range(len(words))])
    with open(tmp_path / "t", "wb") as file:
        built.save(file)
    opened = Transducer.open(str(tmp_path / "t"))
    assert opened.numbers(words).tolist() == list(range(len(words))) and opened.ids(3) == (3, 4)
    assert opened.numbers([b"", b"und", b"redone", b"do\xff"]).tolist() == [-1] * 4
    assert built.n_states < len(set(w[:k] for w in words for k in range(len(w) + 1))) / 2
    assert Transducer.build([], []).numbers([b"a", b""]).tolist() == [-1, -1]


def test_token_files_and_round_trip(spark, folder, odd, empty):
    library, start = Tokenizer.from_file(WORD_BPE), 0
    found = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, folder).collect()}
    for doc_id, text in documents(folder):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        row = found[doc_id]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    place = new_path(spark, "tokens")
    token_files.write_tokens(odd, place, WORD_BPE, 2)
    rows = token_files.read_tokens(spark, place).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 5, 7, 7, 9] and rows[1].ids == [2]
    place = new_path(spark, "tokens")
    token_files.write_tokens(empty, place, WORD_BPE, 2)
    assert token_files.read_tokens(spark, place).count() == 0


def test_codec_tables(spark, odd, empty):
    lexicon = bpe_codec.build_lexicon(odd, BYTE_BPE)
    decoded = bpe_codec.decode_documents(bpe_codec.encode_documents(odd, BYTE_BPE, lexicon), BYTE_BPE)
    assert sorted(r.text for r in decoded.collect()) == sorted(r.text or "" for r in odd.collect())
    lexicon = bpe_codec.build_lexicon(empty, BYTE_BPE)
    assert bpe_codec.encode_documents(empty, BYTE_BPE, lexicon).count() == 0


# near dedup


def brute_components(fps):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        lower = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (lower == label).all():
            return label
        label = lower


def test_fingerprint_definition():
    for text in ["", " ", "One", "one TWO", "a b c d", "x y z x y z", "É è   c d"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [words[k : k + 3] for k in range(len(words) - 2)] if len(words) > 2 else [words] * bool(words)
        hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
        expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == expected


@pytest.mark.parametrize("limit", [2048, 20])
def test_links_of_crowded_fingerprints(spark, limit):
    """Many fingerprints around few centres; the low limit makes every level of the recursion work."""
    pick = np.random.default_rng(3)
    centres = pick.integers(0, 2**64, 4, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in pick.choice(64 if k % 3 else 14, k % 7, replace=False))) for k in range(400)]
    fps = np.unique(np.array([centres[k % 4] ^ f for k, f in enumerate(flips)], dtype=np.uint64))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(simhash.links(frame, limit)).collect()}
    label = brute_components(fps)
    groups = {}
    for fp, own in zip(fps.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(own, set()).add(found.get(fp, fp))
    assert all(len(roots) == 1 for roots in groups.values()) and len({r for g in groups.values() for r in g}) == len(groups)


def test_simhash_tables(spark, folder, odd, empty):
    rows = documents(folder)
    label = brute_components(np.array([simhash.fingerprint(t) for _, t in rows], dtype=np.uint64))
    found = {r.doc_id: r.component_id for r in QUERIES["op4_simhash"](spark, folder).collect()}
    assert found == {doc_id: rows[own][0] for (doc_id, _), own in zip(rows, label)}
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.fp == 0} == {0}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


# toxicity, personal data, language models


def test_toxicity_held_out(spark, odd, empty):
    pick = random.Random(1)
    parts = ["the", "and", "ion", "ther", "ou", "ing", "er", "es", "on", "an"]
    word = lambda: "".join(pick.choices(parts, k=pick.randint(1, 4)))
    texts, toxic = [], []
    for k in range(400):
        words = [word() for _ in range(80)]
        toxic.append(int(k % 8 == 0))
        for _ in range(3 * toxic[-1]):
            words.insert(pick.randrange(80), pick.choice(["worthless", "pathetic", "disgusting"]))
        texts.append(" ".join(words))
    docs = table(spark, texts)
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.score_documents(odd, none).collect()} == {0}
    model = toxicity.fit(docs, labels)
    assert toxicity.score_documents(odd, model).count() == 10 and toxicity.score_documents(empty, model).count() == 0
    assert toxicity.keep_ordinary(docs, labels).columns == docs.columns


def plain_base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return found


def test_base_rules_equal_patterns():
    pick = random.Random(7)
    parts = ["a", "b.c", "@", "@x.co", "_", "+", "1", "23", ".", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (784) 555-8120", " ", "-", "é", "10.0.0.1", "\n", "٣"]
    for _ in range(4000):
        text = "".join(pick.choices(parts, k=pick.randint(0, 14)))
        assert pii_rules.base_spans(text) == plain_base(text), text
    assert pii_rules.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_field_adds_and_keeps_base(spark, odd, empty):
    pick = random.Random(2)
    word = lambda: "".join(pick.choices(["the", "ion", "er", "an", "st"], k=2))
    made = lambda: pick.choice(["mail.%d@site.example.com" % pick.randrange(99), "+1 (784) 555-%d" % pick.randrange(1000, 9999), "12.197.240.%d" % pick.randrange(99)])
    texts = [" ".join([*[word() for _ in range(9)], made(), *[word() for _ in range(9)]]) for _ in range(300)]
    texts += [" ".join(word() for _ in range(20)) for _ in range(300)]
    docs = table(spark, texts)
    field = pii_crf.fit(docs)
    rows = pii_crf.find_personal_data(docs, field).collect()
    assert all(set(r.base) <= set(r.spans) for r in rows)
    assert not [r for r in rows if r.doc_id >= 300 and r.spans]
    missed = table(spark, ["the ion st er call (784) 555-8120 an ion the"])
    assert [s.kind for s in pii_crf.find_personal_data(missed, field).first().spans] == ["phone"]
    assert pii_crf.find_personal_data(odd, field).count() == 10 and pii_crf.find_personal_data(empty, field).count() == 0
    assert pii_crf.fit(empty) is None and pii_crf.find_personal_data(odd, None).count() == 10


def test_cross_entropy_prefers_the_target(spark, odd, empty):
    good, other = ["the cat sat on the mat again " * 5] * 40, ["##$$ qx zzq 77 %%" * 5] * 40
    docs = table(spark, good + other)
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    model = cross_entropy.fit(docs, labels)
    scores = {r.doc_id: r.score for r in cross_entropy.score_documents(docs, model).collect()}
    assert min(scores[k] for k in range(40)) > max(scores[k] for k in range(40, 80))
    odd_scores = cross_entropy.score_documents(odd, model).collect()
    assert len(odd_scores) == 10 and [r.score for r in odd_scores if r.doc_id == 0] == [0.0]
    assert cross_entropy.score_documents(empty, cross_entropy.fit(empty, labels)).count() == 0
    counts = np.zeros(cross_entropy.GRAMS, dtype=np.uint32)
    counts[[5, 70, 4096 * 3 + 5]] = 9
    sums = np.exp(cross_entropy.log_probabilities(counts)).reshape(-1, cross_entropy.SYMBOLS).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)


# passages


def best_chain(x, y):
    order = sorted(range(len(x)), key=lambda k: (x[k], y[k]))
    score = {}
    for k in order:
        gains = [score[j] - chaining.GAP_COST * (x[k] - x[j] + y[k] - y[j]) for j in score if x[j] < x[k] and y[j] < y[k]]
        score[k] = chaining.K + max([0.0, *gains])
    return max(score.values())


def test_fenwick_chains_equal_brute_force():
    pick = random.Random(4)
    for _ in range(300):
        n = pick.randint(2, 12)
        x, y = [pick.randrange(60) for _ in range(n)], [pick.randrange(60) for _ in range(n)]
        chains = chaining.chains_of(x, y)
        value = lambda c: chaining.K * len(c) - chaining.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:]))
        best = best_chain(x, y)
        if best > chaining.K:
            assert abs(value(chains[0]) - best) < 1e-9
        assert all(x[a] < x[b] and y[a] < y[b] for c in chains for a, b in zip(c, c[1:]))


def test_planted_passages_are_found(spark, odd, empty):
    pick = random.Random(9)
    word = lambda: "".join(pick.choices("abcdefghij", k=6))
    passage = [word() for _ in range(70)]
    fuzzy = [w if k not in (25, 48) else word() for k, w in enumerate(passage)]
    noise = lambda n: [word() for _ in range(n)]
    texts = [noise(100), noise(40) + passage + noise(60), noise(90), fuzzy + noise(80), noise(7) + passage, noise(20) + passage[:30] + noise(60)]
    rows = chaining.passages(table(spark, [" ".join(t) for t in texts])).collect()
    assert {(r.rep_id, r.doc_id) for r in rows} == {(1, 3), (1, 4)}
    exact = next(r for r in rows if r.doc_id == 4)
    assert (exact.rep_start, exact.rep_end, exact.start, exact.end, exact.similarity) == (40, 110, 7, 77, 1.0)
    assert chaining.passages(odd).count() == 0 and chaining.passages(empty).count() == 0
    copies = chaining.passages(table(spark, [" ".join(passage)] * 50)).collect()
    assert {(r.rep_id, r.doc_id) for r in copies} == {(0, k) for k in range(1, 50)}


# pipeline


def test_pipeline(spark, folder, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= 2 * docs.count()
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 0
    texts = dict(documents(folder))
    library = Tokenizer.from_file(BYTE_BPE)
    for row in rows.limit(20).collect():
        assert row.n_tokens == len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
