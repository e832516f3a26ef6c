"""Packing, ranked search and whitening against brute force and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from txrisk.llm import contour_eigen, packing, ranked_search, whitening
from txrisk.llm.common import ship_package
from txrisk.llm.queries import QUERIES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, start long, ids string, sequence_id int, shard int, term string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, rows):
    return spark.createDataFrame([(doc, text, "en", "s", 0, 1, "i", 2, 3, "t") for doc, text in rows], COLUMNS)


@pytest.fixture(scope="module")
def odd_rows():
    long_text = " ".join(f"w{k % 977}" for k in range(30_000)) + " " + "x" * 5_000
    texts = [None, "", " \t\n", long_text, "A b c", "a B c", "ünï cødé 🙂 İ Σ", "stop <|endoftext|> here"]
    return [*enumerate(texts), (7, "same row"), (7, "same row"), (None, "no id"), (None, None)]


# packing


def library():
    coder = Tokenizer.from_file(BYTE_BPE)
    coder.no_truncation()
    coder.no_padding()
    return coder


def check_pieces(rows, documents, window=1024, id_of_end=0):
    """Every id of every document lies in one piece; sequences have no gaps; little is padded."""
    coder, pieces, sequences = library(), defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    texts = defaultdict(list)
    for doc, text in documents:
        texts[doc].append([*coder.encode(text or "", add_special_tokens=False).ids, id_of_end])
    assert set(pieces) == set(texts)
    for doc, encoded in texts.items():
        if len(encoded) > 1 and any(ids != encoded[0] for ids in encoded):
            assert sum(p.length for p in pieces[doc]) == sum(map(len, encoded))
            continue
        ids = encoded[0]
        by_start = defaultdict(list)
        for piece in pieces[doc]:
            assert piece.doc_tokens == len(ids)
            part = np.array(ids[piece.start : piece.start + piece.length], dtype="<u4").tobytes()
            assert piece.ids_crc32 == zlib.crc32(part)
            by_start[piece.start].append(piece.length)
        covered = sorted(k for start, lengths in by_start.items() for n in lengths for k in range(start, start + n))
        assert covered == sorted(list(range(len(ids))) * len(encoded))
    short = []
    for some in sequences.values():
        at = 0
        for piece in sorted(some, key=lambda p: p.offset):
            assert piece.offset == at and piece.length > 0
            at += piece.length
        assert at <= window
        if at < window:
            short.append(at)
    return short


def test_best_fill_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, count in counts.items():
            sums = {s + k * length for s in sums for k in range(count + 1)}
        taken = packing.best_fill([counts.get(n, 0) for n in range(64)], room)
        assert all(used <= counts[length] for length, used in taken)
        assert sum(length * used for length, used in taken) == max(s for s in sums if s <= room)


def test_rank_codec_equals_library():
    coder, mine, rng = library(), packing.RankCodec(BYTE_BPE), random.Random(5)
    letters = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "1", "23", "é", "中", "🙂", "\x1c", "\xa0", "-", "<|endoftext|>", "Z" * 450, "q" * 60_000, " " * 60_000, "_"]
    texts = ["".join(rng.choices(letters, [20] * (len(letters) - 3) + [1, 1, 20], k=rng.randint(0, 40))) for _ in range(400)]
    for text, packed in zip(texts, mine.encode_packed(texts)):
        assert np.frombuffer(packed, "<i4").tolist() == coder.encode(text, add_special_tokens=False).ids


def test_packing_of_the_whole_table(spark, folder):
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    rows = QUERIES["op11_packing"](spark, folder).collect()
    assert len(check_pieces(rows, documents)) <= 1
    cut = sum(1 for r in rows) - sum(-(-len(library().encode(t or "").ids + [0]) // 1024) for _, t in documents)
    assert cut <= 0.2 * len(rows)


def test_packing_odd_rows(spark, odd_rows):
    docs = table(spark, odd_rows).repartition(5)
    assert len(check_pieces(packing.pack_documents(docs, BYTE_BPE, 0).collect(), odd_rows)) <= 1
    assert packing.pack_documents(docs.where("false"), BYTE_BPE, 0).count() == 0


def test_packing_of_many_equal_lengths(spark):
    documents = [(k, "word " * 699) for k in range(300)]  # no two fit one window
    rows = packing.pack_documents(table(spark, documents).repartition(3), BYTE_BPE, 0).collect()
    assert len(check_pieces(rows, documents)) <= 1


def test_packing_in_blocks_keeps_every_id(spark, monkeypatch):
    packer = packing.Packer(0, window=64)
    rng, total = random.Random(1), 0
    for doc in range(500):
        size = rng.randint(1, 200)
        total += size
        packer.add(doc, np.arange(size, dtype="<i4").tobytes())
        if packer.held >= 2000:
            packer.pack(300)
    packer.pack(0)
    assert packer.held == total % 64
    packer.close()
    assert sum(row[2] for row in packer.rows) == total


# whitening


def brute_whitening(rows, k=8):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in good])
    n, mean = len(x), x.sum(axis=0) / len(x)
    covariance = (x - mean).T @ (x - mean) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return [i for i, _ in good], deviation, (x - mean) @ vectors / np.sqrt(values), values / np.trace(covariance)


def check_whitening(found, rows, tolerance=1e-8):
    ids, deviation, whitened, explained = brute_whitening(rows)
    n, k = whitened.shape
    assert len(found) == n * k and {r.n for r in found} == {n}
    got = {(r.vec_id, r.component): r for r in found}
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ whitened[:, c])
        assert np.abs(mine - sign * whitened[:, c]).max() < tolerance
        assert all(abs(got[i, c + 1].explained / explained[c] - 1) < 1e-9 for i in ids)
    assert [got[i, 1].deviation for i in ids] == deviation
    (error,) = {r.identity_error for r in found}
    assert 0 <= error < 1e-9


def test_whitening_of_the_whole_table(spark, folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    check_whitening(QUERIES["op13_whitening"](spark, folder).collect(), rows)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, component int, n string, value double"
    return spark.createDataFrame([(i, v, 0, 5, "n", 1.0) for i, v in rows], schema)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]]) for k in range(40)]
    rows += [(40, None), (41, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (42, [float("nan")] * 6), (43, [float("inf")] + [0.0] * 5)]
    rows += [(44, [0.5, 0.25]), (45, [])]
    frame = vectors(spark, rows)
    check_whitening(whitening.whiten(frame, whitening.fit(frame)).collect(), rows)
    repeated = vectors(spark, [(7, rows[0][1]), (7, rows[1][1]), (None, rows[2][1]), (None, rows[2][1])])
    assert whitening.whiten(repeated, whitening.fit(repeated)).count() == 4 * 2
    for few in ([], rows[:1], [(1, rows[0][1])] * 5, [(1, [])]):
        frame = vectors(spark, few)
        assert whitening.whiten(frame, whitening.fit(frame)).count() == 0
    large = vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 7.0])])
    assert None in {r.deviation for r in whitening.whiten(large, whitening.fit(large)).collect()}


@pytest.mark.parametrize("kind", ["random", "decay", "ties", "rank", "equal", "close"])
@pytest.mark.parametrize("d", [1, 3, 20, 64])
def test_contour_equals_dense_solver(kind, d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {
        "random": rng.random(d) * 10,
        "decay": 3.0 ** -np.arange(d),
        "ties": np.repeat([5.0, 2.0, 1.0, 0.5], d)[: 4 * d : 4],
        "rank": np.where(np.arange(d) < 3, 4.0, 0.0),
        "equal": np.full(d, 3.0),
        "close": 1 - 1e-6 * np.arange(d),
    }[kind]
    matrix = q @ np.diag(values) @ q.T
    found, columns = contour_eigen.largest_eigenpairs(matrix, 8)
    assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-12 * max(1, values.max())
    assert np.abs(matrix @ columns - columns * found).max() < 1e-12 * max(1, values.max())
    assert np.abs(columns.T @ columns - np.eye(len(found))).max() < 1e-12
    diagonal, side = contour_eigen.tridiagonal((matrix + matrix.T) / 2)
    shifts = np.array([-1.0, 0.3, 1.7, 11.0])
    assert contour_eigen.below(diagonal, side, shifts).tolist() == [int((values < s).sum()) for s in shifts]


# ranked search


def brute_search(documents, items, k=10):
    """Every document scored for every item, straight from the definition."""
    terms = [(doc, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))) for doc, text in documents]
    terms = [(doc, found) for doc, found in terms if found]
    n_docs, n_terms = len(terms), sum(len(found) for _, found in terms)
    df = Counter(term for _, found in terms for term in set(found))
    rows = []
    for item, text in items:
        query = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
        scored = []
        for doc, found in terms:
            tf, m = Counter(found), 25 + 75 * len(found) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (10**9 * tf[term] // (1000 * tf[term] + 8 * m))
                for term in query
                if tf[term]
            )
            if score:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        rows += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scored[:k], 1)]
    return rows


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found_rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "item_id long, text string, rank int, score double")


@pytest.mark.parametrize("shard,block,stretch", [(8192, 128, 2048), (37, 4, 10)])
def test_search_equals_brute_force(spark, monkeypatch, shard, block, stretch):
    rng = random.Random(shard)
    words = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(5000)] + ["Äpfel", "中文", "x_y"]
    documents = [(k, " ".join(rng.choices(words, k=int(rng.paretovariate(0.8)) + 3))) for k in range(400)]
    documents += [(k + 1000, documents[k][1]) for k in range(60)]  # ties
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(25)]
    monkeypatch.setattr(ranked_search, "STRETCH", stretch)
    monkeypatch.setattr(ranked_search, "QUERY_ITEMS", 10)
    writer, shards = None, []
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    for k, (doc, text) in enumerate(rng.sample(documents, len(documents))):
        if writer is None or len(writer.docs) >= shard:
            writer = ranked_search.ShardWriter()
            shards.append(writer)
        writer.add(doc, text.encode())
    n_docs, n_terms = sum(len(s.docs) for s in shards), sum(sum(s.lengths) for s in shards)
    df = Counter(term.decode() for _, text in documents for term in set(ranked_search.terms_of(text.encode())))
    mine = []
    tables = [[r for b in s.rows(0) for r in b.to_pylist()] for s in shards]
    for item, text in items:
        merged = []
        for rows in tables:
            listed = rows[-1]
            norms = ranked_search.length_norms(np.array(listed["lengths"]), n_docs, n_terms)
            lists = {r["term"]: ranked_search.PostingList(r, norms, n_docs, n_terms) for r in rows[:-1]}
            query = Counter(t.decode() for t in ranked_search.terms_of(text.encode()))
            present = [(lists[t], q * ranked_search.weight(n_docs, df[t])) for t, q in query.items() if t in lists]
            docs, scores = ranked_search.search_shard(present, len(norms), 10)
            merged += [(-s, listed["doc_ids"][d]) for d, s in zip(docs.tolist(), scores.tolist())]
        mine += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(merged)[:10], 1)]
    assert sorted(mine) == sorted(brute_search(documents, items))
    index = ranked_search.build_index(table(spark, documents).repartition(4))
    assert found_rows(ranked_search.search(index, items_table(spark, items))) == sorted(brute_search(documents, items), key=repr)


def test_search_odd_rows(spark, odd_rows):
    items = [(0, "a b c same row"), (1, None), (2, ""), (3, "--"), (4, "CØDÉ cødé İ w5 W5"), (None, "no id"), (0, "a b c same row"), (5, "nowhere")]
    docs, asked = table(spark, odd_rows), items_table(spark, items)
    index = ranked_search.build_index(docs)
    assert found_rows(ranked_search.search(index, asked)) == sorted(brute_search(odd_rows, items), key=repr)
    assert ranked_search.search(ranked_search.build_index(docs.where("false")), asked).count() == 0
    assert ranked_search.search(index, asked.where("false")).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(1)
    values = (2.0 ** (rng.random(2000) * 31)).astype(np.int64) - 1
    packed, ends = ranked_search.pack_numbers(values)
    assert ranked_search.unpack_numbers(packed).tolist() == values.tolist()
    assert len(packed) == ends[-1]
