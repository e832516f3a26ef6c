"""Cases that a cut, a sample or a loose filter would lose, against brute force or planted truth."""

import glob
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from txrisk.llm import bpe_codec, chaining, cross_entropy, curriculum, near_copies, pii_crf, toxicity
from txrisk.llm.common import ship_package
from txrisk.llm.queries import QUERIES


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, texts):
    rows = [(t if isinstance(t, tuple) else (k, t)) + ("s",) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def words(pick, n, size=6):
    return ["".join(pick.choices("abcdefghij", k=size)) for _ in range(n)]


def shingle_set(text):
    told = text.lower().split()
    return {tuple(told[k : k + 5]) for k in range(max(1, len(told) - 4))} if told else set()


def test_near_copies_with_changed_words_go(spark, folder):
    """Groups around one text with up to 7 % of words changed, and texts less alike, against all pairs."""
    pick = random.Random(11)
    texts = []
    for size in (60, 200, 700):
        base = words(pick, size)
        for copy in range(14):
            changed = list(base)
            for at in pick.sample(range(size), size * (copy % 8) // 100):
                changed[at] = words(pick, 1)[0]
            texts.append(" ".join(changed))
    texts += ["", None, " ", "One two", "one TWO", *(" ".join(words(pick, 80)) for _ in range(20))]
    sets = [shingle_set(t or "") for t in texts]
    label = list(range(len(texts)))
    alike = lambda a, b: (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if own == high else own for own in label]
    docs = table(spark, texts)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert found == dict(enumerate(label))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, folder).collect()) == sorted(set(label))


def test_shared_counts_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(near_copies, "_COLUMNS", 16)
    pick = np.random.default_rng(3)
    some = lambda n: [np.unique(pick.integers(0, 200, pick.integers(0, 90))).astype(np.uint64) for _ in range(n)]
    left, right = [*some(9), np.empty(0, dtype=np.uint64)], some(7)
    expected = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert near_copies.shared_counts(left, right).tolist() == expected
    assert near_copies.shared_counts(left[-1:], left[-1:]).tolist() == [[0]]
    assert near_copies.shared_counts([], right).shape == (0, 7)


@pytest.mark.parametrize("rounds", [0, 6])
def test_crowded_keys_in_blocks_lose_no_link(spark, monkeypatch, rounds):
    """A hundred texts around one, few alike enough, in blocks of a few texts, against all pairs."""
    for name, value in {"CROWD": 3, "BLOCK_TEXTS": 9, "PAIRS": 0, "ROUNDS": rounds}.items():
        monkeypatch.setattr(near_copies, name, value)
    pick = random.Random(5)
    base, texts = words(pick, 120), []
    for copy in range(100):
        changed = list(base)
        for at in pick.sample(range(120), copy % 6):
            changed[at] = words(pick, 1)[0]
        texts.append(" ".join(changed) + (" tail" * (copy % 3)))
    texts += ["", " ", "\n", None, *(" ".join(words(pick, 40)) for _ in range(9))]
    sets = [shingle_set(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sets[i] | sets[j]
            if (len(sets[i] & sets[j]) / len(both) if both else 1.0) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if own == high else own for own in label]
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(table(spark, texts), few=0).collect()}
    assert found == dict(enumerate(label))


def test_every_character_of_a_long_word_is_in_a_window():
    text = "".join(chr(0x4E00 + k) for k in range(3000))
    told = b"".join(toxicity.windows(text)).decode()
    assert all(text[k : k + 16] in told for k in range(2985))
    assert list(toxicity.windows("a b " * 3)) == [b" a b a b a b "]


def test_toxic_wording_inside_a_long_word_counts(spark):
    pick = random.Random(1)
    texts, toxic = [], []
    for k in range(400):
        told = words(pick, 80)
        toxic.append(int(k % 8 == 0))
        for _ in range(3 * toxic[-1]):
            told.insert(pick.randrange(80), pick.choice(["worthlesstrash", "patheticfools", "disgustinglout"]))
        texts.append(" ".join(told))
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, texts), labels)
    joined = ["_".join(words(pick, 20) + more + words(pick, 20)) for more in ([], ["worthlesstrash", "patheticfools", "disgustinglout"])]
    assert toxicity.saved_bytes(model, joined[1]).max() > toxicity.saved_bytes(model, joined[0]).max()


def test_spans_across_the_cuts_of_a_long_line(spark):
    """A number is found wherever it stands in a long line, and a mark behind 48 characters counts."""
    pick = random.Random(2)
    word = lambda: "".join(pick.choices(["the", "ion", "er", "an", "st"], k=2))
    made = lambda: "+1 (784) 555-%d" % pick.randrange(1000, 9999)
    train = [" ".join([*[word() for _ in range(9)], made(), *[word() for _ in range(9)]]) for _ in range(300)]
    train += [" ".join(word() for _ in range(20)) for _ in range(300)]
    tagger = pii_crf.Tagger(pii_crf.fit(table(spark, train)))
    texts = [" ".join([*[word() for _ in range(k)], "(784) 555-8120", *[word() for _ in range(400 - k)]]) for k in range(400)]
    for text, (_, spans) in zip(texts, pii_crf.all_spans(texts, tagger)):
        at = text.index("(784)")
        assert spans == [("phone", at, at + 14)]
    lines = [text.split() for text in texts[::40]]
    whole, pii_crf.CHAIN = tagger.decode(lines), 10**6
    try:
        assert all(np.array_equal(a, b) for a, b in zip(whole, tagger.decode(lines)))
    finally:
        pii_crf.CHAIN = 192
    assert "@" in pii_crf.shape("x1" * 40 + "@" + "site.example")


def test_passage_of_frequent_phrases_is_found(spark):
    """Each 6 words of a passage of two documents also stand alone in a smaller document of their own."""
    pick = random.Random(5)
    passage = words(pick, 60)
    owners = [words(pick, 40) + passage[k : k + 6] + words(pick, 40) for k in range(0, 55, 1)]
    texts = owners + [words(pick, 30) + passage + words(pick, 30), words(pick, 50) + passage + words(pick, 10)]
    rows = chaining.passages(table(spark, [" ".join(t) for t in texts])).collect()
    assert {(r.rep_id, r.doc_id) for r in rows} == {(55, 56)}
    assert [(r.rep_start, r.rep_end, r.start, r.end) for r in rows] == [(30, 90, 50, 110)]


def test_fuzzy_passages_are_found_at_every_similarity(spark):
    """Substitutions at random places and at every fifth word; the pair itself is the brute force."""
    pick = random.Random(6)
    texts, wanted = [], []
    for size in (50, 60, 80, 100):
        for changed in (0.05, 0.1, 0.15, 0.18):
            for _ in range(5):
                passage = words(pick, size)
                other = list(passage)
                for at in pick.sample(range(2, size - 2), int(size * changed)):
                    other[at] = words(pick, 1)[0]
                wanted.append((len(texts), len(texts) + 1))
                texts += [words(pick, 40) + passage + words(pick, 40), words(pick, 20) + other + words(pick, 60)]
    passage = words(pick, 100)
    wanted.append((len(texts), len(texts) + 1))
    texts += [passage, [w if k % 5 != 2 else words(pick, 1)[0] for k, w in enumerate(passage)]]
    rows = chaining.passages(table(spark, [" ".join(t) for t in texts])).collect()
    found = {(r.rep_id, r.doc_id) for r in rows}
    assert found <= set(wanted)
    missed = [pair for pair in wanted if pair not in found]
    assert not missed, (len(missed), len(wanted))


def test_models_count_all_good_text_and_every_symbol(spark):
    """Losses against counts in plain Python, over more symbols than a fixed table would hold."""
    pick = random.Random(8)
    letters = [chr(0x4E00 + k) for k in range(150)] + list("abcdef ")
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 60))) for _ in range(60)]
    good = set(range(0, 60, 3))
    labels = spark.createDataFrame([(k, int(k in good), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = cross_entropy.fit(table(spark, texts), labels)
    unseen = (60, "zzzz" + texts[1])
    found = {r.doc_id: r for r in cross_entropy.score_documents(table(spark, [*texts, unseen]), model).collect()}
    n_symbols = len(set("".join(texts))) + 1
    for side, chosen in (("background_loss", range(60)), ("target_loss", good)):
        counts = {}
        for k in chosen:
            padded = "\0\0\0" + texts[k]
            for at in range(3, len(padded)):
                for order in range(4):
                    context = padded[at - order : at]
                    counts[context, padded[at]] = counts.get((context, padded[at]), 0) + 1
                    counts[context] = counts.get(context, 0) + 1

        def chance(context, last):
            shorter = chance(context[1:], last) if context else 1 / n_symbols
            return (counts.get((context, last), 0) + 8 * shorter) / (counts.get(context, 0) + 8)

        for k, text in [*enumerate(texts), unseen]:
            padded = "\0\0\0" + text
            losses = [-np.log(chance(padded[at - 3 : at], padded[at])) for at in range(3, len(padded))]
            assert abs(found[k][side] - (np.mean(losses) if losses else 0)) < 1e-4
            assert found[k].n_symbols == len(text)


def test_all_good_documents_are_in_the_target(spark):
    labels = spark.range(25_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert cross_entropy.target_ids(labels).count() == 25_000


def test_labelled_stretches_are_bounded_and_plain_ones_lie_anywhere(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii_crf, "train", seen.append)
    long = " ".join(f"10.0.{k // 250}.{k % 250} and" for k in range(3000))
    plain = [" ".join(f"w{k}" for k in range(j, 200 + j)) for j in range(20)]
    docs = table(spark, [long, *plain])
    pii_crf.fit(docs, n_rows=500)
    assert len(seen[0]) == 500
    starts = {row.tokens[0] for row in pii_crf.labelled_table(docs.where("doc_id > 0")).collect()}
    assert len(starts - {f"w{j}" for j in range(20)}) > 10


def test_repeated_rows_keep_their_own_copies(spark):
    """Repeated rows of one doc_id and text, in one source and in several, give the copies that assign computed."""
    texts = [(k % 5, "a b c d") for k in range(40)] + [(9, "x y"), (None, "q r s"), (None, "q r s")]
    rows = [(*t, "uvw"[k % 3] if k % 4 else "u") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = {}
    for r in curriculum.assign(docs, keep=("text",)).collect():
        key = (r.doc_id, r.text, r.source)
        wanted[key] = wanted.get(key, 0) + len(r.positions)
    found = {}
    for r in curriculum.training_order(docs).collect():
        found[tuple(r)] = found.get(tuple(r), 0) + 1
    assert found == {key: n for key, n in wanted.items() if n}


def test_words_taken_are_read_off_the_ordered_mix(spark, folder, monkeypatch):
    """The mixing query makes the mix itself, in the order of positions, and counts its copies."""
    from txrisk.llm import queries

    made = []
    mix = curriculum.mix
    monkeypatch.setattr(curriculum, "mix", lambda assigned: made.append(mix(assigned)) or made[-1])
    rows = {r.doc_id: r for r in queries.QUERIES["op9_curriculum"](spark, folder).collect()}
    order = [r.position for r in made[0].collect()]
    assert len(order) > 100 and order == sorted(order)
    expected = {r.doc_id: r for r in curriculum.assign(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert {k: r.taken for k, r in rows.items()} == {k: r.taken for k, r in expected.items()}
    assert sum(r.taken for r in rows.values()) == made[0].agg({"size": "sum"}).first()[0]


def test_rows_with_one_id_and_rows_without_words_keep_their_own_copies(spark):
    rows = [(k % 3 or None, t, s) for s in ("u", None) for k, t in enumerate(["a b", "a b", "", None, "c d e", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assigned = curriculum.assign(docs)
    kept = lambda df: sorted((repr((r.doc_id, r.source, r.size, r.taken)) for r in df.collect()))
    assert kept(curriculum.taken_by(assigned, curriculum.mix(assigned))) == kept(assigned)


def test_near_copies_are_linked_by_their_fingerprints(spark, monkeypatch):
    """Texts within three bits meet by SimHash, whatever the bands give; each link is still verified."""
    from txrisk.llm import simhash

    words = [f"w{k * k % 977}" for k in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "changed"]), " ".join(f"v{k}" for k in range(300))]
    prints = [simhash.fingerprint(text, near_copies.SHINGLE) for text in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    bands = lambda found: found.sum() + np.arange(near_copies.BANDS, dtype=np.uint64)
    monkeypatch.setattr(near_copies, "band_keys", bands)
    members = near_copies.near_copies(table(spark, texts)).collect()
    assert [r.component_id for r in sorted(members)] == [0, 0, 2]


def test_codec_goes_through_one_worker_and_forgets_long_words(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, ["the same words, the same ids", "", "x" * 500 + " <|endoftext|> \u00e9\u4e2d" + "y" * 200, None])
    lexicon = bpe_codec.build_lexicon(docs, path)
    both = bpe_codec.encode_and_decode(docs, path, lexicon)
    apart = bpe_codec.decode_documents(bpe_codec.encode_documents(docs, path, lexicon), path)
    assert sorted(both.collect()) == sorted(apart.collect())
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert plan(both).count("MapInArrow") == 1
    assert plan(QUERIES["op2_bpe_codec"](spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1
    coder, library = bpe_codec.Codec(bpe_codec.Vocabulary(path)), Tokenizer.from_file(path)
    texts = ["z" * 1000 + " short", "q" * 65]
    assert coder.encode_many(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(coder.words) == {" short"}


def test_each_meets_each_where_other_documents_lie_between(spark):
    """Parts of a passage of two documents stand in a document before and in five between them."""
    pick = random.Random(12)
    passage = words(pick, 56)
    part = lambda k: words(pick, 30) + passage[k : k + 26] + words(pick, 30)
    before = [part(k) for k in (0, 8, 16, 24, 30)]
    between = [part(k) for k in (0, 8, 16, 24, 30) for _ in range(5)]
    with_it = words(pick, 30) + passage + words(pick, 30)
    texts = [*before, with_it, *between, words(pick, 9) + passage + words(pick, 50)]
    rows = chaining.passages(table(spark, [" ".join(t) for t in texts])).collect()
    assert {(r.rep_id, r.doc_id) for r in rows} == {(len(before), len(texts) - 1)}
    assert [(r.rep_start, r.rep_end, r.start, r.end) for r in rows] == [(30, 86, 9, 65)]


def test_each_meets_each_where_all_seeds_are_crowded(spark):
    """As before, and each part stands in more than SHARED documents before the two."""
    pick = random.Random(15)
    passage = words(pick, 56)
    part = lambda k: words(pick, 30) + passage[k : k + 26] + words(pick, 30)
    before = [part(k) for k in (0, 8, 16, 24, 30) for _ in range(chaining.SHARED + 2)]
    between = [part(k) for k in (0, 8, 16, 24, 30) for _ in range(6)]
    texts = [*before, words(pick, 30) + passage + words(pick, 30), *between, words(pick, 9) + passage + words(pick, 50)]
    rows = chaining.passages(table(spark, [" ".join(t) for t in texts])).collect()
    assert {(r.rep_id, r.doc_id) for r in rows} == {(len(before), len(texts) - 1)}
    assert [(r.rep_start, r.rep_end, r.start, r.end) for r in rows] == [(30, 86, 9, 65)]


def test_every_place_of_a_seed_meets_every_place_in_other_documents():
    pick = random.Random(16)
    rows = sorted((s, d, a) for s in range(3) for d in range(6) for a in pick.sample(range(400), pick.choice((0, 1, 40, 150))))
    seed, doc, at = (np.array(c, kind) for c, kind in zip(zip(*rows), ("<u4", "<i8", "<i4")))
    wanted = sorted((d, e, a, b) for k, (s, d, a) in enumerate(rows) for t, e, b in rows[k + 1 :] if s == t and d != e)
    found = [(doc[a], doc[b], at[a], at[b]) for a, b in chaining._ties(seed, doc)]
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found)))) == wanted
    found = []
    for pairs, (side, d, places) in chaining._blocks(seed, doc, at):
        a, b = chaining._meet(side, d)
        assert len(a) <= pairs and len(d) <= 2 * chaining.BLOCK
        found.append((d[a], d[b], places[a], places[b]))
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found)))) == wanted


def test_copies_are_tied_to_the_first_and_crowded_seeds_count(spark):
    pick = random.Random(13)
    passage = words(pick, 60)
    whole = " ".join(words(pick, 20) + passage + words(pick, 20))
    # More documents than SHARED hold the passage, in texts of their own.
    own = [" ".join(words(pick, 25) + passage + words(pick, 25)) for _ in range(chaining.SHARED + 8)]
    texts = [whole, *own, whole.upper(), whole + " "]
    rows = chaining.passages(table(spark, texts)).collect()
    assert {r.doc_id for r in rows if r.rep_id == 0} == set(range(1, len(texts)))
    copies = [(r.rep_start, r.rep_end, r.start, r.end, r.similarity) for r in rows if r.doc_id > len(own)]
    assert copies == [(0, 100, 0, 100, 1.0)] * 2


def test_passages_leave_no_shuffled_files(spark):
    """Each step of the chaining job is written; what it shuffled does not add up on the disks."""
    pick = random.Random(14)
    passage = words(pick, 60)
    docs = table(spark, [" ".join(words(pick, 30) + passage + words(pick, 30)) for _ in range(6)])
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = chaining.passages(docs)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert found.count() == found.count() == 5


def test_extensions_and_bounds_equal_brute_force():
    """Passages grow to where equal words less three for each other word are most; no chain that can
    become a passage is left out before it is aligned."""
    pick = random.Random(15)
    for _ in range(60):
        texts = [tuple(np.array([pick.randrange(3) for _ in range(pick.randint(20, 150))], dtype=np.uint32) for _ in "ab") for _ in range(3)]
        matches = sorted((p, pick.randrange(len(a) - chaining.K), pick.randrange(len(b) - chaining.K)) for p, (a, b) in enumerate(texts) for _ in range(8))
        pair, x, y = (np.array(column) for column in zip(*matches))
        around = chaining._around(texts, pair, x, y)
        starts = np.arange(len(pair))
        counts = []
        for k, (p, at, to) in enumerate(matches):
            a, b = texts[p]
            n = min(at, to)
            sides = [a[at - n : at][::-1] == b[to - n : to][::-1]]
            at, to = at + chaining.K, to + chaining.K
            n = min(len(a) - at, len(b) - to)
            sides.append(a[at : at + n] == b[to : to + n])
            plain, most = [], chaining.K
            for side in sides:
                worth = np.cumsum(np.append(0, np.where(side, 1, -chaining.MISMATCH)))
                end = int(worth.argmax())
                plain += [end, int(side[:end].sum())]
                most += int(side[: end + chaining.EXTEND].sum())
            assert around[1:5, k].tolist() == plain
            counts.append(most)
        for least in (5, 20, 40):
            assert chaining.hopeful(around, x, y, starts, least)[0].tolist() == [n >= least for n in counts]
