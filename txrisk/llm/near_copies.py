"""Near copies by exact Jaccard similarity of word shingles, candidates by SimHash, the rest by banded MinHash.

A text is the set of its 5-word shingles. SimHash fingerprints of these link most near copies:
texts of one fingerprint with its first text, and the first texts of fingerprints within three
bits. At similarity 0.8 two fingerprints lie about ten bits apart, so an exact way for the
others follows. Each of BANDS keys combines ROWS minima of
independent hashes, so two texts of similarity s share a key with the chance
1 - (1 - s**ROWS)**BANDS: at 0.8 three pairs in a million meet nowhere, above it fewer.
Every link is verified on the whole sets; nothing is linked by its sketch alone.

Members of a key are first compared with one leader, in rounds with other leaders, as
long as that saves comparisons: members already in one component need none. Then all
pairs that share a key and lie in different components are compared, so leaders only
save work and never lose a link. Pairs become rows only for keys of at most CROWD texts.
The texts of a crowded key are cut into blocks, the sets of two blocks meet in one task,
and only the links of a spanning forest leave it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from txrisk.llm import simhash
from txrisk.llm.common import materialize, row_slices, whole_text
from txrisk.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 24
#: Rounds with leaders end when the pairs left are at most PAIRS for each text or FEW in all, or after ROUNDS.
#: A round that leaves more than SLOW of the pairs is the last one with leaders.
PAIRS, FEW, ROUNDS, SLOW = 4, 100_000, 6, 0.8
#: Keys of more texts are crowded; a block of theirs holds about so many texts and shingles at most.
CROWD, BLOCK_TEXTS, BLOCK_SHINGLES = 64, 1024, 1 << 17
#: Shingles that are counted at a time where two blocks meet.
_COLUMNS = 2048
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PICK = np.random.default_rng(42)
_FACTORS = _PICK.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_ADDED = _PICK.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _MULTIPLIER
    return values ^ (values >> np.uint64(32))


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter((xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(hashes) - width + 1
    found = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        found = found * _MULTIPLIER + hashes[k : k + n]
    return np.unique(_mixed(found))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 1024):  # blocks that stay in the processor's cache
        part = found[start : start + 1024]
        for k in range(ROWS * BANDS):
            least[k] = min(least[k], _high(part, k))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = _mixed(keys * _MULTIPLIER + least[row::ROWS])
    return keys


def _high(part: np.ndarray, k: int) -> np.uint64:
    values = part * _FACTORS[k] + _ADDED[k]
    return (values ^ (values >> np.uint64(31))).min()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, keys, fp): node names the text, size counts its shingles, fp is its SimHash."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 128):
            sizes, keys, prints = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                keys.append(band_keys(found).view(np.int64))
                prints.append(simhash.fingerprint(text, SHINGLE))
            columns = [batch.column("doc_id"), batch.column("node"), pa.array(sizes, pa.int64())]
            columns.append(pa.array(keys, pa.list_(pa.int64())))
            columns.append(pa.array(np.array(prints, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "keys", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_named())
    return rows.mapInArrow(compute, "doc_id long, node long, size long, keys array<long>, fp long")


def _named():
    return F.xxhash64(whole_text()).alias("node"), whole_text().alias("text")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words): the shingles of each wanted text, once."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 128):
            found = [shingles(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "words"])

    texts = docs.select(*_named()).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return texts.mapInArrow(compute, "node long, words binary")


def _fingerprint_pairs(nodes: DataFrame, near) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are equal or within three bits, enough to join all of them."""
    first = nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first"))
    first = materialize(first.select("fp", "first.node", "first.size"), "fingerprint-firsts")
    others = first.select("fp", F.col("node").alias("other"), F.col("size").alias("other_size"))
    linked = simhash.links(first.select("fp"))
    close = first.join(linked.select(F.col("a").alias("fp"), "b"), "fp").join(others.withColumnRenamed("fp", "b"), "b")
    columns = ("node", "size", "other", "other_size")
    met = nodes.join(others, "fp").select(*columns).union(close.select(*columns)).where(near)
    pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return materialize(pairs, "fingerprint-pairs")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles are alike enough."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            sides = [[np.frombuffer(w, dtype=np.uint64) for w in batch.column(s).to_pylist()] for s in ("of_a", "of_b")]
            alike = pa.array([jaccard(x, y) >= similarity for x, y in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(alike)

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("words").alias("of_a")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("words").alias("of_b")), "b")
    return materialize(both.select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long"), "near-links")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right."""
    sides = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(found) for found in sets])
        sides.append((row, np.concatenate([*sets, np.empty(0, dtype=np.uint64)])))
    common = np.intersect1d(sides[0][1], sides[1][1])
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    places = [(row, np.searchsorted(common, found), found) for row, found in sides]
    for low in range(0, len(common), _COLUMNS):
        part = []
        for (row, place, found), n in zip(places, counts.shape):
            here = np.flatnonzero((place >= low) & (place < min(low + _COLUMNS, len(common))))
            here = here[common[place[here]] == found[here]]
            held = np.zeros((n, _COLUMNS), dtype=np.float32)
            held[row[here], place[here] - low] = 1
            part.append(held)
        counts += part[0] @ part[1].T
    return counts


def _forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of links between places those that join what the ones before left apart."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        of_a, of_b = top(a), top(b)
        if of_a != of_b:
            parent[of_b] = of_a
            kept.append((a, b))
    return kept


def _crowded_links(members: DataFrame, crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts of different roots that share a crowded key, enough to join all that are alike.

    ``members`` holds (node, root, key), ``crowded`` (key, blocks).
    """

    def compare(table: pa.Table) -> pa.Table:
        node, root, block = (table.column(name).to_numpy() for name in ("node", "root", "block"))
        found = [np.frombuffer(w, dtype=np.uint64) for w in table.column("words").to_pylist()]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        size = np.array([len(f) for f in found], dtype=np.float64)
        both = shared_counts([found[k] for k in left], [found[k] for k in right])

        def alike() -> Iterator[tuple[int, int]]:
            for i, k in enumerate(left.tolist()):
                union = size[k] + size[right] - both[i]
                good = np.divide(both[i], union, out=np.ones(len(right)), where=union > 0) >= similarity
                for m in right[good & (root[right] != root[k])].tolist():
                    yield k, m

        kept = np.array(_forest(alike()), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[kept].min(axis=1)), "b": pa.array(node[kept].max(axis=1))})

    dealt = members.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), "blocks"))
    dealt = dealt.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "words")
    links = met.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")
    return materialize(links.distinct(), "crowded-links")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, few: int = FEW) -> DataFrame:
    """(doc_id, component_id): the component is named by its smallest doc_id.

    Null, empty and blank texts are alike; rows with a null doc_id count as larger than
    all others. Repeated rows come back as often.
    """
    return near_texts(docs, similarity, few).select("doc_id", "component_id")


def near_texts(docs: DataFrame, similarity: float = SIMILARITY, few: int = FEW) -> DataFrame:
    """The same with ``node``, the name of the row's text."""
    rows = materialize(sketches(docs), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    nodes = materialize(nodes, "sketch-nodes")
    dealt = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = materialize(dealt.join(shared, "key"), "sketch-members")
    near = (F.least("size", "other_size") >= F.lit(similarity - 1e-9) * F.greatest("size", "other_size")) & (F.col("node") != F.col("other"))
    ordered = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    done = _fingerprint_pairs(nodes, near)
    met = members.select("node").union(done.select("a")).union(done.select("b")).distinct()
    sets = materialize(_sets(docs, met), "shingle-sets")
    found, before = _verified(done, sets, similarity), None
    limit = max(few, PAIRS * nodes.count())
    for turn in range(ROUNDS + 1):
        roots = components(found)
        placed = members.join(roots, "node", "left").select("node", "size", "key", F.coalesce("root", "node").alias("root"))
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        sums = (F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum(F.col("n") * F.col("n")).alias("same"))
        keys = parts.groupBy("key").agg(*sums)
        open_keys = materialize(keys.where("n * n > same"), "open-keys")
        left = open_keys.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0
        if not left:
            break
        rest = placed.join(open_keys.select("key"), "key")
        last = left <= limit or turn == ROUNDS or (before is not None and left > SLOW * before)
        before = left
        if last:
            blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("size") / BLOCK_SHINGLES)).alias("blocks")
            crowded = _crowded_links(
                rest.select("node", "root", "key"), open_keys.where(F.col("n") > CROWD).select("key", blocks), sets, similarity
            )
            rest = rest.join(open_keys.where(F.col("n") <= CROWD).select("key"), "key", "left_semi")
            others = rest.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("root").alias("other_root"))
            pairs = rest.join(others, "key").where(F.col("node") < F.col("other"))
        else:
            leader = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "size", "root")).alias("leader")
            leaders = rest.groupBy("key").agg(leader).select(
                "key", F.col("leader.node").alias("other"), F.col("leader.size").alias("other_size"), F.col("leader.root").alias("other_root")
            )
            pairs = rest.join(leaders, "key")
        pairs = pairs.where(near & (F.col("root") != F.col("other_root"))).select(*ordered).distinct()
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "near-pairs")
        links = _verified(pairs, sets, similarity)
        if last:
            links = links.union(crowded)
        found, done = found.union(links), done.union(pairs)
        if last:
            break
    named = components(found).join(nodes.select("node", "least"), "node")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(smallest, "root").select("node", "component")
    whole = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "least").alias("component_id"))
    return rows.join(materialize(whole, "near-labels"), "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents whose doc_id names their component, all columns as they came.

    Where a doc_id names several texts, those of the component that it names stay. Rows
    with a null doc_id stay only where no document of their group has an id.
    """
    found = near_texts(docs, similarity)
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "node").distinct()
    kept = chosen.select(F.col("doc_id").alias("__kept"), F.col("node").alias("__node"))
    named = F.xxhash64(whole_text()) == F.col("__node")
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")) & named, "left_semi")
