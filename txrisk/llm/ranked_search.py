"""Ranked lexical search: a sharded inverted index in blocks, searched by Block-Max MaxScore.

``build_index`` turns each partition of documents into shards of bounded size. A shard has
one row per term with its postings in compressed blocks, and for each block the last
document, the largest term count and the shortest document length, from which an upper
bound of the block's scores follows whatever the corpus statistics turn out to be. One
more row, of the empty term, holds the shard's documents and their lengths.

``search`` takes queries in blocks of bounded size. Only the rows of their terms are read
and brought together by shard. In a shard, the lists of a query are ordered by their
global bounds: those whose bounds together cannot reach the threshold are non-essential.
Candidates come from the essential lists alone; the bounds of the blocks that a candidate
falls into in the non-essential lists reject it before these blocks are decompressed. The
best documents of all shards are merged by rank.

Terms, weights and scores are 64-bit integers, as the query's contract defines them; the
logarithm alone is a double.

Defined cases: a null text, and one without terms, is no document of the corpus and never
found; a null doc_id counts as the largest among equal scores; each row of a repeated
doc_id or item is a document or item of its own; an item without terms, and an empty
table, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from txrisk.llm.common import materialize, row_slices, whole_text

#: Postings of a block, documents and postings of a shard, documents searched at a time.
BLOCK, SHARD_DOCS, SHARD_POSTINGS, STRETCH = 128, 8192, 2_000_000, 2048
#: Tasks that search the shards, at most.
TASKS = 20_000
#: Items and terms of a block of queries.
QUERY_ITEMS, QUERY_TERMS = 256, 50_000

#: Bytes of a text to bytes of its terms: A-Z lower-cased, other ASCII signs to blanks.
_TERM_BYTES = bytes(
    byte | 32 if 65 <= byte <= 90 else byte if byte >= 128 or 48 <= byte <= 57 or 97 <= byte <= 122 else 32 for byte in range(256)
)

_INDEX = pa.schema(
    [
        ("shard", pa.int64()),
        ("term", pa.string()),
        ("n", pa.int64()),
        ("lasts", pa.list_(pa.int32())),
        ("max_tf", pa.list_(pa.int64())),
        ("min_length", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int32())),
        ("payload", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
    ]
)
_INDEX_DDL = (
    "shard long, term string, n long, lasts array<int>, max_tf array<long>, min_length array<long>, "
    "ends array<int>, payload binary, doc_ids array<long>, lengths array<long>"
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, repeats included."""
    return text.translate(_TERM_BYTES).split()


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned integers as groups of seven bits, the last group of each without the top
    bit; also where each integer ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    packed, starts = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8), ends - size
    for k in range(int(size.max(initial=0))):
        longer = size > k
        group = (values[longer] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        packed[starts[longer] + k] = group | np.where(size[longer] > k + 1, 128, 0).astype(np.uint8)
    return packed, ends


def unpack_numbers(packed: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(packed < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    values = np.zeros(len(ends), dtype=np.int64)
    for k in range(int((ends - starts).max(initial=0))):
        longer = ends - starts > k
        values[longer] |= (packed[starts[longer] + k].astype(np.int64) & 127) << 7 * k
    return values


class ShardWriter:
    """Collects documents and gives the index rows of one shard."""

    def __init__(self):
        self.docs: list = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.terms, self.counts, self.distinct = [], [], []

    def add(self, doc, text: bytes) -> None:
        found = Counter(terms_of(text))
        if not found:
            return
        numbers = self.numbers
        self.terms.append(np.array([numbers.setdefault(term, len(numbers)) for term in found], dtype=np.int64))
        self.counts.append(np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        self.docs.append(doc)
        self.lengths.append(found.total())
        self.distinct.append(len(found))

    def full(self) -> bool:
        return len(self.docs) >= SHARD_DOCS or sum(self.distinct) >= SHARD_POSTINGS

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        # documents are numbered by doc_id, null last, so that equal scores are settled by number
        order = sorted(range(len(self.docs)), key=lambda k: (self.docs[k] is None, self.docs[k] or 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, dtype=np.int64)[order]
        names = sorted(self.numbers)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.numbers[name] for name in names]] = np.arange(len(names))
        term = rank[np.concatenate(self.terms)]
        doc = np.repeat(place, self.distinct)
        sorting = np.lexsort((doc, term))
        term, doc, tf = term[sorting], doc[sorting], np.concatenate(self.counts)[sorting]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        n = np.diff(first, append=len(term))
        blocks = -(-n // BLOCK)
        within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(first, blocks) + within * BLOCK
        stop = np.minimum(start + BLOCK, np.repeat(first + n, blocks))
        step = np.diff(doc, prepend=0)
        step[start] = doc[start]
        packed, ends = pack_numbers(np.column_stack([step, tf]).ravel())
        byte_end = ends[2 * stop - 1]
        term_from = np.concatenate([[0], byte_end[np.cumsum(blocks) - 1]])
        bounds = pa.array(np.concatenate([[0], np.cumsum(blocks)]).astype(np.int32))

        def per_block(values, kind):
            return pa.ListArray.from_arrays(bounds, pa.array(values, kind))

        rows = len(names)
        payload = pa.Array.from_buffers(
            pa.binary(), rows, [None, pa.py_buffer(term_from.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())]
        )
        columns = [
            pa.array(np.full(rows, shard)),
            pa.array([name.decode() for name in names], pa.string()),
            pa.array(n),
            per_block(doc[stop - 1], pa.int32()),
            per_block(np.maximum.reduceat(tf, start), pa.int64()),
            per_block(np.minimum.reduceat(lengths[doc], start), pa.int64()),
            per_block(byte_end - np.repeat(term_from[:-1], blocks), pa.int32()),
            payload,
            pa.nulls(rows, pa.list_(pa.int64())),
            pa.nulls(rows, pa.list_(pa.int64())),
        ]
        yield from row_slices([pa.RecordBatch.from_arrays(columns, schema=_INDEX)], 20_000)
        listed = {"shard": shard, "term": "", "n": len(order), "doc_ids": [self.docs[k] for k in order], "lengths": lengths.tolist()}
        yield pa.RecordBatch.from_pylist([listed], schema=_INDEX)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the index of all documents and return it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId() << 24, ShardWriter()
        for batch in row_slices(batches, 256):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                writer.add(doc, text)
            if writer.full():
                yield from writer.rows(shard)
                shard, writer = shard + 1, ShardWriter()
        yield from writer.rows(shard)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return materialize(rows.mapInArrow(run, _INDEX_DDL), "search-index", path)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if 75 * n_docs * int(lengths.max(initial=0)) < 1 << 63:
        return 25 + 75 * n_docs * lengths // n_terms
    return np.array([25 + 75 * n_docs * n // n_terms for n in lengths.tolist()], dtype=np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class PostingList:
    """One term's postings in a shard; blocks are decompressed when asked for, once."""

    def __init__(self, row: dict, norms: np.ndarray, n_docs: int, n_terms: int):
        self.lasts = np.array(row["lasts"])
        self.bounds = impacts(np.array(row["max_tf"]), length_norms(np.array(row["min_length"]), n_docs, n_terms))
        self.bound = int(self.bounds.max())
        self.ends, self.payload, self.norms = row["ends"], row["payload"], norms
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block k."""
        if k not in self.blocks:
            start = self.ends[k - 1] if k else 0
            pairs = unpack_numbers(np.frombuffer(self.payload, np.uint8, self.ends[k] - start, start))
            docs = np.cumsum(pairs[::2])
            self.blocks[k] = docs, impacts(pairs[1::2], self.norms[docs])
        return self.blocks[k]

    def between(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(int(np.searchsorted(self.lasts, low)), len(self.lasts)):
            docs, values = self.block(k)
            a, b = np.searchsorted(docs, (low, high))
            if b > a:
                yield docs[a:b], values[a:b]
            if b < len(docs):
                break

    def block_bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each document falls into, and its bound; none behind the last block."""
        at = np.searchsorted(self.lasts, docs)
        return at, np.where(at < len(self.lasts), self.bounds[np.minimum(at, len(self.lasts) - 1)], 0)

    def values(self, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Impacts of documents, zero where the term does not occur."""
        found = np.zeros(len(docs), dtype=np.int64)
        for k in np.unique(at[at < len(self.lasts)]).tolist():
            rows = np.flatnonzero(at == k)
            listed, impact = self.block(k)
            place = np.minimum(np.searchsorted(listed, docs[rows]), len(listed) - 1)
            found[rows] = np.where(listed[place] == docs[rows], impact[place], 0)
        return found


def search_shard(lists: list[tuple[PostingList, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents (numbers in the shard) and their scores, best first."""
    lists = sorted(lists, key=lambda item: item[0].bound * item[1])
    together = np.cumsum([0, *(plist.bound * w for plist, w in lists)])
    best, scores, threshold = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1
    for low in range(0, n_docs, STRETCH):
        high = min(low + STRETCH, n_docs)
        # lists [0, essential) together stay below the threshold
        essential = int(np.searchsorted(together[1:], threshold))
        if essential == len(lists):
            break
        total = np.zeros(high - low, dtype=np.int64)
        for plist, w in lists[essential:]:
            for docs, values in plist.between(low, high):
                total[docs - low] += w * values
        docs = np.flatnonzero(total + together[essential] >= threshold)
        docs = docs[total[docs] > 0]
        reached, docs = total[docs], docs + low
        if essential and len(docs):
            blocks = [plist.block_bounds(docs) for plist, _ in lists[:essential]]
            at = np.array([block for block, _ in blocks])
            bounds = np.array([bound * w for (_, bound), (_, w) in zip(blocks, lists)])
            rest = bounds.sum(axis=0)
            for i in range(essential - 1, -1, -1):
                open_ = reached + rest >= threshold
                docs, reached, rest, at, bounds = docs[open_], reached[open_], rest[open_], at[:, open_], bounds[:, open_]
                if not len(docs):
                    break
                plist, w = lists[i]
                reached = reached + w * plist.values(docs, at[i])
                rest = rest - bounds[i]
        docs, reached = np.concatenate([best, docs]), np.concatenate([scores, reached])
        order = np.lexsort((docs, -reached))[:k]
        best, scores = docs[order], reached[order]
        if len(best) == k:
            threshold = max(1, int(scores[-1]))
    return best[scores > 0], scores[scores > 0]


def _query_blocks(items: DataFrame, key: str) -> Iterator[list[tuple[int, object, Counter]]]:
    """Blocks of (number, item, terms with repeats), none above the bounds but by one item."""
    block, terms = [], set()
    rows = items.select(key, F.encode(whole_text(), "UTF-8").alias("raw")).orderBy(key, "raw")
    for number, (item, raw) in enumerate(rows.toLocalIterator()):
        counted = Counter(term.decode() for term in terms_of(bytes(raw)))
        if not counted:
            continue
        if block and (len(block) >= QUERY_ITEMS or len(terms) + len(counted) > QUERY_TERMS):
            yield block
            block, terms = [], set()
        block.append((number, item, counted))
        terms.update(counted)
    if block:
        yield block


def _search_block(
    index: DataFrame, block: list, n_shards: int, n_docs: int, n_terms: int, k: int, item_kind: str
) -> DataFrame:
    spark = index.sparkSession
    terms = sorted({term for _, _, counted in block for term in counted})
    # bounded: QUERY_TERMS terms, or those of a single item
    wanted = F.broadcast(spark.createDataFrame([Row(term=term) for term in ["", *terms]]))
    rows = index.join(wanted, "term", "left_semi")
    counts = rows.where("term != ''").groupBy("term").agg(F.sum("n").alias("df"))
    weights = {row.term: weight(n_docs, row.df) for row in counts.collect()}
    queries = [
        (number, item, [(term, q * weights[term]) for term, q in counted.items() if weights.get(term, 0) > 0])
        for number, item, counted in block
    ]
    fields = [("number", pa.int64()), ("position", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]
    schema = pa.schema(fields)

    def run(shard: pa.Table) -> pa.Table:
        listed = shard.filter(pc.equal(shard["term"], "")).to_pylist()[0]
        norms = length_norms(np.array(listed["lengths"]), n_docs, n_terms)
        lists = {
            row["term"]: PostingList(row, norms, n_docs, n_terms)
            for row in shard.drop_columns(["doc_ids", "lengths"]).to_pylist()
            if row["term"]
        }
        found = []
        for position, (number, _, weighted) in enumerate(queries):
            present = [(lists[term], w) for term, w in weighted if term in lists]
            if present:
                docs, scores = search_shard(present, len(norms), k)
                found.extend((number, position, listed["doc_ids"][d], s) for d, s in zip(docs.tolist(), scores.tolist()))
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found), fields)], schema=schema) if found else schema.empty_table()

    # a shard is little data and much work, so small shuffle blocks are not put together
    by_shard = rows.repartition(min(n_shards, TASKS), "shard").groupBy("shard").applyInArrow(run, "number long, position int, doc_id long, score long")
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = by_shard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(number, item) for number, item, _ in queries], f"number long, item_id {item_kind}")
    return ranked.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id") -> DataFrame:
    """The k best documents with a score above 0 for each row of ``items`` (key, text):
    item_id, rank from 1, doc_id, score."""
    spark, kind = index.sparkSession, items.schema[key].dataType.simpleString()
    listed = index.where("term = ''")
    summed = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    n_shards, n_docs, n_terms = listed.agg(F.count("n"), F.sum("n"), F.sum(summed)).first()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if n_docs:
        for block in _query_blocks(items, key):
            found = found.union(materialize(_search_block(index, block, n_shards, n_docs, n_terms, k, kind), "ranking"))
    return found
