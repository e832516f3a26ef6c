"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in
at most three bits, one of their segments differs in at most one. Each segment is
indexed under its 32 variants, each with one bit taken out, so such segments meet under
an equal key; pairs that meet are compared in full.

Only distinct fingerprints are indexed. Rows are dealt by key and sorted, and a task
reads them as a stream of runs. A small run is compared pair by pair; a larger one gives
one link per member, to the smallest member of its part, which keeps every connection.
A run beyond the limit is not compared but cut again: its members, equal in the segment
but for one bit, may differ in three bits of the other segment, which is cut in two and
indexed the same way. After the third cut a run has 2 ** 11 members at most, so the
recursion ends with exact results, whatever the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from txrisk.llm.common import ids_and_texts, materialize, row_slices, whole_text
from txrisk.llm.components import components

SHINGLE, SEED, BITS, MAX_DISTANCE = 3, 42, 64, 3
#: Runs up to PAIRED are compared pair by pair at once for a whole batch; runs beyond LIMIT are cut again.
PAIRED, LIMIT = 16, 2048


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """SimHash over word shingles, repeats included; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    ends = [words[k:] for k in range(min(width, len(words)))]
    counts, total = np.zeros(BITS, dtype=np.int64), 0
    shingles = zip(*ends) if len(words) >= width else [words]
    block: list[int] = []

    def add() -> None:
        nonlocal counts, total
        raw = np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(block)
        block.clear()

    for shingle in shingles:
        block.append(xxh64_intdigest(b" ".join(shingle), SEED))
        if len(block) == 32768:
            add()
    if block:
        add()
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            keys, texts = ids_and_texts(batch)
            found = np.array([fingerprint(text) for text in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(found)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


def variants(rows: DataFrame, level: int) -> DataFrame:
    """Rows (earlier keys, fp) under the one-wildcard variants of the two segments of the bits not yet used.

    The key holds the number of the variant and the segment without its bit.
    """
    width = BITS >> level
    half = width // 2
    rest = F.col("fp")
    for earlier in range(level):
        # A variant below half the width has used the upper segment, so the lower one is left.
        size = BITS >> (earlier + 1)
        upper = F.shiftrightunsigned(rest, size).bitwiseAND(F.lit((1 << size) - 1))
        lower = rest.bitwiseAND(F.lit((1 << size) - 1))
        rest = F.when(F.shiftright(F.col(f"k{earlier}"), 32) < size, lower).otherwise(upper)
    spread = rows.withColumn("rest", rest).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    mask = F.lit((1 << half) - 1)
    segment = F.when(F.col("v") < half, F.shiftrightunsigned("rest", half).bitwiseAND(mask)).otherwise(
        F.col("rest").bitwiseAND(mask)
    )
    without = segment.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, v % {half})")))
    key = F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(without)
    return spread.select(*[f"k{earlier}" for earlier in range(level)], key.alias(f"k{level}"), "fp")


def _pairs(fps: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs inside the runs of a batch, all runs having PAIRED members at most."""
    for step in range(1, PAIRED):
        left = np.flatnonzero(run[step:] == run[:-step])
        if not len(left):
            return
        near = np.bitwise_count(fps[left] ^ fps[left + step]) <= MAX_DISTANCE
        yield fps[left[near]], fps[left[near] + step]


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each member of a run to the smallest of its part of the run."""
    fps = np.sort(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_DISTANCE
    label = np.arange(len(fps))
    while True:
        lower = np.where(near, label[None, :], len(fps)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _linker(keys: list[str], limit: int):
    """Stream function: sorted rows in, links (a, b) and the members of runs beyond the limit out."""

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())]
        columns += [pa.nulls(len(a), pa.int64()) for _ in keys]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", *keys])

    def hot(fps: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), *map(pa.array, values)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", *keys])

    def compare(fps: np.ndarray, values: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, len(fps)))
        run = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat((sizes > 1) & (sizes <= PAIRED), sizes)
        found = list(_pairs(fps[small], run[small]))
        for at in np.flatnonzero((sizes > PAIRED) & (sizes <= limit)):
            found.append(_stars(fps[starts[at] : starts[at] + sizes[at]]))
        if found:
            a, b = (np.concatenate(side) for side in zip(*found))
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            if len(pairs):
                yield batch_of(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
        for at in np.flatnonzero(sizes > limit):
            part = slice(starts[at], starts[at] + sizes[at])
            yield hot(fps[part], [value[part] for value in values])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(keys) + 1
        held, flowing = [np.empty(0, dtype=np.int64)] * width, None
        for batch in batches:
            columns = [np.concatenate([h, batch.column(name).to_numpy()]) for h, name in zip(held, [*keys, "fp"])]
            if flowing is not None:  # the rest of a run that is known to be beyond the limit
                same = np.logical_and.reduce([c == f for c, f in zip(columns[:-1], flowing)])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield hot(columns[-1][:n].view(np.uint64), [c[:n] for c in columns[:-1]])
                columns = [c[n:] for c in columns]
            if not len(columns[0]):
                held = columns
                continue
            new = np.ones(len(columns[0]), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])
            starts = np.flatnonzero(new)
            cut, flowing = int(starts[-1]), None
            if cut:
                yield from compare(columns[-1][:cut].view(np.uint64), [c[:cut] for c in columns[:-1]], starts[:-1])
            held = [c[cut:] for c in columns]
            if len(held[0]) > limit:
                flowing = [c[0] for c in held[:-1]]
                yield hot(held[-1].view(np.uint64), held[:-1])
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from compare(held[-1].view(np.uint64), held[:-1], np.array([0]))

    return link


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that lie within three bits."""
    found, rows, level = None, fps.select("fp"), 0
    while True:
        keys = [f"k{earlier}" for earlier in range(level + 1)]
        last = BITS >> level == 16
        dealt = variants(rows, level).repartition(*keys).sortWithinPartitions(*keys)
        schema = "a long, b long, " + ", ".join(f"{key} long" for key in keys)
        step = materialize(dealt.mapInArrow(_linker(keys, 1 << 20 if last else limit), schema), "simhash-links")
        pairs = step.where("b is not null").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        rest = step.where("b is null")
        if last or rest.isEmpty():
            return found.distinct()
        rows, level = rest.select(*keys, F.col("a").alias("fp")), level + 1


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): the component is named by its smallest doc_id.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; rows
    with a null doc_id count as larger than all others. Repeated rows come back as often.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    members = components(links(nodes, limit))
    named = members.join(nodes.withColumnRenamed("fp", "node"), "node")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(smallest, "root").select(F.col("node").alias("fp"), "component")
    whole = nodes.join(labels, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return rows.join(materialize(whole, "fingerprint-labels"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id names their component, all columns as they came.

    Rows with a null doc_id stay only where no document of their group has an id.
    """
    found = near_duplicates(docs)
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = chosen.withColumnRenamed("doc_id", "__kept")
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")), "left_semi")
