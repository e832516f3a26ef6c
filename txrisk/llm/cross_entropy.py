"""Language-model scores by cross-entropy difference.

Two n-gram models over characters, one of good text and one of all text, have the same
symbols, order and smoothing, so the difference of their losses per symbol says how much
more a document is like the good text.

Every code point is a symbol of its own, and all n-grams of all whole documents are counted,
in the good model those of every document that is labelled good. Counts are combined in the
task and added by a grouped sum; probabilities come from equality joins of the orders. The
table of log-probabilities is written by the tasks in sorted files, more of them the larger it
is, which scoring tasks map into memory; the driver sees a row for each file. Contexts have
weights of their own, so an n-gram that no document holds is scored by a shorter one.

Null and empty texts have no symbols, losses of 0 and a score of 0. Without good text the
two models are the same and all scores are 0.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import ids_and_texts, materialize, publish_array, row_slices, shared_file, whole_text

#: Symbols of the dense form, which ``log_probabilities`` computes; the models themselves have no bound.
SYMBOLS, ORDER = 64, 4
GRAMS = SYMBOLS**ORDER
#: The weight of the next shorter context, in counts.
SMOOTHING = 8.0
#: Bits of a symbol, a code point and one; 0 stands before the text.
BITS = 21
#: Rows of a file of the table, about; distinct n-grams that a counting task holds before it hands them on.
FILE_ROWS, HELD = 1 << 20, 1 << 21
_MULTIPLIER, _KIND = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="replace"), dtype="<u4")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The context (ORDER - 1 symbols in one number) and the last symbol of the n-gram at each symbol."""
    symbols = np.concatenate([np.zeros(ORDER - 1, dtype=np.int64), _points(text).astype(np.int64) + 1])
    n = len(symbols) - ORDER + 1
    context = np.zeros(n, dtype=np.int64)
    for k in range(ORDER - 1):
        context = context << BITS | symbols[k : k + n]
    return context, symbols[ORDER - 1 :]


def keys_of(kind: int, context: np.ndarray, last: np.ndarray | int) -> np.ndarray:
    """Where the table holds an n-gram (kind: its order) or a context (kind: its order and ORDER)."""
    found = (context.astype(np.uint64) + np.uint64(kind * _KIND % 2**64)) * _MULTIPLIER
    found = (found ^ found >> np.uint64(29)) * _MULTIPLIER + np.asarray(last).astype(np.uint64)
    found = (found ^ found >> np.uint64(32)) * _MULTIPLIER
    return found ^ found >> np.uint64(30)


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents that a label calls good and none calls bad."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return known.where("q = 1").select("doc_id")


def gram_counts(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(context, last, background, target) over all documents, combined in the task before the shuffle."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        context, last, n, good = (np.concatenate(c) for c in zip(*parts))
        _, first, group = np.unique(keys_of(ORDER, context, last), return_index=True, return_inverse=True)
        sums = [np.bincount(group, weights=c, minlength=len(first)).astype(np.int64) for c in (n, good)]
        return context[first], last[first], *sums

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        fresh = 0
        for batch in row_slices(batches, 16):
            rows = []
            for text, good in zip(ids_and_texts(batch)[1], batch.column("good").to_pylist()):
                context, last = grams(text)
                rows.append((context, last, np.ones(len(last)), np.full(len(last), float(good))))
            parts.append(merged(rows))
            fresh += len(parts[-1][0])
            if fresh > HELD:
                parts = [merged(parts)]
                fresh = 0
                if len(parts[0][0]) > HELD:
                    yield _batch(parts.pop())
        if parts:
            yield _batch(merged(parts))

    def _batch(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "last", "background", "target"])

    marks = targets.select(F.col("doc_id").alias("id"), F.lit(True).alias("good"))
    # one join at every size: both sides are shuffled by the id
    rows = docs.select("doc_id", whole_text().alias("text")).join(marks.hint("merge"), F.col("doc_id") == F.col("id"), "left")
    rows = rows.select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = rows.mapInArrow(count, "context long, last long, background long, target long")
    return counts.groupBy("context", "last").agg(F.sum("background").alias("b"), F.sum("target").alias("t"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last symbol of every n-gram, from the counts of all n-grams.

    A context's estimate leans on the next shorter context with the weight SMOOTHING.
    """
    shorter = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER):
        own = counts.reshape(-1, SYMBOLS**order).sum(axis=0, dtype=np.float64).reshape(-1, SYMBOLS)
        shorter = _smoothed(own, shorter.reshape(-1, SYMBOLS))
    whole = np.empty(GRAMS, dtype=np.float32)
    for first in range(SYMBOLS):  # one leading symbol at a time keeps the working set small
        part = slice(first * SYMBOLS ** (ORDER - 1), (first + 1) * SYMBOLS ** (ORDER - 1))
        own = counts[part].reshape(-1, SYMBOLS).astype(np.float64)
        whole[part] = np.log(_smoothed(own, shorter.reshape(-1, SYMBOLS))).ravel()
    return whole


def _smoothed(own: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Rows are contexts. The shorter context of a row is the row without its first symbol."""
    lean = np.tile(shorter, (len(own) // len(shorter), 1))
    return (own + SMOOTHING * lean) / (own.sum(axis=1, keepdims=True) + SMOOTHING)


def log_table(counts: DataFrame) -> DataFrame:
    """(kind, context, last, b, t): the logarithms of both models for all n-grams of every order,
    and of what a context leaves to the next shorter one."""
    orders = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("context")
        longer = orders[order + 1].select(shorter, "last", "b", "t")
        orders[order] = materialize(longer.groupBy("context", "last").agg(F.sum("b").alias("b"), F.sum("t").alias("t")), "grams")
    symbols = orders[1].count() + 1  # and one for all that do not occur
    table, shorter = None, None
    for order in range(1, ORDER + 1):
        totals = orders[order].groupBy("context").agg(F.sum("b").alias("all_b"), F.sum("t").alias("all_t"))
        rows = orders[order].join(totals, "context")
        if shorter is None:
            rows = rows.withColumn("p_b", F.lit(1 / symbols)).withColumn("p_t", F.lit(1 / symbols))
        else:
            mask = (1 << BITS * (order - 2)) - 1
            rows = rows.withColumn("rest", F.col("context").bitwiseAND(F.lit(mask))).join(shorter, ["rest", "last"])
        chance = [((F.col(s) + SMOOTHING * F.col(f"p_{s}")) / (F.col(f"all_{s}") + SMOOTHING)).alias(s) for s in "bt"]
        found = materialize(rows.select("context", "last", *chance), "chances")
        left = totals.select(
            F.lit(ORDER + order).alias("kind"),
            "context",
            F.lit(0).cast("long").alias("last"),
            *[F.log(SMOOTHING / (F.col(f"all_{s}") + SMOOTHING)).alias(s) for s in "bt"],
        )
        logs = found.select(F.lit(order).alias("kind"), "context", "last", *[F.log(s).alias(s) for s in "bt"])
        table = logs.union(left) if table is None else table.union(logs).union(left)
        shorter = found.select(F.col("context").alias("rest"), "last", F.col("b").alias("p_b"), F.col("t").alias("p_t"))
    return table.withColumn("symbols", F.lit(symbols))


class Model:
    """The files of the table, each with the n-grams whose keys begin with its number, and the symbols."""

    def __init__(self, folder: str, bits: int, symbols: int):
        self.folder, self.bits, self.symbols = folder, bits, symbols

    def _file(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        files = _FILES.setdefault(self.folder, {})
        if number not in files:
            path = f"{self.folder}-{number}"
            if os.path.exists(f"{path}.keys.npy"):
                files[number] = tuple(np.load(f"{path}.{part}.npy", mmap_mode="r") for part in ("keys", "logs"))
            else:
                files[number] = (np.empty(0, dtype=np.uint64), np.empty((0, 2), dtype=np.float32))
        return files[number]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(background, target) logarithms of sorted keys, not-a-number where the table has none."""
        found = np.full((len(keys), 2), np.nan)
        numbers = keys >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(keys), dtype=np.uint64)
        cuts = np.append(np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])), len(keys)) if len(keys) else [0]
        for low, high in zip(cuts[:-1], cuts[1:]):
            known, logs = self._file(int(numbers[low]))
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[low:high]), len(known) - 1)
                hit = known[at] == keys[low:high]
                found[low:high][hit] = logs[at[hit]]
        return found

    def _any(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        found = np.empty((len(keys), 2))
        found[order] = self.find(keys[order])
        return found

    def logs(self, context: np.ndarray, last: np.ndarray, order: int = ORDER) -> np.ndarray:
        if not order:
            return np.full((len(last), 2), -np.log(self.symbols))
        found = self._any(keys_of(order, context, last))
        missing = np.flatnonzero(np.isnan(found[:, 0]))
        if len(missing):
            left = np.nan_to_num(self._any(keys_of(ORDER + order, context[missing], 0)))
            shorter = context[missing] & ((1 << BITS * max(order - 2, 0)) - 1)
            found[missing] = left + self.logs(shorter, last[missing], order - 1)
        return found


_FILES: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both models (background, target) of the documents."""
    counted = materialize(gram_counts(docs, target_ids(labels)), "gram-counts")
    good = counted.agg(F.sum("t")).first()[0]
    table = materialize(log_table(counted if good else counted.withColumn("t", F.col("b"))), "log-table")
    size, symbols = table.agg(F.count("*"), F.max("symbols")).first()
    bits = max(0, int(size // FILE_ROWS).bit_length())
    folder = shared_file(docs.sparkSession, "models")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, context, last = (batch.column(name).to_numpy() for name in ("kind", "context", "last"))
            keys = keys_of(0, context + 0, last)
            for k in np.unique(kind):
                keys[kind == k] = keys_of(int(k), context[kind == k], last[kind == k])
            number = (keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys))).astype(np.int64)
            columns = [pa.array(number), pa.array(keys.view(np.int64)), batch.column("b"), batch.column("t")]
            yield pa.RecordBatch.from_arrays(columns, ["number", "key", "b", "t"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def save() -> int:
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_numpy().view(np.uint64)
            order, path = np.argsort(keys), f"{folder}-{rows.column('number')[0]}"
            logs = np.stack([rows.column(side).to_numpy() for side in "bt"], axis=1).astype(np.float32)
            publish_array(f"{path}.logs.npy", logs[order])
            publish_array(f"{path}.keys.npy", keys[order])
            held.clear()
            return rows.num_rows

        written = 0
        for batch in batches:
            numbers = batch.column("number").to_numpy()
            cuts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
            for low, high in zip(cuts, np.append(cuts[1:], len(numbers))):
                if held and held[-1].column("number")[0].as_py() != numbers[low]:
                    written += save()
                held.append(batch.slice(low, high - low))
        if held:
            written += save()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    placed = table.mapInArrow(place, "number long, key long, b double, t double")
    dealt = placed.repartition("number").sortWithinPartitions("number")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return Model(folder, bits, symbols)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_symbols, background_loss, target_loss, score): losses in nats per symbol, the
    score is background less target, higher for text that is more like the good text."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 16):
            keys, texts = ids_and_texts(batch)
            cut = [grams(text) for text in texts]
            context, last = (np.concatenate(side) for side in zip(*cut))
            _, first, group = np.unique(keys_of(ORDER, context, last), return_index=True, return_inverse=True)
            logs = model.logs(context[first], last[first])
            ends = np.cumsum([len(side) for _, side in cut])
            rows = []
            for low, high in zip([0, *ends[:-1]], ends):
                own = -logs[group[low:high]].mean(axis=0) if high > low else (0.0, 0.0)
                rows.append((int(high - low), float(own[0]), float(own[1])))
            columns = [keys] + [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_symbols", "background_loss", "target_loss"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, n_symbols long, background_loss double, target_loss double")
    return scored.withColumn("score", F.col("background_loss") - F.col("target_loss"))
