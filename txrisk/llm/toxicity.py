"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the
stretches by which toxic text differs from it, the words that occur in far more contexts
there. A window is compressed once with the ordinary dictionary and
once with both; the bytes that the toxic dictionary saves are its distance from ordinary
text. Ordinary windows save nothing or next to nothing, so a threshold set on windows of
ordinary training documents parts the two, and a logistic curve over what a document's
windows save above it, fitted to the labels, gives the score.

Learning reads a bounded sample of labelled documents (``MAX_TOXIC``, ``MAX_ORDINARY``,
those of the smallest hash of doc_id), whole texts. Scoring reads every whole text in
tasks that hold one text's windows at a time; nothing is shuffled.

Null and empty texts have one empty window and get the curve's value at nothing saved.
A doc_id that is labelled more than once is toxic if any of its labels says so; null
labels are left out. Without any toxic or ordinary label all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import ids_and_texts, row_slices, whole_text

#: Bounds of the labelled sample, of the distinguishing words and of the windows that train a dictionary.
MAX_TOXIC, MAX_ORDINARY, MAX_WORDS, MAX_WINDOWS = 4000, 8000, 2000, 20000
#: A distinguishing word follows so many different words in toxic documents at least, so many for each toxic
#: document, and so many times as many for a document as in ordinary ones. Copies of one text repeat its words after the same words, and do not count.
MIN_CONTEXTS, MIN_SHARE, MIN_RATIO = 3, 0.01, 8.0
WINDOW_WORDS = 16
#: Longer words are cut into pieces, each with the last WORD_OVERLAP characters of the one before, so that a window stays small.
WORD_CHARS, WORD_OVERLAP = 64, 16
TOXIC_BYTES, ORDINARY_BYTES = 8192, 16384
#: The share of ordinary windows that may save more than the window threshold.
WINDOW_QUANTILE = 0.99
RIDGE = 0.01
_STOPS = str.maketrans(dict.fromkeys(".,!?;:|\"()", " "))


def normal_words(text: str) -> list[str]:
    return text.lower().translate(_STOPS).split()


def pieces(words: Iterable[str]) -> Iterator[str]:
    """Words of WORD_CHARS characters at most; a longer one gives all its characters in several pieces."""
    for word in words:
        if len(word) <= WORD_CHARS:
            yield word
        else:
            for start in range(0, len(word) - WORD_OVERLAP, WORD_CHARS - WORD_OVERLAP):
                yield word[start : start + WORD_CHARS]


def windows(text: str) -> Iterator[bytes]:
    """Consecutive windows of words between spaces; a text without words has one empty window."""
    words = list(pieces(normal_words(text)))
    for start in range(0, len(words), WINDOW_WORDS):
        yield f" {' '.join(words[start : start + WINDOW_WORDS])} ".encode()
    if not words:
        yield b" "


def train_dictionary(samples: list[bytes], size: int, always: list[bytes] = ()) -> bytes:
    """Content of a zstandard dictionary. What ``always`` holds and training left out is put
    in front, as far as there is room; samples too few to train on leave that alone."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=32, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        trained = b"" if always else b"".join(dict.fromkeys(samples))[-size:]
    missed = b"".join(part for part in dict.fromkeys(always) if part not in trained)
    return b"\n" + missed[: max(0, size - len(trained))] + trained  # no header at the start: raw content


class Compressor:
    """Lengths of windows under a raw-content dictionary. Matches have five bytes at least."""

    def __init__(self, content: bytes):
        parameters = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            window_log=15,
            hash_log=15,
            chain_log=15,
            search_log=4,
            min_match=6,
            target_length=16,
            strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        self.compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

    def length(self, window: bytes) -> int:
        return len(self.compress(window))


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float = 0.0
    weights: tuple[float, ...] = (-40.0, 0.0, 0.0, 0.0, 0.0)

    def score(self, saved: np.ndarray) -> float:
        z = float(np.dot(self.weights, features(saved, self.threshold)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def features(saved: np.ndarray, threshold: float) -> list[float]:
    """Constant, bytes saved above the threshold, windows above it, the best window, all windows."""
    above = saved[saved > threshold]
    counts = [float(np.log1p(n)) for n in (above.sum(), len(above), len(saved))]
    return [1.0, *counts, float(saved.max()) / 10]


_COMPRESSORS: dict[tuple[bytes, bytes], tuple[Compressor, Compressor]] = {}


def saved_bytes(model: Model, text: str) -> np.ndarray:
    """What the toxic dictionary saves in each window of a text."""
    key = (model.toxic, model.ordinary)
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        _COMPRESSORS[key] = Compressor(model.ordinary), Compressor(b"\n" + model.toxic + model.ordinary)
    plain, both = _COMPRESSORS[key]
    return np.array([plain.length(w) - both.length(w) for w in windows(text)])


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from, one per doc_id."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and labels of the bounded sample. Only its ids, MAX_TOXIC + MAX_ORDINARY, are broadcast."""
    known, order = learning_labels(labels), (F.xxhash64("doc_id"), F.col("doc_id"))
    toxic = known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC)
    ordinary = known.where("toxic = 0").orderBy(*order).limit(MAX_ORDINARY)
    chosen = toxic.union(ordinary).withColumnRenamed("doc_id", "id")
    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")


def _distinguishing(rows: DataFrame) -> list[str]:
    """Words by which toxic sample documents differ, the most telling first."""

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            found = set()
            for text, toxic in zip(ids_and_texts(batch)[1], batch.column("toxic").to_pylist()):
                told = list(pieces(normal_words(text)))
                found.update((w, before, toxic) for before, w in zip(["", *told], told))
            columns = zip(*found) if found else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int32())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "before", "toxic"])

    pairs = rows.mapInArrow(words, "word string, before string, toxic int").distinct()
    sides = pairs.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    totals = dict(rows.groupBy("toxic").count().collect())
    ratio = (F.col("t") / F.lit(totals.get(1, 1))) / ((F.col("o") + 1) / F.lit(totals.get(0, 1)))
    least = max(MIN_CONTEXTS, MIN_SHARE * totals.get(1, 0))
    leaning = sides.withColumn("ratio", ratio).where((F.col("t") >= least) & (F.col("ratio") >= MIN_RATIO))
    best = leaning.orderBy(F.col("ratio").desc(), "word").limit(MAX_WORDS).collect()
    return [row.word for row in best]


def _toxic_stretches(rows: DataFrame, words: frozenset[str]) -> list[bytes]:
    """The distinguishing words of each toxic sample document, as they follow one another, cut
    into at most MAX_WINDOWS windows."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            told = (" ".join(w for w in pieces(normal_words(t)) if w in words) for t in ids_and_texts(batch)[1])
            yield pa.RecordBatch.from_arrays([pa.array([w for t in told for w in windows(t)], pa.binary())], ["w"])

    return _bounded(rows.where("toxic = 1").mapInArrow(cut, "w binary"))


def _bounded(cuts: DataFrame) -> list[bytes]:
    return [bytes(row.w) for row in cuts.orderBy(F.xxhash64("w"), "w").limit(MAX_WINDOWS).collect()]


def _ordinary_windows(rows: DataFrame) -> list[bytes]:
    """At most MAX_WINDOWS windows of ordinary sample documents, those of the smallest hash."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            found = [w for text in ids_and_texts(batch)[1] for w in windows(text)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["w"])

    return _bounded(rows.where("toxic = 0").mapInArrow(cut, "w binary"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels)
    totals = dict(rows.groupBy("toxic").count().collect())
    if not totals.get(0) or not totals.get(1):
        return Model(b"\n", b"\n")
    words = _distinguishing(rows)
    toxic = train_dictionary(_toxic_stretches(rows, frozenset(words)), TOXIC_BYTES, [f" {w} ".encode() for w in words])
    model = Model(toxic, train_dictionary(_ordinary_windows(rows), ORDINARY_BYTES))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            saved = [np.bincount(np.maximum(saved_bytes(model, t), 0)) for t in ids_and_texts(batch)[1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([s.tolist() for s in saved], pa.list_(pa.int64()))], ["toxic", "saved"]
            )

    # A histogram per sample document: as short as the most bytes that a window saves.
    found = rows.mapInArrow(measure, "toxic int, saved array<long>").collect()
    labelled = np.array([row.toxic for row in found])
    saved = [np.repeat(np.arange(len(row.saved)), row.saved) for row in found]
    threshold = float(np.quantile(np.concatenate([s for s, t in zip(saved, labelled) if t == 0]), WINDOW_QUANTILE))
    x = np.array([features(s, threshold) for s in saved])
    return Model(model.toxic, model.ordinary, threshold, logistic(x, labelled))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        weights = weights + step * min(1.0, 5 / size if size else 1.0)
        if size < 1e-8:
            break
    return tuple(float(w) for w in weights)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            keys, texts = ids_and_texts(batch)
            values = [model.score(saved_bytes(model, text)) for text in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, all columns as they came.

    Only one verdict column is added in the scan, so no join is needed.
    """
    model = fit(docs, labels)

    @F.pandas_udf("boolean")
    def ordinary(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(saved_bytes(model, text or "")) < 0.5 for text in texts])

    return docs.where(ordinary(whole_text()))
