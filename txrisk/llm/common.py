"""What the text operators share: the document table, stored steps, files and streams of Arrow batches.

A document table has ``doc_id`` and ``text``; other columns are carried where an
operator says so. A null text counts as the empty text everywhere.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse
from weakref import WeakSet

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import txrisk
from txrisk.session import materialize, new_path

#: The characters that part words, as a regular expression class and as plain text.
SPACES = "\\x20\\x09-\\x0D"
SPACE_TEXT = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SHIPPED: WeakSet = WeakSet()

__all__ = ["materialize", "new_path"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII characters takes the quicker, equal form."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words_of(text: Column) -> Column:
    """Array of the words of a text, none for a text of white space."""
    trimmed = F.btrim(text, F.lit(SPACE_TEXT))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))


def mounted(path: str) -> str:
    """The place of a shared path in the file system, for files that are memory-mapped."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on every machine, not {path}")
    return parts.path


def shared_file(spark: SparkSession, label: str) -> str:
    """A new place for a file that the driver writes once and all tasks map."""
    path = mounted(new_path(spark, label))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def publish(path: str, write) -> None:
    """Write a file whole or not at all: readers and repeated task attempts never see a part of it."""
    partial = f"{path}.{os.getpid()}-{os.urandom(4).hex()}.partial"
    with open(partial, "wb") as file:
        write(file)
    os.replace(partial, path)


def publish_array(path: str, values: np.ndarray) -> str:
    publish(path, lambda file: np.save(file, values))
    return path


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for a Spark context.

    A job started with ``--py-files`` has it already; then this does no harm.
    """
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    top = Path(txrisk.__file__).parent
    path = shared_file(spark, "package") + ".zip"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    publish(path, lambda file: file.write(packed.getvalue()))
    context.addPyFile(path)
    _SHIPPED.add(context)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a finished query leaves none of its shuffled files behind; for steps that are written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that Python objects for few rows live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ids_and_texts(batch: pa.RecordBatch, key: str = "doc_id") -> tuple[pa.Array, list[str]]:
    return batch.column(key), [text or "" for text in batch.column("text").to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal keys; the input must be sorted by the keys.

    Only the last, perhaps unfinished run of each batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = run_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows:
        new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
