"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A token folder holds, for each part, ``ids-NNNNN.bin`` (unsigned integers, little
endian, as wide as the vocabulary needs), ``offsets-NNNNN.bin`` (unsigned 64-bit, one
more than documents, counted inside the part), ``docs-NNNNN.bin`` (signed 64-bit
doc_ids) and the manifest with each part's base: the prefix sum of the ids of all
parts before it. Parts are ranges of doc_id, so the parts in turn hold the ids in
ascending doc_id order. Readers map the files into memory.

A part is written by one task under another name and renamed when whole, so a task
that is repeated after a lost executor gives the same file. The driver sees one small
row per part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txrisk.llm.common import ids_and_texts, mounted, publish, row_slices, whole_text

#: Encoded words that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000

# Letters, numbers and white space among the first 256 characters.
_LETTERS, _NUMBERS, _WHITE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
# The published word pattern of the vocabulary, for these characters.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")


class TextEncoder(dict):
    """Ids of whole texts from a lower-casing word tokenizer, as packed unsigned integers.

    The tokenizer encodes each word of its pattern by itself and drops white space. A text
    of the first 256 characters, which no normalisation but lower case changes, is cut into
    these words; each goes through the tokenizers library once and is then remembered. Any
    other text is cut at ASCII white space, which no token crosses, and so is a text with
    ``<``, which may spell a special token.
    """

    def __init__(self, path: str, dtype: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype(dtype)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.library.encode(word, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<" not in text and (text.isascii() or _is_latin(text)):
            words = _WORD.findall(text.lower())
        else:
            words = re.findall("[^\t-\r ]+", text)
        return b"".join(map(self.__getitem__, words))


def _is_latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, dtype: str) -> TextEncoder:
    """The encoder of this worker, kept between tasks."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = TextEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def id_type(path: str) -> str:
    """The narrowest unsigned type for the tokenizer's ids."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _part_writer(place: str, tokenizer: str, dtype: str, end_id: int) -> Callable:
    end = np.array([end_id], dtype=dtype).tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, width, coder = TaskContext.get().partitionId(), np.dtype(dtype).itemsize, encoder(tokenizer, dtype)
        docs, counts = [], []

        def ids(file):
            for batch in row_slices(batches):
                keys, texts = ids_and_texts(batch)
                docs.extend(keys.to_pylist())
                for text in texts:
                    packed = coder.encode(text)
                    file.write(packed)
                    file.write(end)
                    counts.append(len(packed) // width + 1)

        publish(f"{place}/ids-{part:05d}.bin", ids)
        if not docs:
            os.unlink(f"{place}/ids-{part:05d}.bin")
            return
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.uint64)]).astype("<u8")
        nulls = [row for row, doc in enumerate(docs) if doc is None]
        named = np.array([0 if doc is None else doc for doc in docs], dtype="<i8")
        publish(f"{place}/offsets-{part:05d}.bin", lambda file: file.write(offsets.tobytes()))
        publish(f"{place}/docs-{part:05d}.bin", lambda file: file.write(named.tobytes()))
        row = {"part": [part], "n_docs": [len(docs)], "n_ids": [int(offsets[-1])], "null_ids": [len(nulls)]}
        yield pa.RecordBatch.from_pydict(row)

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encode whole texts and write a token folder.

    Documents are range-partitioned and sorted by doc_id (null first), then by text, so
    repeated doc_ids keep a fixed order; a null or empty text has the end id only. The
    narrow sort key is all that the sampling of the ranges needs.
    """
    place, dtype = mounted(folder), id_type(tokenizer)
    os.makedirs(place, exist_ok=True)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    parts = ordered.select("doc_id", "text").mapInArrow(
        _part_writer(place, tokenizer, dtype, end_id), "part long, n_docs long, n_ids long, null_ids long"
    )
    listed = sorted(map(tuple, parts.collect()))
    bases = np.concatenate([[0], np.cumsum([n for _, _, n, _ in listed], dtype=np.int64)])
    manifest = {
        "dtype": dtype,
        "parts": [
            {"part": part, "base": int(base), "n_docs": n_docs, "n_ids": n_ids, "null_ids": null_ids}
            for (part, n_docs, n_ids, null_ids), base in zip(listed, bases)
        ],
    }
    publish(f"{place}/manifest.json", lambda file: file.write(json.dumps(manifest).encode()))


class TokenPart:
    """One part of a token folder, mapped into memory."""

    def __init__(self, place: str, dtype: str, part: int, base: int, null_ids: int = 0, **_):
        name = f"{part:05d}.bin"
        self.base, self.null_ids = base, null_ids
        self.ids = np.memmap(f"{place}/ids-{name}", dtype=dtype, mode="r")
        self.offsets = np.memmap(f"{place}/offsets-{name}", dtype="<u8", mode="r")
        self.docs = np.memmap(f"{place}/docs-{name}", dtype="<i8", mode="r")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, row: int) -> np.ndarray:
        return self.ids[int(self.offsets[row]) : int(self.offsets[row + 1])]


def manifest_of(folder: str) -> dict:
    with open(f"{mounted(folder)}/manifest.json", encoding="utf-8") as file:
        return json.load(file)


def read_tokens(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """The documents of a token folder: doc_id, start, n_tokens, ids_crc32 and the ids.

    ``start`` counts the ids of all documents before; the checksum is taken over the ids as
    32-bit little-endian integers. ``digest_only`` leaves the ids out.
    """
    place, manifest = mounted(folder), manifest_of(folder)
    parts, dtype = manifest["parts"], manifest["dtype"]
    fields = [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ] + ([] if digest_only else [("ids", pa.list_(pa.int64()))])
    schema = pa.schema(fields)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in batches for n in batch.column("id").to_pylist()):
            part = TokenPart(place, dtype, **parts[number])
            for low in range(0, len(part), 256):
                rows = range(low, min(low + 256, len(part)))
                ids = [part[row].astype("<u4") for row in rows]
                columns = [
                    pa.array([None if row < part.null_ids else int(part.docs[row]) for row in rows], pa.int64()),
                    pa.array([part.base + int(part.offsets[row]) for row in rows], pa.int64()),
                    pa.array([len(some) for some in ids], pa.int64()),
                    pa.array([zlib.crc32(some.tobytes()) for some in ids], pa.int64()),
                ]
                if not digest_only:
                    columns.append(pa.array([some.astype(np.int64) for some in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    return spark.range(0, len(parts), 1, max(len(parts), 1)).mapInArrow(read, ddl)
