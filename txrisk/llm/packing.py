"""Packing of token sequences into windows by minimum bin slack.

A document's ids are those of the tokenizers library, followed by an end id. Stretches of
a whole window go out as they are; what remains of each document is a piece of less than
a window. A task holds pieces by length. For each window it takes the longest piece, and a
bitset of reachable sums over the other lengths (each with its count) tells which multiset
of them fills the window best; walking back through the bitsets gives how many pieces of
each length to take. Where even the best sum leaves slack, one more piece is cut to fill
it and its rest stays for a later window, so only the last window of a task is not full.
These last windows of many tasks are packed once more, together.

Nothing is shuffled by a key and no text is held longer than it takes to place its ids: a
task keeps one block of remaining pieces, whatever the size of the table or of one text.
Rows are deterministic for given partitions, so a repeated task gives the same rows.

Defined cases: a null or empty text has the end id only; null and repeated doc_ids are rows
like any other; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.bpe_codec import PATTERN, Codec, Vocabulary
from txrisk.llm.common import ids_and_texts, materialize, row_slices, whole_text

WINDOW = 1024
#: A task packs when its pieces hold this many ids, and stops at the second figure while
#: more documents come: a rich choice of lengths leaves less slack.
FULL, LOW = 1 << 20, 1 << 17
#: Tasks whose last windows are packed together.
TOGETHER = 64
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 700_000
#: Sequence ids are numbered inside a task; these bits hold the number.
BITS = 40

_FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("ids", pa.binary()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class RankCodec(Codec):
    """Encoder of a byte-level BPE vocabulary whose merges are in the order of their ids.

    Such a vocabulary is a table of ranks, which an ordinary ASCII text goes through at
    once. A text with special tokens or other characters is cut into words by ``Codec``,
    and each new word goes through the ranks. Very long stretches of one kind, and all
    texts of a vocabulary in another order, are left to the exact merges.
    """

    _RUN = re.compile(r"[^\t-\r ]{50000}|[\t-\r ]{50000}")

    def __init__(self, path: str):
        super().__init__(Vocabulary(path))
        known = self.vocabulary
        merged = [number for _, number in sorted(known.merges.values())]
        self.ranked = None
        if merged == sorted(merged):
            special = set(known.special.values())
            ranks = {token: number for number, token in enumerate(known.token_bytes) if number not in special}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.of_word = tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        return [self._packed(text) for text in texts]

    def _learn(self, words: set[str]) -> None:
        if self.ranked is None:
            return super()._learn(words)
        if len(self.words) > REMEMBERED:
            self.words.clear()
        for word in words:
            if word not in self.words:
                ids = self.of_word.encode_ordinary(word) if len(word) < 50_000 else self.vocabulary.merge(word.encode())
                self.words[word] = array("i", ids).tobytes()

    def _packed(self, text: str) -> bytes:
        special = self.vocabulary.special_pattern
        plain = self.ranked is not None and text.isascii() and (len(text) < 50_000 or not self._RUN.search(text))
        if plain and (special is None or not special.search(text)):
            return array("i", self.ranked.encode_ordinary(text)).tobytes()
        return super().encode_packed([text])[0]


_CODECS: dict[str, RankCodec] = {}


def rank_codec(path: str) -> RankCodec:
    """The encoder of this worker, kept between tasks; only the latest one is kept."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = RankCodec(path)
    return _CODECS[path]


def best_fill(counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset with the largest sum within ``room``, where
    ``counts[length]`` pieces of each length are at hand.

    Bit s of a bitset says that sum s can be reached with the lengths so far, longest
    first; counts are split into powers of two. The walk back starts at the shortest length
    and takes as few of it as it can.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = counts[length]
        if not left:
            continue
        steps.append((length, reach))
        if left == 1 or 2 * length > room:
            reach |= reach << length & mask
        else:
            left, part = min(left, room // length), 1
            while left:
                part = min(part, left)
                reach |= reach << (length * part) & mask
                left -= part
                part *= 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        used = 0
        while not before >> (total - used * length) & 1:
            used += 1
        if used:
            taken.append((length, used))
            total -= used * length
    return taken


class Packer:
    """The pieces of one task and the windows made of them.

    A piece is (doc_id, start, packed ids, ids of its document), its ids being 32-bit
    little-endian integers.
    """

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence = window, first_sequence
        self.pieces: list[list[tuple]] = [[] for _ in range(window)]
        self.counts, self.held = [0] * window, 0
        self.rows: list[tuple] = []

    def _emit(self, sequence: int | None, offset: int, piece: tuple, keep: bool = False) -> None:
        doc, start, ids, tokens = piece
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, ids if keep else None))

    def add(self, doc, ids: bytes, start: int = 0, tokens: int | None = None) -> None:
        """Whole windows go out at once; the rest of the document is held."""
        tokens = len(ids) // 4 if tokens is None else tokens
        step = 4 * self.window
        for at in range(0, len(ids) - step + 1, step):
            self._emit(self.sequence, 0, (doc, start + at // 4, ids[at : at + step], tokens))
            self.sequence += 1
        rest = ids[len(ids) - len(ids) % step :]
        if rest:
            self._hold((doc, start + (len(ids) - len(rest)) // 4, rest, tokens))

    def _hold(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.pieces[length].append(piece)
        self.counts[length] += 1
        self.held += length

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.held -= length
        return self.pieces[length].pop()

    def _longest(self, most: int) -> int:
        """The greatest length at hand; none is greater than ``most``."""
        while not self.counts[most]:
            most -= 1
        return most

    def pack(self, until: int) -> None:
        """Fill windows while the pieces hold at least ``until`` ids and a whole window."""
        longest = self.window - 1
        while self.held >= max(until, self.window):
            longest = self._longest(longest)
            chosen, room = [self._take(longest)], self.window - longest
            for length, used in best_fill(self.counts, room):
                chosen.extend(self._take(length) for _ in range(used))
                room -= length * used
            if room:  # every piece left is longer than what is missing
                doc, start, ids, tokens = self._take(self._longest(longest))
                chosen.append((doc, start, ids[: 4 * room], tokens))
                self._hold((doc, start + room, ids[4 * room :], tokens))
            self._place(chosen)

    def rest(self) -> list[tuple]:
        """The pieces at hand, longest first; none is left."""
        found = [piece for some in reversed(self.pieces) for piece in some]
        self.pieces, self.counts, self.held = [[] for _ in range(self.window)], [0] * self.window, 0
        return found

    def _place(self, chosen: list[tuple]) -> None:
        offset = 0
        for piece in chosen:
            self._emit(self.sequence, offset, piece)
            offset += len(piece[2]) // 4
        self.sequence += 1

    def close(self) -> None:
        """The pieces of the last window leave without a sequence, with their ids."""
        for piece in self.rest():
            self._emit(None, 0, piece, keep=True)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*self.rows), _FIELDS)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def encode_and_pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents. Those of a task's last window have no sequence_id yet."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, coder = Packer(TaskContext.get().partitionId() << BITS, window), rank_codec(tokenizer)
        for batch in row_slices(batches, 128):
            keys, texts = ids_and_texts(batch)
            for doc, packed in zip(keys.to_pylist(), coder.encode_packed(texts)):
                packer.add(doc, packed + end)
            if packer.held >= FULL:
                packer.pack(LOW)
            yield from packer.flush()
        packer.pack(0)
        packer.close()
        yield from packer.flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, _DDL)


def pack_last_windows(pieces: DataFrame, tasks: int, window: int = WINDOW) -> DataFrame:
    """Packs the pieces that have no sequence yet, those of ``TOGETHER`` tasks in one. The
    last window of each group is shorter than the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((1 << 62) + (TaskContext.get().partitionId() << BITS), window)
        for batch in row_slices(batches, 1024):
            for row in batch.to_pylist():
                packer.add(row["doc_id"], row["ids"], row["start"], row["doc_tokens"])
            if packer.held >= FULL:
                packer.pack(LOW)
            yield from packer.flush()
        packer.pack(0)
        last = packer.rest()
        if last:
            packer._place(last)
        yield from packer.flush()

    tails = pieces.where("sequence_id IS NULL").select("doc_id", "start", "doc_tokens", "ids")
    return tails.coalesce(max(1, -(-tasks // TOGETHER))).mapInArrow(run, _DDL)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens (with the end id), sequence_id, and offset in the sequence."""
    tasks = docs.rdd.getNumPartitions()
    pieces = materialize(encode_and_pack(docs, tokenizer, end_id, window), "pieces")
    placed = pieces.where("sequence_id IS NOT NULL").union(pack_last_windows(pieces, tasks, window))
    return placed.drop("ids")
