"""Byte-level BPE: encoding through a lexicon of frequent words, exact merges, decoding.

Word counts over all documents choose the frequent words; a minimal acyclic transducer
maps them to their ids and is mapped into memory by every task. Words it does not know
are merged exactly, pair by pair, in the order of the tokenizer's merges. The ids are
those of the tokenizers library without special tokens added; strings of the
vocabulary's special tokens inside a text are encoded as these tokens, as it does.

The lexicon only saves time: any lexicon, an empty one included, gives the same ids.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import ids_and_texts, materialize, publish, row_slices, shared_file, whole_text
from txrisk.llm.transducer import Transducer

#: A word enters the lexicon if it makes up this share of all words, so at most 1 / share enter.
FREQUENT_SHARE = 2e-6
#: Words that a worker remembers, and counts that it holds, before it starts afresh.
REMEMBERED = 300_000
#: Longer words, in letters, are not remembered.
LONGEST = 64
#: Symbols from which a word is merged with a heap instead of repeated scans.
LONG_WORD = 40

# The published word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The Unicode white space characters, which \s stands for in the pattern.
WHITE = "\t-\r \x85\xa0  -     　"
_WORD = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
# The same for texts of the first 256 characters; the plainer classes are quicker.
_LATIN = {r"\p{L}": r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r \x85\xa0"}
_LATIN_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+".replace("L", _LATIN[r"\p{L}"])
    .replace("N]", _LATIN[r"\p{N}"] + "]")
    .replace("S", _LATIN[r"\s"])
)


def words_of_text(text: str) -> list[str]:
    """The words of the vocabulary's pattern; joined they give the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return _LATIN_WORD.findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand
    for themselves, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, vocab = byte_letters(), content["model"]["vocab"]
        self.single = [vocab[letter] for letter, _ in sorted(letters.items(), key=lambda item: item[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, number in vocab.items():
            self.token_bytes[number] = bytes(letters[c] for c in token) if set(token) <= set(letters) else token.encode()
        for token, number in self.special.items():
            self.token_bytes[number] = token.encode()
        longest = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest))) if longest else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact ids of one word: the pair of the lowest rank first, leftmost among equals."""
        symbols = [self.single[byte] for byte in word]
        return tuple(self._scan(symbols) if len(symbols) < LONG_WORD else self._heap(symbols))

    def _scan(self, symbols: list[int]) -> list[int]:
        merges = self.merges
        while len(symbols) > 1:
            best, at = None, 0
            for k in range(len(symbols) - 1):
                found = merges.get((symbols[k], symbols[k + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, k
            if best is None:
                break
            symbols[at : at + 2] = [best[1]]
        return symbols

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same for long words, in n log n: a linked list and a heap of (rank, place)."""
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                found = merges.get((symbols[k], symbols[after[k]]))
                if found is not None:
                    heapq.heappush(heap, (found[0], k, symbols[k], symbols[after[k]], found[1]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            if symbols[k] != left or after[k] < 0 or symbols[after[k]] != right:
                continue
            gone = after[k]
            symbols[k], symbols[gone] = new, -1
            after[k] = after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [symbol for symbol in symbols if symbol >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; special tokens give their strings, broken UTF-8 the replacement character."""
        table = self.token_bytes
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", errors="replace")


class Codec:
    """Encoder of one worker: vocabulary, mapped lexicon, and the words met so far."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.words: dict[str, bytes] = {}  # ids as packed 32-bit integers

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        unknown = [word for word in words if word not in self.words]
        if not unknown:
            return
        coded = [word.encode() for word in unknown]
        numbers = self.lexicon.numbers(coded) if self.lexicon else np.full(len(coded), -1)
        for word, raw, number in zip(unknown, coded, numbers.tolist()):
            ids = self.lexicon.ids(number) if number >= 0 else self.vocabulary.merge(raw)
            self.words[word] = array("i", ids).tobytes()

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, and special tokens with their ids."""
        pattern, at = self.vocabulary.special_pattern, 0
        if pattern is not None:
            for match in pattern.finditer(text):
                if match.start() > at:
                    yield text[at : match.start()], None
                yield match.group(), self.vocabulary.special[match.group()]
                at = match.end()
        if at < len(text):
            yield text[at:], None

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        cut = [
            [(None if special is not None else words_of_text(part), special) for part, special in self._segments(text)]
            for text in texts
        ]
        met = {word for parts in cut for words, _ in parts if words for word in words}
        self._learn(met)
        known = self.words.__getitem__
        packed = [
            b"".join(
                np.int32(special).tobytes() if words is None else b"".join(map(known, words))
                for words, special in parts
            )
            for parts in cut
        ]
        for word in met:
            if len(word) > LONGEST:
                del self.words[word]
        return packed

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(packed, dtype="<i4").tolist() for packed in self.encode_packed(texts)]


_VOCABULARIES: dict[str, Vocabulary] = {}
_CODECS: dict[tuple[str, str | None], Codec] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def codec(path: str, lexicon: str | None) -> Codec:
    """The codec of this worker, kept between tasks; only the latest one is kept."""
    if (path, lexicon) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, lexicon] = Codec(vocabulary(path), Transducer.open(lexicon) if lexicon else None)
    return _CODECS[path, lexicon]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all whole texts; counts combine in the task before they are shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in row_slices(batches, 64):
            for text in ids_and_texts(batch)[1]:
                words.update(words_of_text(text))
            if len(words) > REMEMBERED:
                yield flush()
        if words:
            yield flush()

    counted = docs.select("doc_id", whole_text().alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, share: float = FREQUENT_SHARE) -> str:
    """Compile the frequent words of a corpus and return the file of the automaton.

    The driver receives at most 1 / share words and the total.
    """
    spark, counts = docs.sparkSession, materialize(word_counts(docs), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= F.lit(max(total * share, 1.0))).select(F.encode("word", "UTF-8").alias("w"))
    words = sorted(bytes(row.w) for row in rows.toLocalIterator())
    known = vocabulary(tokenizer)
    automaton = Transducer.build(words, [known.merge(word) for word in words])
    path = shared_file(spark, "lexicon")
    publish(path, automaton.save)
    return path


def _encoder(tokenizer: str, lexicon: str | None):
    """Batches of doc_id and text to batches of doc_id and ids."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer, lexicon)
        for batch in row_slices(batches, 256):
            keys, texts = ids_and_texts(batch)
            packed = coder.encode_packed(texts)
            ends = np.cumsum([0, *(len(ids) // 4 for ids in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([keys, ids], ["doc_id", "ids"])

    return encode


def _decoder(tokenizer: str):
    """Batches of doc_id and ids to batches with the decoded text beside them."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer)
        for batch in row_slices(batches):
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
            texts = [known.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
            )

    return decode


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str | None) -> DataFrame:
    """doc_id and the ids of each whole text; a null or empty text has none."""
    return _rows(docs).mapInArrow(_encoder(tokenizer, lexicon), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds the decoded ``text`` to rows of doc_id and ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(tokenizer), "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, tokenizer: str, lexicon: str | None) -> DataFrame:
    """What decode_documents gives for encode_documents, in one worker a task instead of two."""
    encode, decode = _encoder(tokenizer, lexicon), _decoder(tokenizer)
    return _rows(docs).mapInArrow(lambda batches: decode(encode(batches)), "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Count and checksums of ids and decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
