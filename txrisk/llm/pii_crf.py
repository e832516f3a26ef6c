"""Personal data by a linear-chain conditional random field over word shapes.

The base rules label the tokens of a bounded sample of documents; that small table, with
forms that people also write and the rules miss (a phone number without its plus sign, a
card number in groups, an address with a port), trains the field. Decoding reads every
whole text: tokens become shapes, shapes become rows of score tables, and Viterbi runs in
numpy over batches of chains. A chain is a line. A line of more than CHAIN tokens is decoded
in chains that overlap by twice MARGIN; features of neighbours come from the whole line, and
a token's tag from the chain that has it MARGIN tokens or more inside, or up to the line's end.

The field adds spans to those of the base rules and never changes them. Null and empty
texts have no spans. Without any labelled token nothing is added.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import ids_and_texts, materialize, row_slices, whole_text
from txrisk.llm.pii_rules import KINDS, Span, base_spans

#: Documents of the training sample: those of the smallest hash of doc_id.
SAMPLE_DOCS = 3000
#: Labelled stretches that the field is trained on: those of the smallest hash of what they hold.
SAMPLE_ROWS = 20_000
CHAIN, MARGIN, EPOCHS, STEP, RIDGE = 192, 32, 60, 0.2, 1e-3
#: Tokens around a labelled one that enter the training table.
CONTEXT = 8
#: Shapes that a worker remembers by token before it starts afresh.
REMEMBERED = 500_000

TAGS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MIN_DIGITS = {"ip": 4, "card": 13, "phone": 9, "email": 0}


def shape(token: str) -> str:
    """Letters become a or A, digits 9, anything beyond ASCII u. Runs of letters are cut to one, of digits to
    four, or to thirteen if they are as long; stops at the end are left out."""
    core = token.rstrip(".,;:!?\"')>") or token
    if core.isalpha() and core.isascii():
        return "a" if core.islower() else "A" if core.isupper() else "Aa"
    kinds = []
    for c in core:
        kinds.append("9" if c in "0123456789" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c if c < "\x7f" else "u")
    text = "".join(kinds)
    letters = re.sub(r"([aAu])\1+", r"\1", text)
    return re.sub(r"9{4,}", lambda m: "9999" if len(m.group()) < 13 else "9" * 13, letters)


def shape_features(form: str) -> list[str]:
    """The features of one token, by its shape."""
    digits = form.count("9")
    return [
        f"s={form if len(form) <= 24 else 'long'}",
        f"d={min(digits, 13)}",
        f"first={form[:1]}",
        f"at={'@' in form},{form.count('.') if digits or '@' in form else 0}",
        f"plain={form.isalpha()}",
    ]


def tags_of(text: str, tokens: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """Tag numbers of tokens: those that a span touches begin or continue its kind."""
    tags, ordered, at = [0] * len(tokens), sorted(spans, key=lambda s: s[1]), 0
    for kind, start, end in ordered:
        while at < len(tokens) and tokens[at][1] <= start:
            at += 1
        k, begun = at, False
        while k < len(tokens) and tokens[k][0] < end:
            tags[k] = TAGS.index(f"{'I' if begun else 'B'}-{kind}")
            begun, k = True, k + 1
    return tags


def variants(tokens: list[str], tags: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    """A labelled stretch and other ways of writing it."""
    yield tokens, tags
    phone, card, ip = (TAGS.index(f"B-{kind}") for kind in ("phone", "card", "ip"))
    for at, tag in enumerate(tags):
        token = tokens[at]
        if tag == phone and token.startswith("+") and at + 1 < len(tags) and tags[at + 1] == phone + 1:
            rest = [phone, *tags[at + 2 :]]
            yield tokens[:at] + tokens[at + 1 :], tags[:at] + rest
        elif tag == card and token.isdigit():
            grouped = "-".join(token[k : k + 4] for k in range(0, len(token), 4))
            yield tokens[:at] + [grouped] + tokens[at + 1 :], tags
        elif tag == ip:
            yield tokens[:at] + [token.rstrip(".,") + ":8080"] + tokens[at + 1 :], tags


def labelled_table(docs: DataFrame, n_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(tokens, tags): stretches around the tokens that the base rules mark, and one plain
    stretch, at a place set by a hash of the text, of each sample document without them. Only n_docs ids are broadcast."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    texts = docs.select("doc_id", whole_text().alias("text"))
    rows = texts.join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id"))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            found: list[tuple[list[str], list[int]]] = []
            for text in ids_and_texts(batch)[1]:
                places = [match.span() for match in _TOKEN.finditer(text)]
                tags = tags_of(text, places, base_spans(text))
                tokens = [text[a:b] for a, b in places]
                begins = [k for k, tag in enumerate(tags) if tag % 2 == 1]
                for k in begins:
                    part = slice(max(0, k - CONTEXT), k + CONTEXT)
                    found.extend(variants(tokens[part], tags[part]))
                if not begins and tokens:
                    start = zlib.crc32(text.encode(errors="replace")) % max(1, len(tokens) - 2 * CONTEXT + 1)
                    found.append((tokens[start : start + 2 * CONTEXT], tags[start : start + 2 * CONTEXT]))
            columns = [
                pa.array([tokens for tokens, _ in found], pa.list_(pa.string())),
                pa.array([tags for _, tags in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tokens", "tags"])

    labelled = rows.select("doc_id", "text").mapInArrow(label, "tokens array<string>, tags array<int>")
    return materialize(labelled, "pii-labels")


@dataclass
class Field:
    """Weights of features for the token itself, the one before and the one after, and of tag pairs."""

    names: dict[str, int]
    weights: np.ndarray  # (3, features, tags)
    pairs: np.ndarray  # (tags, tags)

    def rows(self, form: str) -> np.ndarray:
        """Scores of a shape as the token itself, as the one before and as the one after: (3, tags)."""
        known = [self.names[f] for f in shape_features(form) if f in self.names]
        return self.weights[:, known].sum(axis=1)


def _padded(chains: list[list[list[int]]], tags: list[list[int]], width: int):
    length = max(map(len, tags))
    x = np.full((len(chains), length, width), -1)
    y, mask = np.zeros((len(chains), length), dtype=int), np.zeros((len(chains), length), dtype=bool)
    for k, (chain, own) in enumerate(zip(chains, tags)):
        x[k, : len(chain)], y[k, : len(own)], mask[k, : len(own)] = chain, own, True
    return x, y, mask


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def train(table: list[tuple[list[str], list[int]]]) -> Field:
    """Maximum likelihood by AdaGrad over the whole table; the table is the bounded sample."""
    names: dict[str, int] = {}
    width = len(shape_features("a"))
    coded = [[[names.setdefault(f, len(names)) for f in shape_features(shape(t))] for t in tokens] for tokens, _ in table]
    x, y, mask = _padded(coded, [tags for _, tags in table], width)
    n, length, k, blank = len(table), x.shape[1], len(TAGS), len(names)
    x = np.where(x < 0, blank, x)
    before, after = np.full_like(x, blank), np.full_like(x, blank)
    before[:, 1:], after[:, :-1] = x[:, :-1], x[:, 1:]
    sides = [x, before, after]
    weights, pairs = np.zeros((3, blank + 1, k)), np.zeros((k, k))
    seen_w, seen_p = np.full_like(weights, 1e-6), np.full_like(pairs, 1e-6)
    gold = np.eye(k)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    for _ in range(EPOCHS):
        scores = sum(weights[s][sides[s]].sum(axis=2) for s in range(3))
        forward, backward = np.zeros((n, length, k)), np.zeros((n, length, k))
        forward[:, 0] = scores[:, 0]
        for t in range(1, length):
            step = _log_sum(forward[:, t - 1, :, None] + pairs, 1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = _log_sum(pairs[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
        whole = _log_sum(forward[:, -1], 1)
        marginal = np.exp(forward + backward - whole[:, None, None]) * mask[..., None]
        expected = np.zeros((k, k))
        for t in range(1, length):
            joint = forward[:, t - 1, :, None] + pairs + (scores[:, t] + backward[:, t])[:, None, :] - whole[:, None, None]
            expected += np.exp(joint[both[:, t - 1]]).sum(axis=0)
        rest, slope = gold - marginal, np.zeros_like(weights)
        for s in range(3):
            for f in range(width):
                np.add.at(slope[s], sides[s][..., f].ravel(), rest.reshape(-1, k))
        slope[:, blank] = 0
        slope -= RIDGE * weights
        slope_p = gold_pairs - expected - RIDGE * pairs
        seen_w += slope**2
        seen_p += slope_p**2
        weights += STEP * slope / np.sqrt(seen_w)
        pairs += STEP * slope_p / np.sqrt(seen_p)
    # A tag that continues a span cannot follow another kind or stand outside one.
    for tag in range(2, k, 2):
        barred = [other for other in range(k) if other not in (tag, tag - 1)]
        pairs[barred, tag] = -1e4
    return Field(names, weights[:, :blank], pairs)


class Tagger:
    """Decoder of one worker: score tables by shape and the shapes of tokens met so far."""

    def __init__(self, field: Field):
        self.field = field
        self.shapes: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.tables = np.zeros((1024, 3, len(TAGS)))

    def number(self, token: str) -> int:
        form = shape(token)
        known = " ".join(shape_features(form)) if len(form) > 48 else form  # short, however long the token
        if known not in self.shapes:
            if len(self.shapes) == len(self.tables):
                self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)])
            self.tables[len(self.shapes)] = self.field.rows(form)
            self.shapes[known] = len(self.shapes)
        if len(token) <= 64:
            self.tokens[token] = self.shapes[known]
        return self.shapes[known]

    def reset(self) -> None:
        if len(self.tokens) > REMEMBERED or len(self.shapes) > REMEMBERED // 5:
            self.tokens.clear()
            self.shapes.clear()

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each line."""
        self.reset()
        get, number = self.tokens.get, self.number
        coded = [np.array([number(t) if (k := get(t)) is None else k for t in line], dtype=np.int64) for line in lines]
        found = [np.zeros(len(line), dtype=np.int64) for line in coded]
        chains = [(k, *place) for k, line in enumerate(coded) for place in _places(len(line))]
        chains.sort(key=lambda c: c[2] - c[1])
        for first in range(0, len(chains), 1024):
            part = chains[first : first + 1024]
            left = np.array([coded[k][low - 1] if low else -1 for k, low, *_ in part], dtype=np.int64)
            right = np.array([coded[k][high] if high < len(coded[k]) else -1 for k, _, high, *_ in part], dtype=np.int64)
            tags = self._viterbi([coded[k][low:high] for k, low, high, *_ in part], left, right)
            for (k, low, _, begin, end), own in zip(part, tags):
                found[k][begin:end] = own[begin - low : end - low]
        return found

    def _viterbi(self, coded: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
        """``left`` and ``right``: the shapes beside a chain in its line, -1 at the line's ends."""
        lengths, pairs = np.array([len(c) for c in coded]), self.field.pairs
        n, length, k = len(coded), int(lengths.max(initial=0)), len(TAGS)
        if not length:
            yield from (np.empty(0, dtype=np.int64) for _ in coded)
            return
        mask = np.arange(length) < lengths[:, None]
        own, before, after = (self.tables[np.concatenate(coded), s] for s in range(3))
        scores, first = np.zeros((n, length, k)), np.zeros((n, length, k))
        scores[mask] = own
        first[mask] = before
        scores[:, 1:] += first[:, :-1] * mask[:, 1:, None]
        first[mask] = after
        scores[:, :-1] += first[:, 1:] * mask[:, 1:, None]
        scores[left >= 0, 0] += self.tables[left[left >= 0], 1]
        inner = np.flatnonzero(right >= 0)
        scores[inner, lengths[inner] - 1] += self.tables[right[inner], 2]
        best = scores[:, 0].copy()
        best[left < 0, 2::2] = -1e4  # no line begins inside a span
        back = np.empty((length, n, k), dtype=np.int8)
        for t in range(1, length):
            reached = best[:, :, None] + pairs
            back[t] = reached.argmax(axis=1)
            step = np.take_along_axis(reached, back[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[:, t]
            best = np.where(mask[:, t, None], step, best)
        tags = np.zeros((n, length), dtype=np.int64)
        last = best.argmax(axis=1)
        for t in range(length - 1, -1, -1):
            ended = t == lengths - 1
            now = np.where(ended, best.argmax(axis=1), last)
            tags[:, t] = now
            if t:
                last = np.where(t < lengths, back[t][np.arange(n), now], last)
        for row, size in zip(tags, lengths):
            yield row[:size]


def _added(text: str, start: int, tags: np.ndarray, taken: list[Span]) -> Iterator[Span]:
    """Spans of a decoded line that meet no span of the base rules. ``start``: where the line begins."""
    at, places = start, []
    for match in _TOKEN.finditer(text, at):
        if len(places) == len(tags):
            break
        places.append(match.span())
    k = 0
    while k < len(tags):
        if tags[k] == 0:
            k += 1
            continue
        kind, low = KINDS[(int(tags[k]) - 1) // 2], k
        k += 1
        while k < len(tags) and tags[k] and tags[k] % 2 == 0 and KINDS[(int(tags[k]) - 1) // 2] == kind:
            k += 1
        begin, end = places[low][0], places[k - 1][1]
        body = text[begin:end].rstrip(".,;:!?\"'>")
        end = begin + len(body)
        if sum(c in "0123456789" for c in body) < _MIN_DIGITS[kind] or (kind == "email" and "@" not in body):
            continue
        if all(end <= a or b <= begin for _, a, b in taken):
            yield kind, begin, end


def _places(n: int) -> Iterator[tuple[int, int, int, int]]:
    """Chains of a line of n tokens: where each begins and ends, and the part whose tags it gives."""
    begin = 0
    while begin < n:
        low = max(0, begin - MARGIN)
        high = min(n, low + CHAIN)
        end = n if high == n else high - MARGIN
        yield low, high, begin, end
        begin = end


def _lines(text: str) -> Iterator[tuple[int, list[str]]]:
    """Where each line begins in the text, and its tokens."""
    at = 0
    for line in text.split("\n"):
        tokens = _TOKEN.findall(line)
        if tokens:
            yield at, tokens
        at += len(line) + 1


_TAGGERS: dict[str, Tagger] = {}


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, by kind as listed and then by start."""
    cut = [list(_lines(text)) for text in texts]
    tags = iter(tagger.decode([tokens for lines in cut for _, tokens in lines]))
    found = []
    for text, lines in zip(texts, cut):
        base = base_spans(text)
        more = []
        for start, _ in lines:
            own = next(tags)
            if own.any():
                more.extend(_added(text, start, own, base))
        found.append((base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return found


def find_personal_data(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) for every document."""
    name = uuid.uuid4().hex
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[name] = Tagger(field) if field else None
        tagger = _TAGGERS[name]
        for batch in row_slices(batches, 128):
            keys, texts = ids_and_texts(batch)
            if tagger:
                found = all_spans(texts, tagger)
            else:
                found = [(spans, spans) for spans in map(base_spans, texts)]
            columns = [
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in pair[side]] for pair in found], pa.list_(span))
                for side in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(find, f"doc_id long, base {kind}, spans {kind}")


def fit(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_rows: int = SAMPLE_ROWS) -> Field | None:
    """A field trained on the labelled table of the sample, n_rows of it; None if no token is labelled."""
    order = (F.xxhash64("tokens", "tags"), "tokens", "tags")
    rows = labelled_table(docs, n_docs).orderBy(*order).limit(n_rows).collect()
    table = sorted((row.tokens, row.tags) for row in rows)
    return train(table) if any(tag for _, tags in table for tag in tags) else None
