"""A minimal acyclic transducer from words to numbers.

Words are added in sorted order; the states of a finished suffix are replaced by equal
ones that exist already, so common suffixes are stored once. Each transition carries as
its output how many words come before it among those of its state; the outputs along a
path add up to the word's number in sorted order. Numbers select rows of a flat table,
here the token ids of the word.

The automaton is three flat arrays, written to a file and mapped by every reader.
Look-ups walk many words at once, one byte position at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

_FIELDS = ("keys", "targets", "outputs", "final", "starts", "values")


def _minimal(words: Iterable[bytes]) -> tuple[list, int]:
    """States as (final, ((byte, state), ...)), children before parents, and the root."""
    states: list[tuple] = []
    known: dict[tuple, int] = {}

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path, last = [[False, []]], b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(done)))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(done)))
    return states, settle(path[0])


class Transducer:
    """Word to number to ids. Built from sorted distinct words, or opened from a file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.targets, self.outputs, self.final, self.starts, self.values = (
            arrays[field] for field in _FIELDS
        )
        self.root = int(self.final[-1])

    @classmethod
    def build(cls, words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> Transducer:
        states, root = _minimal(words)
        counts = np.zeros(len(states), dtype=np.int64)
        keys, targets, outputs = [], [], []
        for state, (final, arcs) in enumerate(states):
            before = int(final)
            for byte, target in arcs:
                keys.append(state << 8 | byte)
                targets.append(target)
                outputs.append(before)
                before += int(counts[target])
            counts[state] = before
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return cls(
            {
                "keys": np.array(keys, dtype=np.int64),
                "targets": np.array(targets, dtype=np.int64),
                "outputs": np.array(outputs, dtype=np.int64),
                "final": np.array([int(final) for final, _ in states] + [root], dtype=np.int64),
                "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
                "values": np.array([i for some in ids for i in some], dtype=np.int64),
            }
        )

    def save(self, file) -> None:
        """All arrays in one file: six lengths, then the arrays, as 64-bit integers."""
        arrays = [getattr(self, field) for field in _FIELDS]
        file.write(np.array([len(a) for a in arrays], dtype="<i8").tobytes())
        for array in arrays:
            file.write(np.ascontiguousarray(array, dtype="<i8").tobytes())

    @classmethod
    def open(cls, path: str) -> Transducer:
        flat = np.memmap(path, dtype="<i8", mode="r")
        ends = np.cumsum([len(_FIELDS), *flat[: len(_FIELDS)]])
        return cls({field: flat[a:b] for field, a, b in zip(_FIELDS, ends, ends[1:])})

    @property
    def n_states(self) -> int:
        return len(self.final) - 1

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 for those the automaton does not accept."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(lengths) - lengths
        state, total = np.full(n, self.root), np.zeros(n, dtype=np.int64)
        alive, step = np.arange(n), 0
        found = np.full(n, -1, dtype=np.int64)
        while len(alive):
            ended = lengths[alive] == step
            last = alive[ended]
            good = last[self.final[state[last]] == 1]
            found[good] = total[good]
            alive = alive[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | flat[first[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            going = self.keys[at] == key
            alive, at = alive[going], at[going]
            total[alive] += self.outputs[at]
            state[alive] = self.targets[at]
            step += 1
        return found

    def ids(self, number: int) -> tuple[int, ...]:
        return tuple(self.values[self.starts[number] : self.starts[number + 1]].tolist())
