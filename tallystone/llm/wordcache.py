"""Texts as code points in numpy, and a cache from words to lists of token ids.

Words are found by a 64-bit hash and told apart by a second, independent one, so that no word takes the ids of another
with the same first hash. Both hashes have seeds that a process draws anew. The words' slots are in a table with open
addressing; a word without a place among PROBES is encoded each time that it comes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np

from .common import byte_hash_lanes

#: Code points that one numpy step works on; a longer text makes its own step.
POINTS = 1 << 18
#: Words that a cache keeps; a fuller one starts anew, which costs time and changes nothing else.
WORDS = 1_500_000
#: The table has 2**TABLE_BITS places.
TABLE_BITS, PROBES = 22, 12


def text_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = total = 0
    for k, t in enumerate(texts):
        if k > i and total + len(t) > POINTS:
            yield i, k
            i, total = k, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of some texts, and len + 1 offsets."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *map(len, texts)])


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of values[start : start + length]."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[np.arange(total) + shift]


_SEEDS = [int.from_bytes(os.urandom(7), "little") for _ in range(2)]
Encode = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word [start, end) of the points. Points take as few bytes as the greatest needs; seeds tell sizes apart."""
    top = int(points.max()) if len(points) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    data = points.astype(f"u{size}").view(np.uint8)
    first, second = byte_hash_lanes(data, size * starts, size * ends, tuple(s + size for s in _SEEDS))
    return first, second


class WordCache:
    """Encodes words once: encode gets new words (start and end offsets) and returns flat ids and their counts."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros(1 << TABLE_BITS, np.int32)  # slot + 1, or 0
        self.rows = np.zeros((1 << 16, 4), np.uint64)  # by slot: both hashes, where its ids start, how many there are
        self.n = 0
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def lookup(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words [start, end) of points, flat, and each word's number of ids."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        key, check = word_keys(points, starts, ends)
        if self.n > WORDS:
            self._clear()
        # one row a word is read: most words are in their first place
        place = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        found = self.table[place]
        rows = self.rows[np.maximum(found, 1) - 1]
        known = (rows[:, 0] == key) & (rows[:, 1] == check) & (found > 0)
        live = np.flatnonzero(~known)
        miss = live[found[live] == 0]
        live = live[found[live] > 0]
        for probe in range(1, PROBES + 1):
            if not len(live):
                break
            if probe == PROBES:
                miss = np.concatenate([miss, live])
                break
            found = self.table[(place[live] + probe) & ((1 << TABLE_BITS) - 1)]
            miss, live, found = np.concatenate([miss, live[found == 0]]), live[found > 0], found[found > 0]
            more = self.rows[found - 1]
            same = (more[:, 0] == key[live]) & (more[:, 1] == check[live])
            rows[live[same]] = more[same]
            live = live[~same]
        if len(miss):
            order = miss[np.lexsort((check[miss], key[miss]))]
            new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])])
            first = order[new]
            rows[order] = self._add(key[first], check[first], *encode(starts[first], ends[first]))[np.cumsum(new) - 1]
        lengths = rows[:, 3].astype(np.int64)
        return ragged(self.ids, rows[:, 2].astype(np.int64), lengths), lengths

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The new words' rows."""
        n, used = self.n + len(counts), self.used + len(ids)
        if n > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.n], np.zeros((2 * n - self.n, 4), np.uint64)])
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * used - self.used, np.int32)])
        self.ids[self.used : used] = ids
        out = self.rows[self.n : n]
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = keys, checks, self.used + np.cumsum(counts) - counts, counts
        place, left = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.arange(self.n, n)
        self.n, self.used = n, used
        for _ in range(PROBES):
            free = self.table[place] == 0
            self.table[place[free]] = left[free] + 1
            go = self.table[place] != left + 1  # taken, or lost to another new word
            place, left = (place[go] + 1) & ((1 << TABLE_BITS) - 1), left[go]
            if not len(left):
                break
        return out
