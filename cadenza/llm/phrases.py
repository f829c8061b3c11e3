"""Terms of texts, and sets of phrases that are found in them by hash and confirmed by bytes.

A term is a run of ASCII letters and digits and of characters beyond ASCII; only A-Z are
lower-cased. Every other byte becomes a space first, so :class:`Words` does the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textarrays import Words, flat

_letters = [*range(48, 58), *range(97, 123), *range(128, 256)]
TERM = np.full(256, 32, np.uint8)
TERM[_letters] = _letters
TERM[65:91] = np.arange(97, 123)


def terms(column: pa.Array) -> Words:
    """Terms of each text; a null text has none."""
    data, offsets = flat(column)
    return Words(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(TERM[data])))


def same(a: Words, at: np.ndarray, b: Words, to: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words of ``a`` from ``at[i]`` on are those of ``b`` from ``to[i]`` on, byte by byte."""
    ok = np.ones(len(at), bool)
    for j in range(n):
        i = np.flatnonzero(ok)
        x, y = a.start[at[i] + j], b.start[to[i] + j]
        size = a.end[at[i] + j] - x
        equal = size == b.end[to[i] + j] - y
        ok[i[~equal]] = False
        i, x, y, size = i[equal], x[equal], y[equal], size[equal]
        if len(i):
            first = np.cumsum(size) - size
            inside = np.arange(size.sum()) - np.repeat(first, size)
            differ = a.data[np.repeat(x, size) + inside] != b.data[np.repeat(y, size) + inside]
            ok[i[np.add.reduceat(differ.astype(np.int64), first) > 0]] = False
    return ok


class Phrases:
    """The distinct ones of some phrases of ``n`` words of ``words``, numbered from 0.

    ``number[i]`` is that of the phrase that starts at ``at[i]``. Phrases whose hashes collide
    lie in further layers, so every phrase is found and nothing else is."""

    def __init__(self, words: Words, at: np.ndarray, n: int):
        self.words, self.n, self.size = words, n, 0
        self.number = np.full(len(at), -1, np.int64)
        self.layers: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
        hashes, left = words.grams(n)[0][at], np.arange(len(at))
        while len(left):
            key, first, inverse = np.unique(hashes[left], return_index=True, return_inverse=True)
            places = at[left[first]]
            equal = same(words, at[left], words, places[inverse], n)
            self.number[left[equal]] = self.size + inverse[equal]
            self.layers.append((key, places, self.size, self._marks(key)))
            self.size += len(key)
            left = left[~equal]

    @staticmethod
    def _marks(key: np.ndarray) -> np.ndarray:
        """A bit per low end of a hash, which most windows of a text fail."""
        marks = np.zeros(1 << max(10, int(16 * len(key)).bit_length()), bool)
        marks[key & np.uint64(len(marks) - 1)] = True
        return marks

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word that it starts with, number) of every occurrence in ``words``."""
        grams, inside = words.grams(self.n)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for key, places, base, marks in self.layers:
            at = np.flatnonzero(inside & marks[grams & np.uint64(len(marks) - 1)])
            k = np.minimum(np.searchsorted(key, grams[at]), len(key) - 1)
            hit = key[k] == grams[at]
            at, k = at[hit], k[hit]
            hit = same(words, at, self.words, places[k], self.n)
            found.append((at[hit], base + k[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
