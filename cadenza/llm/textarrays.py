"""Texts of an Arrow batch as flat numpy arrays: words, word hashes and n-gram hashes.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; these bytes never occur inside a
multi-byte UTF-8 character, so words of bytes are words of characters. Hashes are 64 bits
wide and equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = {b: np.ones(1, np.uint64) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))}
INVERSE = list(_powers)[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """At least ``n`` powers of ``base``, from the zeroth on, modulo 2^64."""
    if len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 2 * len(_powers[base])), base)], dtype=np.uint64)
    return _powers[base]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (one row at least), so that
    the arrays derived from them stay small whatever the batch size is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(flat(batch.column(column))[1])
        part = np.cumsum(sizes) // most
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; a null text is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of some texts. ``first[i]:first[i + 1]`` are those of text ``i``; ``start``, ``end``
    are byte positions in ``data``; ``hash`` has one value per word."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = flat(column)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (upper * np.uint8(32))
        solid = ~SPACE[self.data]
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(solid))]
        begin[inner] = solid[inner]
        stop[inner - 1] = solid[inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        self.hash = self._hashes()
        self._running: np.ndarray | None = None

    def _hashes(self, step: int = 4_000_000) -> np.ndarray:
        size = self.end - self.start
        out = np.zeros(len(size), np.uint64)
        total = np.cumsum(size)
        cuts = np.r_[0, np.flatnonzero(np.diff(total // step)) + 1, len(size)] if len(size) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = size[a:b]
            at = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(at, n)
            byte = self.data[np.repeat(self.start[a:b], n) + inside].astype(np.uint64) + np.uint64(1)
            out[a:b] = np.add.reduceat(byte * powers(int(n.max()) + 1)[inside], at)
        return mix(out + ODD)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they lie in one text.

        The hash rolls: it is the difference of two running sums of words times powers of the
        base, brought back to the first power, whatever ``n`` is."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        if self._running is None:
            self._running = np.r_[np.uint64(0), np.cumsum(self.hash * powers(len(self.hash))[: len(self.hash)], dtype=np.uint64)]
        g = (self._running[n:] - self._running[:m]) * powers(m, INVERSE)[:m]
        return mix(g + np.uint64(n)), self.doc[:m] == self.doc[n - 1 :]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i, 0 where there are none."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
