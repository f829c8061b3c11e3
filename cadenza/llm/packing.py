"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A document longer than the sequence is cut into full pieces, the first of which may be
shorter. Pieces that fill a sequence are sequences of their own; the others are dealt at
random to shards of bounded size, and each shard places its pieces, longest first, where the
sum over residual gaps of the squared number of open bins with that gap becomes smallest.
Only (id, piece, length) rows are written and shuffled, never tokens.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .textarrays import chunks

CAPACITY, SHARD_PIECES = 1024, 8_000
END_ID = 2
NEVER = np.iinfo(np.int64).max


class Encoder:
    """Ids of the byte-level vocabulary in the JSON file at ``path``, with a memo of short units.

    A unit is a run of white space and what follows it up to the next white space. The
    vocabulary's pattern never joins a character that is not white space to white space after
    it, so the ids of a text are those of its units. Units that the memo lacks are encoded
    together, as one text; the byte lengths of the tokens tell where each of them ends. Texts
    with white space outside ASCII, and controls that count as such elsewhere, are one unit.
    """

    UNIT = re.compile(r"[ \t\n\r\v\f]*[^ \t\n\r\v\f]+|[ \t\n\r\v\f]+")
    OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
    LONGEST_UNIT, MOST_UNITS = 64, 500_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # each character of a token stands for one byte
            self.bytes_of[i] = len(token)
        self.memo: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: set[str], odd: set[str]) -> None:
        plain = [u for u in units if u[0] <= " " < u[-1] and u not in odd]
        if plain:
            ids = np.array(self._ids(["".join(plain)])[0], "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            sizes = np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in plain), np.int64, len(plain))
            cuts = (4 * np.searchsorted(ends, np.cumsum(sizes)) + 4).tolist()
            data, at = ids.tobytes(), 0
            for u, to in zip(plain, cuts, strict=True):
                self.memo[u] = data[at:to]
                at = to
        other = list(units.difference(plain))
        self.memo.update(zip(other, (np.array(ids, "<u4").tobytes() for ids in self._ids(other)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, 32 bits each."""
        odd = {t for t in texts if self.OTHER_SPACE.search(t)}
        units = [[t] if t in odd else self.UNIT.findall(t) for t in texts]
        new = set().union(*units).difference(self.memo)
        self._learn(new, odd)
        known = self.memo.__getitem__
        out = [np.frombuffer(b"".join(map(known, own)), "<u4") for own in units]
        if len(self.memo) > self.MOST_UNITS:
            self.memo.clear()
        else:
            for u in new:
                if len(u) > self.LONGEST_UNIT:
                    del self.memo[u]
        return out


_encoders: dict[str, Encoder] = {}


def token_ids(texts: list[str | None], path: str, end: int = END_ID) -> list[np.ndarray]:
    """Ids of each text and the closing id, 32 bits each."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return [np.append(ids, np.array([end], "<u4")) for ids in _encoders[path].encode([t or "" for t in texts])]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; all but the first are full."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def _pieces(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for part in chunks(batches):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), token_ids(part.column("text").to_pylist(), path), strict=True):
                rows += [(doc_id, seen, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                seen += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length in the order given, and the number of bins.

    Of the gaps that the piece fits, the choice is the one that makes the sum of squares
    smallest; ties go to the tightest fit. A bin is opened only where no open one fits,
    which with lengths in falling order needs fewer bins than letting the sum decide this too.
    """
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, np.int64)
    bin_of, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # moving a bin from gap g to gap g - n changes the sum by 2 (N[g - n] - N[g]) + 2; closed bins don't count
        before, after = open_[n:], open_[: capacity + 1 - n]
        change = 2 * (after - before) + 2
        change[0] = 1 - 2 * before[0]
        change[before == 0] = NEVER
        best = int(np.argmin(change))
        if change[best] == NEVER:
            best = capacity - n
        gap = best + n
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = bins[gap].pop()
            open_[gap] -= 1
        bin_of[i], offset[i] = bin_, capacity - gap
        if best:
            bins[best].append(bin_)
            open_[best] += 1
    return bin_of, offset, made


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bin_of, offset, _ = sum_of_squares(table["length"].to_numpy(), capacity)
        ids = pc.add(pc.multiply(table["shard"], pa.scalar(1 << 32, pa.int64())), pa.array(bin_of))
        return table.drop_columns(["shard"]).append_column("sequence_id", ids).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``doc_id, copy, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    ``tokenizer`` is the path of the JSON file of a byte-level vocabulary. Sequences hold at
    most ``capacity`` tokens without gaps. ``copy`` is one number per row of ``docs``, the same
    for all its pieces, so rows that repeat a ``doc_id`` are told apart.

    * null and empty texts are one piece of the closing id; texts of any length are encoded whole
    * null ids are packed as they come; rows that repeat are packed each, and are dealt to
      shards one by one, so no id makes a shard large
    * an empty table gives an empty result; other columns are ignored
    """
    names = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(rows.mapInArrow(_pieces(tokenizer, capacity), names), "pieces")
    part = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_pieces))
    # the written table's rows keep their numbers when a task runs again
    placed = (
        part.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_pack(capacity), names + ", sequence_id long, offset long")
    )
    full = pieces.filter(F.col("length") == capacity)
    return placed.union(full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
