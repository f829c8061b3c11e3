"""Alignment of the tokens of two tokenizers by byte offsets where both end a token.

Cumulative ends of either list go to a dictionary from end to index; the keys that both hold,
in order, slice the two lists of ids into groups, and each group links its ids with one
another. Texts are cut into units first, where no token of either vocabulary can cross: before
a space or line feed that follows what is no white space. A worker aligns each unit it doesn't
remember once, many of them in one pass, and sums units per document.

How many documents hold a pair of ids linked is counted by Spark. Counts come back in two
ways: of the pairs that very many documents hold, as many as a broadcast of bounded size
takes; of all others by a join on the pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .textarrays import chunks

#: Pairs whose counts are broadcast at most, and what a worker remembers at most.
MOST_PAIRS, MOST_UNITS, MOST_LINKS = 1_000_000, 300_000, 4_000_000
#: A group with more links counts its distinct ids first.
WIDE = 4096
B_BITS = np.int64(32)
SPACE_MARK = "▁"
ALIGNED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Ids by the byte-level vocabulary at ``path``; special tokens in texts are plain text. ``bytes[id]`` are a token's."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary, byte = self.tokenizer.get_vocab(with_added_tokens=False), byte_of_character()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte for c in token):
                self.bytes[i] = bytes(byte[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokenizer:
    """Ids by the sentence-piece model at ``path``, of texts that start with the space that the model adds.

    ``cuttable``: no piece holds a space mark or a line feed after another character, so no piece crosses a unit's start."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of units; after a line feed no space is added to them, and the two tokens of the one put before go again."""
        if not self.cuttable:
            return self.model.encode([t[1:] for t in texts], num_threads=1)
        return [own[2:] for own in self.model.encode([f"\n{t}" for t in texts], num_threads=1)]


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indexes after the tokens at whose ends both lists end one; ``a`` and ``b`` are cumulative ends."""
    of_a, of_b = dict(zip(a, range(1, len(a) + 1), strict=True)), dict(zip(b, range(1, len(b) + 1), strict=True))
    ends = sorted(of_a.keys() & of_b.keys())
    return [of_a[e] for e in ends], [of_b[e] for e in ends]


def links(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the links of groups that end before ``to_a`` and ``to_b``; a pair is a packed number."""
    from_a, from_b = np.r_[0, to_a[:-1]], np.r_[0, to_b[:-1]]
    n_a, n_b = to_a - from_a, to_b - from_b
    n = n_a * n_b
    few = np.flatnonzero(n <= WIDE)
    group = np.repeat(few, n[few])
    k = np.arange(len(group)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
    pair = (a[from_a[group] + k // n_b[group]] << B_BITS) | b[from_b[group] + k % n_b[group]]
    groups, pairs, times = [group], [pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(n > WIDE).tolist():
        (u, m), (v, o) = (np.unique(x, return_counts=True) for x in (a[from_a[g] : to_a[g]], b[from_b[g] : to_b[g]]))
        pairs.append(((u[:, None] << B_BITS) | v[None, :]).ravel())
        times.append((m[:, None] * o[None, :]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return tuple(np.concatenate(x) for x in (groups, pairs, times))


class Aligner:
    """Alignment of units, remembered. ``stats[c]``: tokens of either side, groups and links of the unit with code ``c``,
    and whether both sides give its bytes; ``text[c]``: its groups; ``pairs[first[c]:first[c + 1]]``: its links."""

    ODD_SPACE = re.compile(r"[^\S \n]")
    UNIT = re.compile(r"[ \n]+[^ \n]*")
    CUT = re.compile(r"(?<=\S)(?=[ \n])")

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[str] = []
        self.stats, self.pairs, self.times, self.first = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        """Units of a text that starts with a space."""
        if not self.b.cuttable:
            return [text]
        return self.CUT.split(text) if self.ODD_SPACE.search(text) else self.UNIT.findall(text)

    def learn(self, units: list[str]) -> None:
        joined, alone = [], []
        for u in units:
            (alone if u[-1].isspace() or SPACE_MARK in u else joined).append(u)
        # the joined ones are one text, whose tokens fall apart at the units' ends; the others are texts of their own
        ids_a, ids_b = ([x for own in t.encode(["".join(joined)] if joined else []) for x in own] for t in (self.a, self.b))
        more_a, more_b = self.a.encode(alone), self.b.encode(alone)
        if b"".join(map(self.a.bytes.__getitem__, ids_a)) != (raw := "".join(joined).encode()) or b"".join(map(self.b.bytes.__getitem__, ids_b)) != raw:
            more_a, more_b, alone, joined, ids_a, ids_b = [*self.a.encode(joined), *more_a], [*self.b.encode(joined), *more_b], [*joined, *alone], [], [], []
        good = [b"".join(map(self.a.bytes.__getitem__, x)) == (raw := u.encode()) == b"".join(map(self.b.bytes.__getitem__, y)) and bool(raw) for u, x, y in zip(alone, more_a, more_b, strict=True)]
        kept = [*joined, *(u for u, ok in zip(alone, good, strict=True) if ok)]
        a = np.array([*ids_a, *(i for own, ok in zip(more_a, good, strict=True) if ok for i in own)], np.int64)
        b = np.array([*ids_b, *(i for own, ok in zip(more_b, good, strict=True) if ok for i in own)], np.int64)
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        to_a, to_b = (np.array(x, np.int64) for x in common_ends(end_a.tolist(), end_b.tolist()))
        unit_end = np.cumsum([len(u.encode()) for u in kept]) if kept else np.zeros(0, np.int64)
        # units end where both sides end a token: groups, tokens and links of each follow from the ends
        group_to = np.searchsorted(end_a[to_a - 1], unit_end) + 1 if kept else np.zeros(0, np.int64)
        group, pair, times = links(a, b, to_a, to_b)
        order = np.argsort(group, kind="stable")
        group, pair, times = group[order], pair[order], times[order]
        link_to = np.searchsorted(group, group_to)
        total = np.r_[0, np.cumsum(times)]
        whole = np.zeros((len(kept), 5), np.int64)
        if kept:
            after = np.stack([to_a[group_to - 1], to_b[group_to - 1], group_to, total[link_to], np.cumsum(np.ones(len(kept), np.int64))], axis=1)
            whole = np.diff(after, axis=0, prepend=np.zeros((1, 5), np.int64))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cut_a, cut_b = [0, *to_a.tolist()], [0, *to_b.tolist()]
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:], strict=True)]
        upto = [0, *group_to.tolist()]
        self.text += [";".join(groups[i:j]) for i, j in zip(upto[:-1], upto[1:], strict=True)]
        bad = [u for u, ok in zip(alone, good, strict=True) if not ok]
        self.text += [""] * len(bad)
        self.code.update(zip([*kept, *bad], range(len(self.stats), len(self.stats) + len(units)), strict=True))
        self.stats = np.concatenate([self.stats, whole, np.zeros((len(bad), 5), np.int64)])
        self.first = np.concatenate([self.first, len(self.pairs) + link_to, np.full(len(bad), len(self.pairs) + len(pair))])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Per text: tokens of either side, groups and links; the digest of its groups; its distinct pairs in order, and how often each."""
        if len(self.code) > MOST_UNITS or len(self.pairs) > MOST_LINKS:
            self.forget()
        lists = [self.units(f" {t}") if t else [] for t in texts]
        if new := set().union(*lists).difference(self.code):
            self.learn(list(new))
        nothing = np.zeros(0, np.int64)
        for units in lists:
            codes = np.fromiter(map(self.code.__getitem__, units), np.int64, len(units))
            stats = self.stats[codes].sum(axis=0)
            if not len(codes) or stats[4] < len(codes):
                yield np.zeros(4, np.int64), "", nothing, nothing
                continue
            distinct, counts = np.unique(codes, return_counts=True)
            n = self.first[distinct + 1] - self.first[distinct]
            at = np.repeat(self.first[distinct] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs, times = self.pairs[at], self.times[at] * np.repeat(counts, n)
            order = np.argsort(pairs, kind="stable")
            pairs, times = pairs[order], times[order]
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            digest = hashlib.sha256(";".join(map(self.text.__getitem__, codes.tolist())).encode()).hexdigest()
            yield stats[:4], digest, pairs[first], np.add.reduceat(times, first)


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligned(byte_path: str, piece_path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (byte_path, piece_path) not in _aligners:
            _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
        aligner = _aligners[byte_path, piece_path]
        for part in chunks(batches):
            stats, digests, pairs, times = zip(*aligner.align(part.column("text").to_pylist()), strict=True)
            counts = dict(zip(("n_a", "n_b", "n_groups", "n_links"), np.array(stats).T, strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "row": part.column("row")} | {c: pa.array(x) for c, x in counts.items()} | {"groups_sha256": pa.array(digests, pa.string()), "pairs": _lists(pairs), "times": _lists(times)})

    return run


def _lists(arrays: Iterable[np.ndarray]) -> pa.ListArray:
    arrays = list(arrays)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in arrays])], pa.int32()), pa.array(np.concatenate(arrays)))


def _common_counts(shared):
    """Sums over the pairs whose counts are broadcast, and the others with how often each occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column("pairs")
                own, times = column.flatten().to_numpy(), part.column("times").flatten().to_numpy()
                first = np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
                place = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                known = pair[place] == own if len(pair) else np.zeros(len(own), bool)
                n = np.where(known, count[place], 0) if len(pair) else np.zeros(len(own), np.int64)
                is_best = known & best[place] if len(pair) else known
                sums = [np.diff(np.r_[0, np.cumsum(x)][first]) for x in (times * n, times * is_best)]
                rest = np.r_[0, np.cumsum(~known)][first].astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"row": part.column("row"), "count_sum": pa.array(sums[0]), "n_best": pa.array(sums[1].astype(np.int64)), "pairs": pa.ListArray.from_arrays(pa.array(rest), pa.array(own[~known])), "times": pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~known]))}
                )

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents hold each pair, and whether no pair with its first id has more."""
    counts = stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))  # a row per id of the vocabulary
    return stage(counts.join(most, F.shiftright(counts["pair"], 32) == most["a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _least_common(counts: DataFrame, most_pairs: int) -> int:
    """The smallest power of two for which no more than ``most_pairs`` pairs have so many documents."""
    by_size = counts.groupBy((F.length(F.bin("n")) - 1).alias("size")).agg(F.count("*").alias("k")).collect()  # a row per power of two
    least, total = 63, 0
    for size, k in sorted(by_size, reverse=True):
        total += k
        if total > most_pairs:
            break
        least = size
    return 1 << least if least < 63 else (1 << 63) - 1


def align(docs: DataFrame, byte_path: str, piece_path: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per row of ``docs (doc_id, text)``.

    Tokens A are those of a space and the text by the byte-level vocabulary, B those of the
    text by the sentence-piece model, which adds the space. ``n_best`` counts the links whose
    pair is in as many documents as any with its A id, ``count_sum`` sums over links the
    documents that hold their pair.

    * null and empty texts, and texts of which either side's bytes are not those of a space and the text, have no tokens: zeros and ''
    * rows that repeat a ``doc_id`` count as documents of their own; a null ``doc_id`` is kept
    * an empty table gives an empty result; other columns are ignored
    """
    spark = docs.sparkSession
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    ids = stage(numbered.select("row", "doc_id", "text").mapInArrow(_aligned(byte_path, piece_path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ALIGNED}"), "aligned")
    counts = pair_counts(ids)
    least = _least_common(counts, most_pairs)
    common = counts.filter(F.col("n") >= least).sort("pair").toPandas()  # bounded by most_pairs
    shared = spark.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), common["best"].to_numpy(bool)))
    summed = stage(ids.select("row", "pairs", "times").mapInArrow(_common_counts(shared), "row long, count_sum long, n_best long, pairs array<long>, times array<long>"), "common-counts")
    rest = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rest.join(counts.filter(F.col("n") < least), "pair").select("row", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    total = summed.select("row", "count_sum", "n_best").union(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return ids.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(total, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
