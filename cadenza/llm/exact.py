"""Exact deduplication against a minimal perfect hash over historical digests.

The history (texts of an earlier crawl) becomes one row per distinct SHA-256 digest with its
winner, the smallest ``doc_id``. Digests are dealt to shards of bounded size; each shard
builds a minimal perfect hash whose slots hold the full digest and the winner's locator.
Distinct digests of the new documents look their slot up and compare all 32 bytes: members
repeat the history, the others form groups of their own. Copies are counted before anything
is dealt, so a group of copies of any size is one row everywhere but in the last join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .textarrays import ODD, mix

SHARD_DIGESTS = 16_384


def normalised(text: str | Column = "text") -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class PerfectHash:
    """Minimal perfect hash: each level keeps the keys that are alone in their cell, the rest go on."""

    def __init__(self, keys: np.ndarray, spare: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = keys, 0
        while len(left):
            cells = max(64, int(spare * len(left)))
            at = self._cell(left, len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 64:
                raise ValueError("keys repeat")

    @staticmethod
    def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * int(ODD) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(cells)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for a key outside the built set any slot, or -1."""
        out = np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._cell(keys[open_], level, len(alone))
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _key(digests: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each digest; another choice of them for each seed."""
    words = np.ascontiguousarray(digests).view(np.uint64)
    out = np.full(len(words), seed, np.uint64)
    for k in (1, 2, 3):
        out = mix(out ^ words[:, k] + ODD)
    return out


def _table(digests: np.ndarray) -> tuple[PerfectHash, int]:
    """A perfect hash of different digests, and the seed of their keys: the first for which no two keys are equal."""
    seed = 0
    while len(np.unique(_key(digests, seed))) < len(digests):
        seed += 1
    return PerfectHash(_key(digests, seed)), seed


def _lookup(history: pa.Table, new: pa.Table) -> pa.Table:
    if not new.num_rows:
        return pa.table({"digest": pa.array([], pa.binary()), "winner": pa.array([], pa.int64()), "earlier": pa.array([], pa.int64())})
    winner, earlier = np.zeros(new.num_rows, np.int64), np.zeros(new.num_rows, np.int64)
    member = np.zeros(new.num_rows, bool)
    if history.num_rows:
        known = _digests(history["digest"])
        table, seed = _table(known)
        place = table.slot(_key(known, seed))
        slots, locators, sizes = np.empty_like(known), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        slots[place], locators[place], sizes[place] = known, history["winner"].to_numpy(), history["n"].to_numpy()
        asked = _digests(new["digest"])
        at = table.slot(_key(asked, seed))
        member = (at >= 0) & (slots[at] == asked).all(axis=1)
        winner, earlier = locators[at], sizes[at]
    return pa.table({"digest": new["digest"].cast(pa.binary()), "winner": pa.array(winner, mask=~member), "earlier": pa.array(np.where(member, earlier, 0))})


def _distinct(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n"))


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    return distinct.withColumn("shard", F.expr(f"cast(conv(hex(substring(digest, 1, 6)), 16, 10) AS bigint) % {shards}"))


def text_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest``: SHA-256 of each normalised text, 32 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(docs["text"]), 256)).alias("digest"))


def exact_duplicates(digests: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of both tables of :func:`text_digests`.

    ``keep_id`` is the smallest ``doc_id`` of equal texts, wherever it is; ``kept`` tells
    whether that is this row's. Without ``history`` every digest is a nonmember.

    * null text equals empty text; an empty table gives an empty result
    * null ``doc_id``: never a winner unless all rows of the group have none (then
      ``keep_id`` is null and every such row is kept)
    * rows that repeat ``doc_id`` and text each count in ``group_size`` and are all kept
      where their id wins
    """
    new = _distinct(digests)
    if history is None:
        groups = new.select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
        rows = digests
    else:
        old, new = stage(_distinct(history), "history"), stage(new, "distinct")
        shards = max(1, -(-max(old.count(), new.count()) // SHARD_DIGESTS))  # a shard is bounded on both sides
        looked_up = (
            _sharded(old, shards)
            .groupBy("shard")
            .cogroup(_sharded(new, shards).groupBy("shard"))
            .applyInArrow(_lookup_by_columns, "digest binary, winner long, earlier long")
            .select("digest", F.col("winner").alias("locator"), "earlier")
        )
        found = new.join(looked_up, "digest").select("digest", F.least("winner", "locator").alias("keep_id"), (F.col("n") + F.col("earlier")).alias("group_size"))
        untouched = old.join(new, "digest", "left_anti").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
        groups = found.union(untouched)
        rows = digests.union(history)
    groups = stage(groups, "groups")  # so that the join can split a digest that very many documents have
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _lookup_by_columns(history: pa.Table, new: pa.Table) -> pa.Table:
    return _lookup(history, new)


def split_by_age(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(later, earlier) half of the rows by id: the earlier rows serve as history. Rows without id are later ones.

    The middle is an approximate median, so no outlying id moves it; where it lies changes no result."""
    middle = digests.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    old = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    return digests.filter(~old), digests.filter(old)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has a smaller ``doc_id`` elsewhere; all columns stay.

    * null texts equal empty ones; an empty table gives an empty result
    * rows without ``doc_id`` stay; rows that repeat the id and text that stay all stay
    * of rows that share an id only those go whose own text is elsewhere
    * columns of any name come through unchanged
    """
    digests = stage(text_digests(docs), "digests")
    losers = exact_duplicates(*split_by_age(digests)).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("loser"), F.col("text_sha256").alias("sha")).distinct()
    # the input goes through as one struct, so that none of its names can clash
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(normalised(docs["text"]), 256).alias("own"))
    return rows.join(losers, (F.col("id") == F.col("loser")) & (F.col("own") == F.col("sha")), "left_anti").select("row.*")
