"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams scans all texts.

A window is so many consecutive terms of an item, or all of an item with fewer. The set of
windows, with the items of each, is built once from a benchmark whose bytes are counted
first, and broadcast; every window of a document is looked up by its rolling hash and
confirmed byte by byte. A benchmark of more than ``MOST_BYTES`` is dealt into blocks, each of
which scans all documents; what the blocks find meets per document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage
from .phrases import Phrases, terms
from .textarrays import Words, chunks, sums

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
MOST_BYTES = 16 << 20
HITS = "starts array<int>, ends array<int>, items array<string>"


class Windows:
    """The windows of some items, by length, and the names of the items that hold each, as numbers into ``names``."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        words = terms(pa.array(texts, pa.large_string()))
        counts = np.diff(words.first)
        self.names = sorted({i for i in ids if i is not None})
        place = {name: k for k, name in enumerate(self.names)}
        name_of = np.array([place.get(i, -1) for i in ids], np.int64)
        self.sets: list[tuple[Phrases, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(counts, window)).tolist():
            if n:
                whole = counts >= window if n == window else counts == n
                at = np.flatnonzero(whole[words.doc] & (np.arange(len(words.doc)) + n <= words.first[words.doc + 1]))
                phrases = Phrases(words, at, n)
                pairs = np.unique(np.stack([phrases.number, name_of[words.doc[at]]]), axis=1)
                pairs = pairs[:, pairs[1] >= 0]
                phrases.number = None
                self.sets.append((phrases, np.searchsorted(pairs[0], np.arange(phrases.size + 1)), pairs[1]))

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """First word and the word after the last of each occurrence of a window, and the numbers of the items found per text."""
        starts, ends, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        for phrases, first, owner in self.sets:
            at, number = phrases.find(words)
            starts.append(at)
            ends.append(at + phrases.n)
            if len(at):
                doc, number = np.unique(np.stack([words.doc[at], number]), axis=1)
                for a, b in zip(*_runs(doc), strict=True):
                    lists = [owner[first[k] : first[k + 1]] for k in number[a:b].tolist()]
                    items[int(doc[a])] = np.unique(np.concatenate([*lists, items.get(int(doc[a]), np.zeros(0, np.int64))]))
        return np.concatenate(starts), np.concatenate(ends), items


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.diff(x)) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(x)]


def _covered(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends, -1)
    return np.cumsum(cover)[:-1] > 0


Judge = Callable[[pa.RecordBatch, Words, np.ndarray, list[list[str]]], pa.RecordBatch]


def _summary(part: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    n_hit = sums(hit.astype(np.int64), words.first)
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    new = {"n_words": np.diff(words.first).astype(np.int64), "n_hit": n_hit, "n_items": pa.array(map(len, items), pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "items_sha256": pa.array(digest, pa.string()), "contaminated": n_hit > 0}
    return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | new)


def _without_hits(part: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    column = part.column("text")
    texts = column.to_pylist()
    for doc in np.unique(words.doc[hit]).tolist():
        own = np.arange(words.first[doc], words.first[doc + 1])
        raw, base, kept, upto = texts[doc].encode(), words.offsets[doc], [], 0
        flags = hit[own]
        for a, b in zip(*_runs(flags), strict=True):
            if flags[a]:  # from the first hit word to the end of the last, what stands between them included
                kept.append(raw[upto : words.start[own[a]] - base])
                upto = words.end[own[b - 1]] - base
        texts[doc] = b"".join([*kept, raw[upto:]]).decode()
    at = part.schema.get_field_index("text")
    return part.set_column(at, part.schema.field(at), pa.array(texts, column.type))


def _direct(shared, judge: Judge):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        for part in chunks(batches):
            words = terms(part.column("text"))
            starts, ends, found = windows.scan(words)
            items = [[windows.names[k] for k in found[i].tolist()] if i in found else [] for i in range(part.num_rows)]
            yield judge(part, words, _covered(words, starts, ends), items)

    return run


def _hits(shared):
    """One row per document that a block of the benchmark hits, with places counted in its own words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        for part in chunks(batches):
            words = terms(part.column("text"))
            starts, ends, found = windows.scan(words)
            order = np.argsort(words.doc[starts], kind="stable")
            starts, ends = starts[order], ends[order]
            doc = words.doc[starts]
            rows = np.unique(doc)
            own = [(starts[doc == i] - words.first[i], ends[doc == i] - words.first[i]) for i in rows.tolist()]
            items = [[windows.names[k] for k in found[i].tolist()] for i in rows.tolist()]
            some = part.take(pa.array(rows))
            yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "digest": some.column("digest"), "starts": pa.array([x for x, _ in own], pa.list_(pa.int32())), "ends": pa.array([x for _, x in own], pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))})

    return run


def _gathered(judge: Judge):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = terms(part.column("text"))
            starts, ends, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, found in enumerate(part.column("__found").to_pylist()):
                for x in found or []:
                    starts.append(np.array(x["starts"], np.int64) + words.first[i])
                    ends.append(np.array(x["ends"], np.int64) + words.first[i])
                items.append(sorted({name for x in found or [] for name in x["items"]}))
            bare = part.drop_columns(["__found"])
            yield judge(bare, words, _covered(words, np.concatenate(starts), np.concatenate(ends)), items)

    return run


def _judged(docs: DataFrame, benchmark: DataFrame, judge: Judge, schema: str | T.StructType, window: int, most_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(n_bytes / most_bytes))

    def shared(block: int):
        rows = (items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)).collect()  # bounded by most_bytes
        return spark.sparkContext.broadcast(Windows([r[0] for r in rows], [r[1] for r in rows], window))

    if blocks == 1:
        return docs.mapInArrow(_direct(shared(0), judge), schema)
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = None
    for block in range(blocks):
        windows = shared(block)
        hits = stage(keyed.select("doc_id", F.col("__digest").alias("digest"), "text").mapInArrow(_hits(windows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, {HITS}"), "hits")
        windows.destroy()
        found = hits if found is None else found.union(hits)
    # rows of one id and text have the same hits, and meet as one
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__same")).agg(F.collect_set(F.struct("starts", "ends", "items")).alias("__found"))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["__digest"] == found["__same"]), "left").select(*docs.columns, "__found")
    return joined.mapInArrow(_gathered(judge), schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated``: one row per row of ``docs (doc_id, text)``.

    ``benchmark (item_id, text)`` gives the windows; ``items`` are the ids, as strings in order,
    whose windows occur.

    * null and empty texts have no words: documents are clean, items have no windows
    * rows that repeat a ``doc_id`` are judged each by its own text; rows that repeat an ``item_id``
      are one item with the windows of all
    * an item without id has windows that hit words but is not counted or named
    * an empty benchmark hits nothing, an empty table gives an empty result; other columns are ignored
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    return _judged(docs.select("doc_id", "text"), benchmark, _summary, schema, window, most_bytes)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with all their columns and rows; each run of hit words, with what stands between them, is cut out of ``text``.

    Odd rows are as for :func:`scan`; a null text stays null."""
    return _judged(docs, benchmark, _without_hits, docs.schema, window, most_bytes)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` without the documents of which more than ``most_share`` of the words are hit. Odd rows are as for :func:`scan`."""

    def judge(part: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
        return part.filter(pa.array(sums(hit.astype(np.int64), words.first) <= most_share * np.diff(words.first)))

    return _judged(docs, benchmark, judge, docs.schema, window, most_bytes)
