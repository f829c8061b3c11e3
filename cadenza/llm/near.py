"""N-gram Jaccard join by MinHash banding.

Texts become sets of five-word shingles. A text shorter than that has one shingle, all its
words; a text without words (null, empty) has none and links to nothing. Documents with the
same set form a *set class* first, so exact copies cost one row each. Of every class one
representative is hashed into bands whose number and height follow from the recall wanted
at the threshold. Representatives that meet in a bucket are dealt to blocks; a task gets two
blocks with their full shingle sets and verifies every pair between them, so a large bucket
is spread over many tasks and no row is written per pair: a task returns links per document
and a spanning forest of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .components import components
from .textarrays import BASE, ODD, Words, chunks, mix, signed, sums

N_WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.995, 5
BLOCK_DOCS, BLOCK_SHINGLES = 160, 120_000


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` MinHash values so that a pair at ``similarity`` meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the offsets between them."""
    grams, whole = words.grams(n)
    out = []
    for i in range(len(words.first) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            g = np.uint64(0)
            for h in words.hash[a:b]:
                g = np.uint64((int(g) * int(BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([g]) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum([0, *map(len, out)])


def set_hash(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums(mix(values), first), sums(mix(values ^ ODD), first)


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * ODD) | np.uint64(1)
        for batch in chunks(batches):
            values, first = shingles(Words(batch.column("text")), n)
            size = np.diff(first)
            full = np.flatnonzero(size)
            table = np.zeros((len(size), bands), np.uint64)
            if len(full):
                for band in range(bands):
                    h = np.full(len(full), np.uint64(band))
                    for seed in seeds[band * rows : (band + 1) * rows]:
                        h = mix(h * ODD + np.minimum.reduceat(values * seed, first[full]))
                    table[full, band] = h
            a, b = set_hash(values, first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), signed(table.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(size.astype(np.int32)), signed(a), signed(b), lists], ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _with_sets(n: int):
    """For each document wanted: its shingle set, once for each place that asks for it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=500_000):
            values, first = shingles(Words(batch.column("text")), n)
            a, b = set_hash(values, first)
            good = np.flatnonzero((a.view(np.int64) == batch.column("set_a").to_numpy()) & (b.view(np.int64) == batch.column("set_b").to_numpy()))
            if not len(good):
                continue
            kept = batch.take(pa.array(good))
            sets = pa.array([values[first[i] : first[i + 1]].tobytes() for i in good], pa.binary())
            units = kept.column("units")
            size = np.diff(units.offsets.to_numpy())
            row = np.repeat(np.arange(len(good)), size)
            flat = units.flatten()
            heavy = np.cumsum(8 * np.diff(first)[good][row]) // 4_000_000  # bytes of sets in one batch
            cuts = np.r_[0, np.flatnonzero(np.diff(heavy)) + 1, len(row)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                part, where = pa.array(row[at:to]), flat.slice(int(at), int(to - at))
                yield pa.RecordBatch.from_arrays(
                    [*(where.field(k) for k in ("band", "bucket", "lo", "hi", "block")), *(kept.column(k).take(part) for k in ("rep", "members", "bands")), sets.take(part)],
                    ["band", "bucket", "lo", "hi", "block", "rep", "members", "bands", "shingles"],
                )

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common values of every two sets."""
    n = len(sets)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, min(4096, 1_000_000 // n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _links(unit: dict, similarity: float) -> tuple[list, list, list]:
    """Documents of a unit with links, the documents linked to each, and the root of each in a spanning forest."""
    # a row of documents that repeats brings its set again
    once = sorted({(int(r), s): i for i, (r, s) in enumerate(zip(unit["rep"], unit["shingles"], strict=True))}.values())
    rep, block, bands, members = (unit[k][once] for k in ("rep", "block", "bands", "members"))
    sets = [np.frombuffer(unit["shingles"][i], np.uint64) for i in once]
    n, band = len(rep), unit["band"]
    size = np.array([len(s) for s in sets])
    if n <= 6:
        common = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i + 1, n):
                common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        common += common.T
    else:
        common = intersections(sets)
    linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
    for b in range(band):  # such pairs are counted where they meet first
        linked &= bands[:, b][:, None] != bands[None, :, b]
    linked &= rep[:, None] != rep[None, :]
    if unit["lo"] != unit["hi"]:
        linked &= block[:, None] != block[None, :]
    root = np.arange(n)
    changed = True
    while changed:
        low = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        changed = bool((new != root).any())
        root = new
    some = np.flatnonzero(linked.any(axis=1))
    return rep[some].tolist(), (linked * members[None, :]).sum(axis=1)[some].tolist(), rep[root[some]].tolist()


def _verify(similarity: float):
    names = ["band", "bucket", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(parts: list[pa.RecordBatch]) -> tuple[list, list, list]:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            lists = t.column("bands")
            return _links({k: t.column(k)[0].as_py() for k in ("band", "lo", "hi")} | {k: t.column(k).to_numpy() for k in ("rep", "members", "block")} | {"bands": lists.flatten().to_numpy().reshape(t.num_rows, -1), "shingles": t.column("shingles").to_pylist()}, similarity)

        out: tuple[list, list, list] = ([], [], [])
        open_parts: list[pa.RecordBatch] = []
        last = None

        def close() -> None:
            if open_parts:
                for x, y in zip(out, whole(open_parts), strict=True):
                    x.extend(y)
                open_parts.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["rep", "links", "root"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in names])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, a])
                if key != last:
                    close()
                    last = key
                open_parts.append(batch.slice(a, b - a))
            if len(out[0]) > 10_000:
                yield made()
        close()
        yield made()

    return run


def near_duplicates(docs: DataFrame, n: int = N_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links``: one row per row of ``docs (doc_id, text)``.

    Links join documents whose shingle sets have a Jaccard similarity of ``similarity`` or
    more; ``n_links`` counts the other documents linked to this one, copies of its own set
    included. ``class_id`` is the smallest ``doc_id`` that a chain of links reaches.

    * null or empty text: its own class, no links; null ``doc_id``: null class, no links
    * rows that repeat a ``doc_id`` count once if their sets agree; if not, each set is a
      document of its own, with its own class and links
    * empty table: empty result; other columns are ignored
    """
    return _classes(docs, n, similarity, recall).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, n: int = N_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """:func:`near_duplicates` with ``text_key``, the hash of each row's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    bands = bands_for(similarity, recall)
    sig = stage(docs.mapInArrow(_signatures(n, bands, ROWS), "doc_id long, text_key long, n_shingles int, set_a long, set_b long, bands array<long>"), "signatures")
    known = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # written, so that joins on a set that very many documents share can split it
    same = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("members"))
    # a class goes by its first id; further classes of the same id go by a hash
    place = F.row_number().over(Window.partitionBy("first").orderBy("set_a", "set_b"))
    same = stage(same.withColumn("rep", F.when(place == 1, F.col("first")).otherwise(F.xxhash64("first", "set_a", "set_b"))), "set-classes")
    reps = known.withColumnRenamed("doc_id", "first").join(same, ["set_a", "set_b", "first"]).select("rep", "first", "members", "set_a", "set_b", "n_shingles", "bands").dropDuplicates(["rep"])
    reps = stage(reps, "representatives")
    places = reps.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    buckets = (
        places.groupBy("band", "bucket")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("who_too"))
        .filter("n > 1")
        # buckets of the same members hold the same pairs: the first band's is enough
        .groupBy("who", "who_too", "n")
        .agg(F.min(F.struct("band", "bucket", "size")).alias("b"))
        .select("b.band", "b.bucket", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("b.size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    units = (
        places.join(buckets, ["band", "bucket"])
        .withColumn("block", F.expr("cast(pmod(xxhash64(rep, band), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("rep", F.struct("band", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block").alias("unit"))
        .groupBy("rep")
        .agg(F.collect_list("unit").alias("units"))
    )
    asked = reps.select("rep", "first", "members", "set_a", "set_b", "bands").join(units, "rep")
    dealt = (
        docs.join(asked, docs["doc_id"] == asked["first"])
        .select("text", "rep", "members", "set_a", "set_b", "bands", "units")
        .mapInArrow(_with_sets(n), "band int, bucket long, lo int, hi int, block int, rep long, members long, bands array<long>, shingles binary")
        .repartition("band", "bucket", "lo", "hi")
        .sortWithinPartitions("band", "bucket", "lo", "hi", "rep")
    )
    found = stage(dealt.mapInArrow(_verify(similarity), "rep long, links long, root long"), "links")
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    grouped = linked.withColumnRenamed("node", "rep").join(same.select("rep", "first"), "rep")
    smallest = stage(grouped.groupBy("component").agg(F.min("first").alias("class_id")), "smallest-ids")
    per_rep = stage(found.groupBy("rep").agg(F.sum("links").alias("links")).join(grouped.select("rep", "component"), "rep", "left").join(smallest, "component", "left").select("rep", "links", "class_id"), "per-representative")
    rows = sig.select("doc_id", "text_key", "set_a", "set_b", "n_shingles").join(same, ["set_a", "set_b"], "left")
    return rows.join(per_rep, "rep", "left").select(
        "doc_id",
        "text_key",
        F.expr("coalesce(if(n_shingles > 0 AND doc_id IS NOT NULL, coalesce(class_id, first), NULL), doc_id)").alias("class_id"),
        F.expr("if(n_shingles > 0 AND doc_id IS NOT NULL, coalesce(links, 0) + members - 1, 0)").cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are not the first of their class; all columns stay.

    * rows without ``doc_id`` or words stay; rows that repeat the id and set that stay all stay
    * of rows that share an id each is judged by its own text
    * an empty table gives an empty result; columns of any name come through unchanged
    """
    losers = _classes(docs, **options).filter("class_id <> doc_id").select(F.col("doc_id").alias("loser"), F.col("text_key").alias("key")).distinct()
    # the input goes through as one struct, so that none of its names can clash
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    return rows.join(losers, (F.col("id") == F.col("loser")) & (F.col("own") == F.col("key")), "left_anti").select("row.*")
