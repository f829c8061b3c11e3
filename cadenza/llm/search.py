"""Ranked lexical search of all documents for a set of queries, by a hybrid of accumulators and skipping.

1. *Segments.* Tasks index the documents they read, so many bytes of text to a segment: a row
   with the documents' ids and lengths and, for each term that a query asks for, the documents
   that hold it and how often. Terms of a block of queries are found by hash and confirmed by
   bytes. Segments are written once.
2. *Statistics.* Document frequencies, the number of documents and of terms are sums over segments.
3. *Search.* In a segment, a query's short lists are summed into accumulators, which from then
   on are one list with exact scores and known bounds. It is read together with the long lists,
   documents in order, some hundred at a time: long lists that can't lift a document to the
   best found so far nominate none, and a document is dropped, its further lists skipped, once
   its score and the bounds of the lists left fall short.
4. *Best.* Tasks return the best of each query; ranks are taken in two rounds.

Scores are 64-bit integers throughout, so the bounds are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage
from .phrases import Phrases, terms
from .textarrays import chunks

TOP = 50
#: Bytes of query text whose terms are indexed at once, and bytes of document text in a segment.
MOST_BYTES, SEGMENT_BYTES = 4 << 20, 16 << 20
#: A list is short if it holds at most this share of a segment's documents; documents read at a time.
SHORT, AT_ONCE = 1 / 16, 512
SEGMENT = "docs long, words long, ids array<long>, lengths array<long>, term array<int>, df array<int>, doc array<int>, tf array<int>"


class Queries:
    """Terms of some queries: ``terms[i]`` are numbers of the distinct terms of query ``i``."""

    def __init__(self, texts: list[list[str | None]]):
        """``texts[i]`` are those of query ``i``, whose terms are put together."""
        words = terms(pa.array([t for own in texts for t in own], pa.large_string()))
        self.vocabulary = Phrases(words, np.arange(len(words.start)), 1)
        query = np.repeat(np.arange(len(texts)), [len(own) for own in texts])[words.doc]
        pairs = np.unique(np.stack([query, self.vocabulary.number]), axis=1)
        first = np.searchsorted(pairs[0], np.arange(len(texts) + 1))
        self.terms = [pairs[1][a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.vocabulary.number = None


def _segments(shared, most_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Phrases = shared.value.vocabulary
        ids, lengths, keys, counts, n_docs, n_bytes = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            term, first = np.unique(key >> np.int64(32), return_index=True)
            n = np.concatenate(lengths)
            row = {"docs": (n > 0).sum(), "words": n.sum(), "ids": pa.concat_arrays(ids), "lengths": n, "term": term.astype(np.int32), "df": np.diff(np.r_[first, len(key)]).astype(np.int32), "doc": key.astype(np.int32), "tf": count.astype(np.int32)}
            kinds = {"ids": pa.int64(), "lengths": pa.int64(), "term": pa.int32(), "df": pa.int32(), "doc": pa.int32(), "tf": pa.int32()}
            lists = {c: pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), row[c] if isinstance(row[c], pa.Array) else pa.array(row[c], kind)) for c, kind in kinds.items()}
            for held in (ids, lengths, keys, counts):
                held.clear()
            return pa.RecordBatch.from_pydict({c: lists[c] if c in lists else pa.array([row[c]], pa.int64()) for c in row})

        for part in chunks(batches):
            words = terms(part.column("text"))
            at, number = vocabulary.find(words)
            key, count = np.unique((number << np.int64(32)) | (n_docs + words.doc[at]), return_counts=True)
            keys.append(key)
            counts.append(count)
            ids.append(part.column("doc_id"))
            lengths.append(np.diff(words.first).astype(np.int64))
            n_docs, n_bytes = n_docs + part.num_rows, n_bytes + len(words.data)
            if n_bytes >= most_bytes:
                yield close()
                n_docs = n_bytes = 0
        if n_docs:
            yield close()

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The ``k`` best documents of one query so far; of equal scores the smaller ids, rows without id last."""

    NO_ID = np.iinfo(np.int64).max

    def __init__(self, k: int):
        self.k, self.score, self.id, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Documents below this score can't be among the best; those without any score never are."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.id, self.known = score[order], ids[order], known[order]


def rank_segment(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, known: np.ndarray, best: Best) -> int:
    """Adds to ``best`` the documents of one segment; ``lists`` are (documents in order, scores above 0) of each term.

    Returns how many places of long lists were looked up."""
    short = [x for x in lists if len(x[0]) <= n_docs * SHORT]
    long = sorted((x for x in lists if len(x[0]) > n_docs * SHORT), key=lambda x: -int(x[1].max()))
    # the accumulators: sums stay far below 2^53, so doubles hold them exactly
    total = np.bincount(np.concatenate([x[0] for x in short]), np.concatenate([x[1] for x in short]), n_docs).astype(np.int64) if short else np.zeros(n_docs, np.int64)
    held = np.flatnonzero(total)
    least = best.least()
    if len(held) >= best.k:  # what is summed is a lower bound of the score
        least = max(least, int(np.partition(total[held], len(held) - best.k)[len(held) - best.k]))
    left = np.cumsum([0, *(int(x[1].max()) for x in reversed(long))])[::-1]  # bound of the lists from each on
    if len(held) and int(total[held].max()) + left[0] < least or not len(held) and left[0] < least:
        return 0
    nominate = int(np.searchsorted(-left, -least, side="right"))  # the lists before this one: without them no document gets there
    rows = np.unique(np.concatenate([held, *(x[0] for x in long[:nominate])])) if nominate else held
    looked = 0
    for at in range(0, len(rows), AT_ONCE):
        some = rows[at : at + AT_ONCE]
        score = total[some]
        least = max(least, best.least())
        for (docs, scores), bound in zip(long, left[:-1], strict=True):
            stay = score + bound >= least
            some, score = some[stay], score[stay]
            if not len(some):
                break
            place = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            score = score + np.where(docs[place] == some, scores[place], 0)
            looked += len(some)
        stay = score >= least
        if stay.any():
            best.add(score[stay], ids[some[stay]], known[some[stay]])
    return looked


def _search(shared, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_words, n_terms = shared.value
        best = [Best(k) for _ in queries]
        place = np.full(n_terms, -1, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                column = lambda c, r=r, batch=batch: batch.column(c)[r].values
                array = lambda c, column=column: column(c).to_numpy(zero_copy_only=False)
                ids, known = column("ids").fill_null(Best.NO_ID).to_numpy(), column("ids").is_valid().to_numpy(zero_copy_only=False)
                lengths, term, doc, tf = array("lengths"), array("term"), array("doc"), array("tf").astype(np.int64)
                first = np.r_[0, np.cumsum(array("df"))]
                m = 50 + (50 * lengths * n_docs) // n_words if n_words else lengths
                own = np.repeat(weights[term], np.diff(first)) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                place[term] = np.arange(len(term))
                for query, found in zip(queries, best, strict=True):
                    at = place[query]
                    at = at[at >= 0]
                    at = at[weights[term[at]] > 0]
                    if len(at):
                        rank_segment([(doc[first[i] : first[i + 1]], own[first[i] : first[i + 1]]) for i in at.tolist()], len(lengths), ids, known, found)
                place[term] = -1
        task = TaskContext.get().partitionId()
        for i, found in enumerate(best):
            if len(found.score):
                ids = pa.array(found.id, pa.int64(), mask=~found.known)
                n = len(ids)
                yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(n, i, np.int32)), "task": pa.array(np.full(n, task, np.int32)), "doc_id": ids, "score": pa.array(found.score)})

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = rows.withColumn("group", F.floor(F.col("task") / 64)).withColumn("rank", F.row_number().over(order("query", "group"))).filter(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(order("query"))).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, most_bytes: int = MOST_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs (doc_id, text)`` for each of ``queries (item_id, text)``.

    A document scores, for each distinct term of the query, the term's weight times a saturated
    count that falls with the document's length; only scores above 0 are returned, equal scores
    by ascending ``doc_id``. Queries are searched in blocks of ``most_bytes`` of text.

    * null and empty texts have no terms: such documents don't count, such queries return nothing
    * rows of ``docs`` that repeat a ``doc_id`` are documents of their own; rows without ``doc_id``
      follow those with one of the same score
    * rows that repeat an ``item_id`` (null is one, too) are one query with the terms of all
    * empty tables give an empty result; other columns are ignored
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = queries.schema["item_id"].dataType
    asked = queries.select("item_id", F.col("text").cast("string").alias("text"))
    n_bytes = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(n_bytes / most_bytes))
    out = None
    for block in range(blocks):
        rows = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)).collect()  # bounded by most_bytes
        by_id: dict = {}
        for r in rows:
            by_id.setdefault(r["item_id"], []).append(r["text"])
        wanted = Queries(list(by_id.values()))
        vocabulary = spark.sparkContext.broadcast(wanted)
        index = stage(docs.mapInArrow(_segments(vocabulary, segment_bytes), SEGMENT), "segments")
        n_docs, n_words = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        weights = np.zeros(wanted.vocabulary.size, np.int64)
        frequencies = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
        for term, df in frequencies.collect():  # a row per term of the block
            weights[term] = weight(n_docs, df)
        plan = spark.sparkContext.broadcast((wanted.terms, weights, n_docs, n_words, len(weights)))
        found = index.select("ids", "lengths", "term", "df", "doc", "tf").mapInArrow(_search(plan, k), "query int, task int, doc_id long, score long")
        names = spark.createDataFrame([(i, name) for i, name in enumerate(by_id)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", kind)]))
        best = _top(found, k).join(names, "query").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            best = stage(best, "best")
        out = best if out is None else out.union(best)
    return out
