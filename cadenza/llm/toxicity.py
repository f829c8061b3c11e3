"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is its character n-grams between boundary marks, hashed to a fixed number of
embedding rows; a text is the mean of the rows of the n-grams of its words, each word weighing the
root of its count. Embeddings and softmax
are fitted together on a bounded sample of labelled rows. Misspelt and inflected forms share
most n-grams with forms seen in training. Rows of n-grams never seen are zero, so unknown
vocabulary moves no score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .textarrays import BASE, Words, chunks, mix, sums

ROWS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Zero rows that join every mean, so that a handful of words does not decide alone.
NEUTRAL = 100
#: Bounds of the training sample: labelled rows of class 1 and of class 0, and bytes of each text (longer ones are left out).
SAMPLE_ROWS, SAMPLE_BYTES = (1000, 3000), 20_000
EPOCHS, BATCH, RATE, SEED = 10, 32, 3.0, 7


def ngram_rows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts: which of them each word is, and the embedding rows of each, one after another."""
    _, where, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, size = words.start[where], words.end[where] - words.start[where] + 2
    at = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(where)), size)
    inside = np.arange(total) - at[owner]
    source = np.clip(start[owner] + inside - 1, 0, max(len(words.data) - 1, 0))
    text = (words.data[source] if total else np.zeros(0, np.uint8)).astype(np.uint64)
    text[inside == 0] = 60
    text[inside == size[owner] - 1] = 62
    owners, rows = [], []
    for n in GRAMS:
        m = total - n + 1
        if m <= 0:
            continue
        good = np.flatnonzero(inside[:m] + n <= size[owner[:m]])
        h = np.zeros(len(good), np.uint64)
        for j in range(n):
            h = h * BASE + text[good + j] + np.uint64(1)
        owners.append(owner[good])
        rows.append((mix(h + np.uint64(n << 20)) % np.uint64(ROWS)).astype(np.int32))
    owner = np.concatenate(owners) if owners else np.zeros(0, int)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(where) + 1))
    return which, (np.concatenate(rows)[order] if rows else np.zeros(0, np.int32)), first


@dataclass(frozen=True)
class Model:
    """``value`` is each n-gram row's part of the log odds (its embedding times the difference of the softmax columns)."""

    value: np.ndarray
    bias: float

    def score(self, words: Words) -> np.ndarray:
        which, rows, first = ngram_rows(words)
        part = sums(self.value[rows].astype(np.float64), first)
        n = np.diff(first)
        distinct, times = np.unique(words.doc * max(len(n), 1) + which, return_counts=True)
        doc, word = np.divmod(distinct, max(len(n), 1))
        total, count = (np.bincount(doc, weights=x[word] * np.sqrt(times), minlength=len(words.first) - 1) for x in (part, n))
        return 1 / (1 + np.exp(-np.clip(total / (count + NEUTRAL) + self.bias, -60, 60)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Jointly fitted embeddings and softmax (adaptive gradient steps on the mean log loss)."""
    rng = np.random.default_rng(SEED)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], most=200_000):
        words = Words(batch.column("text"), lower=True)
        which, rows, first = ngram_rows(words)
        for i in range(batch.num_rows):
            own, times = np.unique(which[words.first[i] : words.first[i + 1]], return_counts=True)
            n = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            ids, place = np.unique(rows[at], return_inverse=True)
            share = np.bincount(place, weights=np.repeat(np.sqrt(times), n)) if len(ids) else np.zeros(0)
            docs.append((ids, (share / (share.sum() + NEUTRAL)).astype(np.float32)))
    y = labels.astype(int)
    vectors = np.zeros((ROWS, DIM), np.float32)
    softmax = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = (np.full_like(x, 1e-8) for x in (vectors, softmax, bias))
    for _ in range(epochs if len(set(y.tolist())) == 2 else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            part = [docs[i] for i in order[at : at + BATCH]]
            ids = np.concatenate([d[0] for d in part])
            share = np.concatenate([d[1] for d in part])
            owner = np.repeat(np.arange(len(part)), [len(d[0]) for d in part])
            mean = np.stack([np.bincount(owner, weights=share * vectors[ids, k], minlength=len(part)) for k in range(DIM)], 1).astype(np.float32)
            z = mean @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[order[at : at + BATCH]]] -= 1
            to_mean = p @ softmax.T / len(part)
            touched, place = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(place, weights=share * to_mean[owner, k]) for k in range(DIM)], 1).astype(np.float32)
            seen_v[touched] += g * g
            vectors[touched] -= rate * g / np.sqrt(seen_v[touched])
            for x, seen, d in ((softmax, seen_s, mean.T @ p / len(part)), (bias, seen_b, p.mean(0))):
                seen += d * d
                x -= 0.1 * rate * d / np.sqrt(seen)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]) if len(docs) else 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; such rows are never trained on. False for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows of ``docs`` outside the held-out fold: of each class the ``sample_rows`` with the smallest hashed ids.

    The sample is all that reaches the driver: at most ``sum(sample_rows)`` texts of at most
    ``SAMPLE_BYTES`` each. Without labelled rows, or with one class only, the model scores
    every text the same.

    * null texts count as empty; labels other than 0 and 1 and null ids are not trained on
    * of several labels of an id the larger one counts, of several texts the first in order
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    known = stage(texts.select("doc_id").distinct().join(known, "doc_id"), "labelled")  # what can be trained on, before the sample is taken
    picked = known.filter("toxic = 1").orderBy(*order).limit(sample_rows[0]).union(known.filter("toxic = 0").orderBy(*order).limit(sample_rows[1]))
    # the picked ids are no more than the sample
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], int))


def _scores(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            score = model.score(Words(batch.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs (doc_id, text)``.

    Null and empty texts score by the bias alone. Null and repeated ids are scored like any
    other. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(model), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay.

    Rows are judged one by one: null and empty texts by the bias alone, null and repeated ids
    like any other. An empty table gives an empty result; columns of any name come through.
    """
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
                score = np.concatenate([model.score(Words(part.column(0), lower=True)) for part in chunks([texts])])
                yield batch.filter(pa.array(score < limit))

    return docs.mapInArrow(run, docs.schema)
