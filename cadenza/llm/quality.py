"""Quality rules on repetition: characters inside repeated n-grams and lines.

Word n-grams of several lengths are hashed in numpy over a batch of texts at once; a
character counts for a length if its word lies in an n-gram of that length that the text
holds twice or more (all occurrences, first included).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import ODD, SPACE, Words, chunks, mix, sums

#: Largest share of characters inside repeated n-grams, by n-gram length; published limits for web text.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
BASE_N = 3
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def covered(words: Words, n: int) -> np.ndarray:
    """Whether each word lies in an n-gram that its text holds more than once."""
    grams, inside = words.grams(n)
    at = np.flatnonzero(inside)
    out = np.zeros(len(words.hash) + 1, np.int64)
    if len(at):
        key = mix(grams[at] + words.doc[at].astype(np.uint64) * ODD)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        often = np.zeros(len(at), bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        np.add.at(out, at[often], 1)
        np.add.at(out, at[often] + n, -1)
    return np.cumsum(out)[:-1] > 0


def lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and their characters."""
    seen: set[str] = set()
    repeats = chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            if line in seen:
                repeats += 1
                chars += len(line)
            seen.add(line)
    return repeats, chars


def _measure(limits: dict[int, float]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            column = batch.column("text").fill_null("")
            words = Words(column)
            first_byte = ((words.data & 0xC0) != 0x80).astype(np.int64)
            upto = np.r_[0, np.cumsum(first_byte & ~SPACE[words.data])]
            symbols = np.r_[0, np.cumsum(SYMBOL[words.data].astype(np.int64))]
            size = upto[words.end] - upto[words.start]
            total = upto[words.offsets[1:]] - upto[words.offsets[:-1]]
            repeated = sums(covered(words, BASE_N).astype(np.int64), words.first)
            share = {n: sums(size * covered(words, n), words.first) / np.maximum(total, 1) for n in limits}
            found = [lines(t) for t in column.to_pylist()]
            line_share = np.array([c for _, c in found], float) / np.maximum(np.diff(np.r_[0, np.cumsum(first_byte)][words.offsets]), 1)
            count = np.diff(words.first)
            failed = (count < 50) | (100 * repeated > 50 * count)
            kept = ~failed & (line_share <= LINE_LIMIT)
            for n, most in limits.items():
                kept &= share[n] <= most
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(x.astype(np.int64)) for x in (count, total, symbols[words.offsets[1:]] - symbols[words.offsets[:-1]], np.array([r for r, _ in found]), repeated)),
                    pa.array(failed), pa.array(kept), pa.array(line_share), *(pa.array(share[n]) for n in limits),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_share", *(f"share_{n}" for n in limits)],
            )

    return run


def repetition(docs: DataFrame, limits: dict[int, float] = LIMITS) -> DataFrame:
    """One row per row of ``docs (doc_id, text)`` with counts, shares and the verdict ``kept``.

    ``base_failed``: under 50 words, or over half of them inside a repeated 3-word window.
    ``kept``: not that, repeated lines hold at most ``LINE_LIMIT`` of the characters, and
    repeated n-grams at most ``limits`` by length.

    Null and empty texts have no words and fail. Ids may be null or repeat; rows are judged
    one by one. An empty table gives an empty result. Other columns are ignored.
    """
    shares = "".join(f", share_{n} double" for n in limits)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _measure(dict(limits)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double" + shares
    )
