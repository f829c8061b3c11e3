"""Substring deduplication with repeated-phrase automata.

A word goes if a 13-word window over it starts in a document with a smaller id as well.
Hashes nominate pairs of documents, automata over words locate what recurs:

1. *Anchors.* Each window has an anchor, the smallest 5-word hash in it, so equal windows
   share anchors. One row per anchor and document is shuffled; anchors of two or more
   documents come back to their documents as hints.
2. *Firsts.* Windows over hinted anchors are hashed (96 bits) and the first document of each
   is found. All that is kept is which part of a document has windows of which other's part;
   a part is so many words of a document and the 12 after them.
3. *Automata.* The parts that recur from one first part are dealt to groups of bounded size
   with a copy of that part. A group confirms the passages that its members share with the
   first part, compiles the words of the first part's passages into one Aho-Corasick automaton
   and streams every member through it. Only what the automaton finds is removed.

In steps 1 and 2 each task resolves what it can by itself (anchors and windows that several
of its documents share) and sends one row for them, so a passage that a third of all
documents hold is one row per task, not one per document. Exact copies of a whole word
sequence, told by SHA-256, need none of this: all their words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .textarrays import BASE, ODD, Words, chunks, mix, signed

WINDOW, ANCHOR = 13, 5
#: Words that make a part of a document, and parts that share an automaton at most.
PART, MEMBERS = 4096, 64
ALONE, SHARED, KNOWN = 0, 1, 2

def anchors(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one text, and the anchor of each."""
    _, inside = words.grams(window)
    small, _ = words.grams(anchor)
    at = np.flatnonzero(inside)
    low = small[at].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(low, small[at + j], out=low)
    return at, low


def window_hashes(words: Words, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each window that starts ``at``, and 32 more."""
    grams, _ = words.grams(window)
    other = np.zeros(len(at), np.uint64)
    for j in range(window):
        other = mix(other ^ (words.hash[at + j] + np.uint64(j)))
    return grams[at], other & np.uint64(0xFFFFFFFF)


def _split(column: pa.Array) -> list[list[bytes]]:
    """Words of each text; ``bytes.split`` cuts at the same six characters."""
    return [t.split() for t in column.fill_null("").cast(pa.binary()).to_pylist()]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        lists = _split(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in lists], pa.int64()), pa.array(map(_digest, lists), pa.binary())], ["doc_id", "n_words", "whole"])


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, key, doc_id, state): one row per anchor and document, less where documents of the chunk share it."""
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        at, low = anchors(words)
        if not len(at):
            continue
        ids = batch.column("doc_id").to_numpy()
        order = np.lexsort((words.doc[at], low))
        low, doc = low[order], words.doc[at][order]
        new = np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]
        low, doc = low[new], ids[doc[new]]
        start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(low)]))
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        shared = several[group]
        once = start[several]  # one row tells the other tasks
        key = np.r_[low, low[once]]
        doc = np.r_[doc, np.full(len(once), -1)]
        state = np.r_[np.where(shared, KNOWN, ALONE), np.full(len(once), SHARED)].astype(np.int8)
        route = np.where(state == KNOWN, mix(doc.astype(np.uint64) * ODD), key)
        yield pa.RecordBatch.from_arrays([signed(route), signed(key), pa.array(doc), pa.array(state)], ["route", "key", "doc_id", "state"])


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield {n: batch.column(n).to_numpy() for n in batch.schema.names}


def _after(rest: dict[str, np.ndarray] | None, cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return cols if rest is None else {n: np.concatenate([rest[n], v]) for n, v in cols.items()}


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys, and the run of each row."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _recurring_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key) of every anchor that another document has too, of rows sorted by route.

    Of an anchor whose rows go on in the next batch only what decides them is kept."""
    rest = None
    for cols in _columns(batches):
        c = _after(rest, cols)
        start, group = _groups(c["route"])
        alone = c["state"] == ALONE
        low = np.minimum.reduceat(np.where(alone, c["doc_id"], np.iinfo(np.int64).max), start)
        high = np.maximum.reduceat(np.where(alone, c["doc_id"], -1), start)
        recurs = ((low != high) & (high >= 0)) | (np.maximum.reduceat((c["state"] == SHARED).astype(np.int8), start) > 0)
        take = (c["state"] == KNOWN) | (alone & recurs[group])
        last = np.flatnonzero(group == group[-1])
        if recurs[-1]:
            rest = {n: v[last[:1]].copy() for n, v in c.items()}
            rest["doc_id"][:], rest["state"][:] = -1, SHARED
        else:
            rest = {n: v[last[alone[last]]] for n, v in c.items()}
        yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"][take]), pa.array(c["key"][take])], ["doc_id", "key"])


def _hints(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def _window_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, more, doc_id, part, first, first_part, state): windows over hinted anchors, as the chunk's
    first document asks for them, and parts of other documents with the chunk's first (state KNOWN)."""
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        at, low = anchors(words)
        hint, owner = _hints(batch.column("hints"))
        salted = lambda x, doc: mix(x + doc.astype(np.uint64) * ODD)
        at = at[np.isin(salted(low, words.doc[at]), salted(hint, owner))]
        if not len(at):
            continue
        key, more = window_hashes(words, at)
        doc = batch.column("doc_id").to_numpy()[words.doc[at]]
        part = (at - words.first[words.doc[at]]) // PART
        order = np.lexsort((part, doc, more, key))
        key, more, doc, part = key[order], more[order], doc[order], part[order]
        start, group = _groups(key, more)
        first, first_part = doc[start][group], part[start][group]
        asks = doc == first
        asks[1:] &= (group[1:] != group[:-1]) | (part[1:] != part[:-1])
        pairs = np.unique(np.stack([doc, part, first, first_part])[:, doc != first], axis=1)
        zero = np.zeros(pairs.shape[1], np.int64)
        columns = [
            signed(np.r_[key[asks], mix(pairs[0].astype(np.uint64) * ODD)]), np.r_[more[asks].astype(np.int64), zero], np.r_[doc[asks], pairs[0]], np.r_[part[asks], pairs[1]].astype(np.int32),
            np.r_[doc[asks], pairs[2]], np.r_[part[asks], pairs[3]].astype(np.int32), np.r_[np.full(asks.sum(), ALONE), zero + KNOWN].astype(np.int8),
        ]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["route", "more", "doc_id", "part", "first", "first_part", "state"])


def _recurring_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, first, first_part): parts with a window that starts in a document with a smaller id too, and the first
    such part. Rows come sorted by route, more, doc_id and part: a window's first row has its first part, and is all that is kept of it."""
    rest = None
    for cols in _columns(batches):
        c = _after(rest, cols)
        start, group = _groups(c["route"], c["more"], c["state"])
        alone = c["state"] == ALONE
        first, first_part = c["doc_id"][start][group], c["part"][start][group]
        take = ~alone | (first < c["doc_id"])
        found = np.stack([c["doc_id"], c["part"], np.where(alone, first, c["first"]), np.where(alone, first_part, c["first_part"])]).astype(np.int64)[:, take]
        last = np.flatnonzero((group == group[-1]) & alone)[:1]
        rest = {n: v[last] for n, v in c.items()}
        found = np.unique(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3].astype(np.int32))], ["doc_id", "part", "first", "first_part"])


def _excerpts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each part asked for, once per group that asks for it."""
    names = ["first", "first_part", "salt", "member", "doc_id", "whole", "part", "words"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    for batch in chunks(batches):
        rows: list[tuple] = []
        size = 0
        for doc_id, words, asks in zip(batch.column("doc_id").to_pylist(), _split(batch.column("text")), batch.column("asks"), strict=True):
            whole = _digest(words)
            for ask in asks.as_py():
                at = ask["part"] * PART
                own = b" ".join(words[at : at + PART + WINDOW - 1])
                rows.append((ask["first"], ask["first_part"], ask["salt"], ask["member"], doc_id, whole, ask["part"], own))
                size += len(own)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def passages(first: np.ndarray, first_ends: np.ndarray, members: np.ndarray, member_ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Distinct (start, end) in ``first`` of the passages that ``members`` share with it.

    Both are numbers of words, texts one after another. A passage is a run of windows that
    follow one another in a member and in the first part."""

    def windows(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(len(numbers) - window + 1, 0))
        at = at[ends[np.searchsorted(ends, at, side="right")] >= at + window] if len(at) else at
        spread = mix(numbers.astype(np.uint64) + ODD)
        g = np.zeros(len(at), np.uint64)
        for j in range(window):
            g = g * BASE + spread[at + j]
        return at, mix(g)

    f_at, f_key = windows(first, first_ends)
    at, key = windows(members, member_ends)
    if not len(f_at) or not len(at):
        return np.zeros((0, 2), np.int64)
    known, where = np.unique(f_key, return_index=True)
    place = np.searchsorted(known, key).clip(max=len(known) - 1)
    hit = known[place] == key
    at, source = at[hit], f_at[where[place[hit]]]
    if not len(at):
        return np.zeros((0, 2), np.int64)
    starts = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(source) != 1)])
    stops = np.r_[starts[1:], len(at)] - 1
    return np.unique(np.stack([source[starts], source[stops] + window], 1), axis=0)


def as_characters(numbers: np.ndarray) -> str:
    """One character per word, outside the surrogates."""
    return (numbers + 0xE000).astype("<u4").tobytes().decode("utf-32-le")


def compile_automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    """Automaton that tells the length of each phrase where it ends."""
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    automaton.make_automaton()
    return automaton


def occurrences(firsts: list[bytes], members: list[bytes]) -> list[list[tuple[int, int]]]:
    """(start, end) in words, of all passages of ``firsts`` in each of ``members``, as the automaton finds them."""
    ids: dict[bytes, int] = {}
    numbers = [np.array([ids.setdefault(w, len(ids)) for w in text.split()], np.int64) for text in [*firsts, *members]]
    own, others = numbers[: len(firsts)], numbers[len(firsts) :]
    together = np.concatenate(own)
    shared = passages(together, np.cumsum([len(x) for x in own]), np.concatenate(others), np.cumsum([len(x) for x in others]))
    if not len(shared):
        return [[] for _ in members]
    text = as_characters(together)
    automaton = compile_automaton({text[a:b] for a, b in shared.tolist()})
    found = []
    for x in others:
        spans: list[tuple[int, int]] = []
        for end, size in automaton.iter(as_characters(x)):
            a, b = end + 1 - size, end + 1
            while spans and a <= spans[-1][1]:
                last = spans.pop()
                a, b = min(a, last[0]), max(b, last[1])
            spans.append((a, b))
        found.append(spans)
    return found


def _locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, whole, starts, ends) of what recurs in each member, for rows sorted by group, firsts before members."""
    group: list[dict] = []

    def close() -> pa.RecordBatch:
        firsts, members = ([r for r in group if r["member"] == m] for m in (False, True))
        out = []
        if firsts and members:
            spans = occurrences([r["words"] for r in firsts], [r["words"] for r in members])
            out = [(r["doc_id"], r["whole"], [a + r["part"] * PART for a, _ in s], [b + r["part"] * PART for _, b in s]) for r, s in zip(members, spans, strict=True) if s]
        group.clear()
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], ["doc_id", "whole", "starts", "ends"])

    key = None
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["first"], row["first_part"], row["salt"])
            if now != key:
                if group:
                    yield close()
                key = now
            group.append(row)
    if group:
        yield close()


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        lists = _split(batch.column("text"))
        copies = batch.column("copy").to_pylist()
        removed, kept = [], []
        for words, copy, found in zip(lists, copies, batch.column("found"), strict=True):
            n = len(words)
            if copy and n >= WINDOW:
                words = []
            elif len(found):
                whole = _digest(words)
                cover = np.zeros(n + 1, np.int64)
                for own in found.as_py():
                    if own["whole"] == whole:  # rows that share an id are told apart by their words
                        np.add.at(cover, own["starts"], 1)
                        np.add.at(cover, own["ends"], -1)
                words = [w for w, c in zip(words, np.cumsum(cover)[:-1].tolist(), strict=True) if not c]
            removed.append(n - len(words))
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in lists], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: one row per row of ``docs (doc_id, text)``.

    A word goes if a 13-word window over it has a word sequence that starts in a document
    with a smaller ``doc_id`` too; windows are judged on the input. ``kept_sha256`` is of the
    words left, joined by one space.

    * null and empty texts: no words; texts under 13 words lose none
    * null ``doc_id``: neither first nor later; such rows lose nothing
    * rows that repeat a ``doc_id`` are one document as far as order goes: none of them makes
      another of them lose words, each is judged by its own text
    * an empty table gives an empty result; other columns are ignored
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":  # an alias would keep Spark from sharing the exchange
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text")
    whole = stage(docs.mapInArrow(_fingerprints, "doc_id long, n_words long, whole binary"), "fingerprints").filter(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
    # written, so that the join below can split a word sequence that very many documents share
    first = stage(whole.groupBy("whole").agg(F.min("doc_id").alias("first")), "firsts")
    # an id with several texts is never treated as a copy
    info = whole.join(first, "whole").groupBy("doc_id").agg((F.max("first") < F.col("doc_id")).alias("copy"))
    info = stage(info, "copies")
    dealt = docs.filter("doc_id IS NOT NULL").repartition("doc_id")  # one exchange of texts, which all steps share
    fresh = dealt.join(info.filter("NOT copy").select("doc_id"), "doc_id")
    hints = (
        fresh.mapInArrow(_anchor_rows, "route long, key long, doc_id long, state byte")
        .repartition("route")
        .sortWithinPartitions("route")
        .mapInArrow(_recurring_anchors, "doc_id long, key long")
        .groupBy("doc_id")
        .agg(F.collect_list("key").alias("hints"))
    )
    pairs = (
        dealt.join(hints, "doc_id")
        .mapInArrow(_window_rows, "route long, more long, doc_id long, part int, first long, first_part int, state byte")
        .repartition("route")
        .sortWithinPartitions("route", "more", "state", "doc_id", "part")
        .mapInArrow(_recurring_parts, "doc_id long, part int, first long, first_part int")
        .distinct()
    )
    pairs = stage(pairs, "pairs")
    groups = stage(pairs.groupBy("first", "first_part").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "groups")
    names = ["part", "first", "first_part", "salt", "member"]
    members = pairs.join(groups, ["first", "first_part"]).withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, part), salts) AS int)")).withColumn("member", F.lit(True))
    heads = groups.select("first", "first_part", F.col("first").alias("doc_id"), F.col("first_part").alias("part"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(False).alias("member"))
    # a first part of very many groups asks in bundles, so that no list grows with them
    asks = members.select("doc_id", *names).union(heads.select("doc_id", *names)).groupBy("doc_id", F.expr("salt div 1000 AS bundle")).agg(F.collect_list(F.struct(*names)).alias("asks"))
    located = (
        dealt.join(stage(asks.select("doc_id", "asks"), "asks"), "doc_id")
        .mapInArrow(_excerpts, "first long, first_part int, salt int, member boolean, doc_id long, whole binary, part int, words binary")
        .repartition("first", "first_part", "salt")
        .sortWithinPartitions("first", "first_part", "salt", "member")
        .mapInArrow(_locate, "doc_id long, whole binary, starts array<int>, ends array<int>")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("whole", "starts", "ends")).alias("found"))
    )
    known = info.join(located, "doc_id", "left").select(F.col("doc_id").alias("id"), "copy", "found")
    nothing = F.array().cast("array<struct<whole:binary,starts:array<int>,ends:array<int>>>")
    judged = dealt.join(known, dealt["doc_id"] == known["id"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("found", nothing).alias("found"))
    no_id = docs.filter("doc_id IS NULL").select("doc_id", "text", F.lit(False).alias("copy"), nothing.alias("found"))
    return judged.union(no_id).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
