"""Secret scans with corpus-wide ownership frequency.

A first pass finds spans by pattern and candidate strings in every text. Candidates are
hashed and aggregated over the corpus: in how many repositories and by how many owners does
each occur? A string that several owners hold is a copied example; one that stays with one
owner and looks random is live. Generic candidates of the second sort become spans of kind
``owned``; the verdict on the values of the pattern spans is returned beside them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Fixed patterns of the task, in the order in which kinds are listed, and the least length of what counts.
ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "owned")

#: Dots inside belong to a candidate (header.payload.signature); dots around it, and marks after these, are punctuation.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=.-]{20})[A-Za-z0-9+/_=-]+(?:\.+[+/_=-]*[A-Za-z0-9][A-Za-z0-9+/_=-]*)*")
LEAST_CANDIDATE = 20
#: A live-looking string: a digit and a letter, and bits per character at least so.
LEAST_ENTROPY = 3.5
#: At most so many owners and repositories hold an owner-specific string.
MOST_OWNERS, MOST_REPOSITORIES = 1, 3

SPAN = "struct<kind:int,start:int,stop:int,hash:binary>"


def entropy(text: str) -> float:
    share = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)[1] / len(text)
    return float(-(share * np.log2(share)).sum())


def looks_random(text: str) -> bool:
    classes = sum(bool(re.search(c, text)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return classes >= 2 and bool(re.search("[0-9]", text)) and entropy(text) >= LEAST_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, value) of the pattern spans, by start, then kind."""
    found = [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], s[0]))


def other_candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking strings that no pattern span touches."""
    starts = [s[1] for s in taken]
    ends = [0, *accumulate((s[2] for s in taken), max)]  # of the spans before each, the furthest end
    free = lambda a, b: ends[bisect_left(starts, b)] <= a
    return [(3, *m.span(), m[0]) for m in CANDIDATE.finditer(text) if m.end() - m.start() >= LEAST_CANDIDATE and free(*m.span()) and looks_random(m[0])]


def digest(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = []
            for value in part.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                rows.append([{"kind": k, "start": a, "stop": b, "hash": digest(v)} for k, a, b, v in [*base, *other_candidates(text, base)]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), part.column("owner"), part.column("repository"), pa.array(rows, pa.list_(span))], ["doc_id", "row_key", "owner", "repository", "found"])


def _listed(spans: str) -> Column:
    name = "element_at(array('assign', 'access', 'hex', 'owned'), s.kind + 1)"
    return F.expr(f"array_join(transform({spans}, s -> concat({name}, ':', s.start, ':', s.stop)), ',')")


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_repositories, n_owners`` from ``candidates (hash, owner, repository)``.

    Both counts go through distinct (hash, owner, repository) rows, so a string that a third
    of the corpus holds is combined before every shuffle. Null owners count as one owner.
    """
    known = candidates.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    by_owner = known.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_owned, n_live, n_example``.

    ``owner`` and ``repository`` are columns over ``docs`` that say who holds a document
    (a repository belongs to its owner). Positions are code points, ends exclusive.
    ``n_live`` and ``n_example`` split all spans by ownership frequency.

    * null and empty texts have no spans; very long ones are scanned whole
    * null ids, owners and repositories are values like others
    * rows that repeat id and text get the same answer each
    * an empty table gives an empty result; other columns are ignored
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), owner.cast("string").alias("owner"), F.concat_ws("/", owner, repository).alias("repository"), "text")
    found = stage(rows.mapInArrow(_scan, f"doc_id long, row_key long, owner string, repository string, found array<{SPAN}>"), "spans")
    each = found.filter("size(found) > 0").select("doc_id", "row_key", "owner", "repository", F.explode("found").alias("span"))
    # written, so that the join can split a string that very many documents hold
    often = stage(ownership(each.select("span.hash", "owner", "repository")), "ownership")
    live = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_REPOSITORIES)
    judged = (
        each.select("doc_id", "row_key", "span", F.col("span.hash").alias("hash"))
        .join(often.filter(live).select("hash"), "hash")  # what many hold never meets the join
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("span.start", "span.kind")).alias("live"))
        .withColumnsRenamed({"doc_id": "__id", "row_key": "__key"})
    )
    out = found.join(judged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key")), "left")
    out = out.withColumn("live", F.expr("coalesce(live, array())"))
    out = out.withColumn("base", F.expr("filter(found, s -> s.kind < 3)"))
    out = out.withColumn("owned", F.expr("filter(found, s -> s.kind = 3 AND array_contains(live, struct(s.start AS start, s.kind AS kind)))"))
    # the text's spans come by start; owned ones touch no other
    out = out.withColumn("all", F.expr("array_sort(concat(base, owned), (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE a.kind - b.kind END)"))
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.kind = {kind})) AS bigint)")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"),
        F.expr("cast(size(owned) AS bigint)").alias("n_owned"), F.expr("cast(size(live) AS bigint)").alias("n_live"), F.expr("cast(size(found) - size(live) AS bigint)").alias("n_example"),
    )
