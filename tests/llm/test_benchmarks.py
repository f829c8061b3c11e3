"""Alignment, decontamination and search against brute force, and their defined results on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import alignment, decontamination, search
from cadenza.llm.phrases import Phrases, terms
from cadenza.llm.queries import tokenizer_path
from cadenza.llm.textarrays import Words

from .conftest import EDGE_ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BYTES, PIECES = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same(got, wanted):
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, wanted))


# phrases


def test_phrases_are_found_and_confirmed(monkeypatch):
    texts = ["The CAT\tsat; on the mat", None, "", "é É cat sat", "cat--sat\x00on 9Lives"]
    w = terms(pa.array(["skip", *texts])[1:])
    assert [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])] == [split(t) for t in texts]
    for collide in (False, True):  # with every hash alike, bytes alone tell phrases apart
        if collide:
            monkeypatch.setattr(Words, "grams", lambda self, n: (np.zeros(max(0, len(self.start) - n + 1), np.uint64), self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]))
        asked = terms(pa.array(["cat sat", "on the", "sat on", "cat sat"]))
        phrases = Phrases(asked, asked.first[:-1], 2)
        assert phrases.size == 3 and phrases.number[0] == phrases.number[3]
        at, number = phrases.find(w)
        names = {int(n): ["cat sat", "on the", "sat on"][i] for i, n in enumerate(phrases.number[:3])}
        assert sorted((int(w.doc[a]), names[int(n)]) for a, n in zip(at, number)) == [(0, "cat sat"), (0, "on the"), (0, "sat on"), (3, "cat sat"), (4, "cat sat"), (4, "sat on")]


# 12

ITEMS = [(1, "One TWO three four five six seven eight nine ten eleven twelve"), (10, "three four five six seven eight nine ten eleven twelve thirteen"), (2, "short one"), (2, "Other words"), (3, None), (4, " .,; "), (None, "nameless item"), (5, "short one"), (6, "ÉCOLE Été")]
DOCS = [
    (1, "zero one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "a Short, one; and other-words. nameless item"), (3, None), (4, ""), (5, "one two three four five six seven eight nine"),
    (6, "École été! École ÉTÉ"), (6, "École Été; clean"), (None, "short one two"), (7, "x " * 3000 + "short one " + "y " * 3000), (1, "zero one two three four five six seven eight nine ten eleven twelve thirteen"),
]


def brute_scan(docs, items, n=10):
    held = defaultdict(set)
    for item, text in items:
        w = split(text)
        for p in range(max(0, len(w) - n + 1)) if len(w) >= n else [0] * bool(w):
            held[tuple(w[p : p + n])].add(item)
    sizes = {len(k) for k in held}
    for doc, text in docs:
        w = split(text)
        hit, names = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (own := held.get(tuple(w[p : p + k]))) is not None:
                    hit |= set(range(p, p + k))
                    names |= {str(i) for i in own if i is not None}
        yield {"doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(names), "items": sorted(names), "items_sha256": hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), "contaminated": bool(hit)}


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_scan_is_that_of_all_windows(spark, edge, empty, most_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    same(rows_of(decontamination.scan(docs, items, most_bytes=most_bytes)), brute_scan(DOCS, ITEMS))
    odd = edge.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 60).alias("text"))
    same(rows_of(decontamination.scan(edge, odd, most_bytes=most_bytes)), brute_scan([r[:2] for r in EDGE_ROWS], [(r[0], r[1] and r[1][:60]) for r in EDGE_ROWS]))
    assert decontamination.scan(empty, items, most_bytes=most_bytes).count() == 0
    nothing = rows_of(decontamination.scan(docs, items.limit(0), most_bytes=most_bytes))
    assert len(nothing) == len(DOCS) and not any(r["contaminated"] for r in nothing)


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_spans_and_documents_are_removed(spark, most_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, digest string").repartition(2)
    texts = Counter(r["text"] for r in rows_of(decontamination.remove_spans(docs, items, most_bytes=most_bytes)))
    assert texts == Counter(["zero "] * 2 + ["a ; and ", None, "", DOCS[4][1], DOCS[5][1], "; clean", " two", "x " * 3000 + " " + "y " * 3000])
    kept = rows_of(decontamination.drop_contaminated(docs, items, most_bytes=most_bytes))
    assert sorted(r["doc_id"] for r in kept) == [3, 4, 5, 6] and all(r["digest"] == "x" for r in kept)
    assert {r["doc_id"] for r in rows_of(decontamination.drop_contaminated(docs, items, most_share=0.7, most_bytes=most_bytes))} == {3, 4, 5, 6, 7, None}


# 13


def brute_search(docs, items, k=50):
    lists = [(doc, Counter(split(text))) for doc, text in docs]
    lists = [(doc, c) for doc, c in lists if c]
    n_docs, n_words = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(split(text))
    for item, own in asked.items():
        found = []
        for doc, c in lists:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score:
                found.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1):
            yield {"item_id": item, "rank": rank, "doc_id": doc, "score": -score}


@pytest.mark.parametrize(("most_bytes", "segment", "k"), [(1 << 20, 1 << 20, 50), (200, 3000, 3)])
def test_search_is_that_of_all_documents(spark, docs, edge, empty, most_bytes, segment, k):
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    own = [(r["item_id"], r["text"]) for r in asked.limit(8).collect()] + [(2, "Zwei dritte"), (None, "the of and"), (77, None), (78, "never-seen-anywhere")]
    queries = spark.createDataFrame(own, "item_id long, text string")
    all_docs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(rows_of(search.search(docs.repartition(3), queries, k, most_bytes, segment)), brute_search(all_docs, own, k))
    odd = [(1, "word1x1 lorem token"), (2, "one two é"), (3, "")]
    same(rows_of(search.search(edge, spark.createDataFrame(odd, "item_id long, text string"), k, most_bytes, segment)), brute_search([r[:2] for r in EDGE_ROWS], odd, k))
    assert search.search(empty, queries, k, most_bytes, segment).count() == 0
    assert search.search(docs, queries.limit(0), k, most_bytes, segment).count() == 0


def test_long_lists_are_skipped():
    rng = np.random.default_rng(5)
    n = 4000
    docs = lambda m: np.sort(rng.choice(n, m, replace=False))
    lists = [(docs(m), rng.integers(1, top, m)) for m, top in ((40, 90_000), (120, 60_000), (3500, 900), (3900, 500), (2000, 1500))]
    best = search.Best(10)
    looked = search.rank_segment(lists, n, np.arange(n)[::-1].copy(), np.ones(n, bool), best)
    total = np.zeros(n, np.int64)
    for d, s in lists:
        total[d] += s
    wanted = sorted(zip(-total, n - 1 - np.arange(n)))[:10]
    assert [(-int(s), int(i)) for s, i in zip(best.score, best.id)] == [(int(s), int(i)) for s, i in wanted]
    assert looked < 200  # of 9,400 places


# 11

ODD_TEXTS = [
    "", None, " ", "word", " lead", "two  spaces\n\nand\tlines \n", "a▁b", "<|endoftext|> <s> </s> <0x41> <unk>", "tab\t x\t  y\r\n\r\n z", "don't they're I'LL", "\x00a \x1c b\x85c", "日本語のテキスト 中文，没有空格", "é é ﬁ ½ ‍👩‍👧 🇩🇪",
    "x" * 300 + " " + "=" * 2000, "\nstart", "end ", "   nbsp em 　", "1234567 89,000.5", "AbCdEf gHiJkL" * 40, "\r\r\n \n\r", "ünïcödé " * 50,
]


def brute_align(docs):
    a, b = alignment.ByteTokenizer(BYTES), alignment.PieceTokenizer(PIECES)
    out, held = [], Counter()
    for doc, text in docs:
        groups, pairs = [], Counter()
        ids = (a.tokenizer.encode(f" {text}", add_special_tokens=False).ids, b.model.encode(text)) if text else ([], [])
        joined = [b"".join(t.bytes[i] for i in own) for t, own in zip((a, b), ids)]
        if not text or joined != [f" {text}".encode()] * 2:
            ids = ([], [])
        ends = [np.cumsum([len(t.bytes[i]) for i in own]).tolist() for t, own in zip((a, b), ids)]
        i = j = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((ids[0][i:p], ids[1][j:q]))
            i, j = p, q
        for x, y in groups:
            pairs.update((u, v) for u in x for v in y)
        held.update(pairs.keys())
        out.append((doc, ids, groups, pairs))
    most = defaultdict(int)
    for (u, _), n in held.items():
        most[u] = max(most[u], n)
    for doc, ids, groups, pairs in out:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield {
            "doc_id": doc, "n_a": len(ids[0]), "n_b": len(ids[1]), "n_groups": len(groups), "n_links": sum(pairs.values()), "n_best": sum(n for p, n in pairs.items() if held[p] == most[p[0]]), "count_sum": sum(n * held[p] for p, n in pairs.items()),
            "groups_sha256": hashlib.sha256(text.encode()).hexdigest() if groups else "",
        }


@pytest.mark.parametrize("most_pairs", [1_000_000, 40, 0])
def test_alignment_is_that_of_whole_texts(spark, docs, edge, empty, most_pairs):
    texts = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(3)
    same(rows_of(alignment.align(table, BYTES, PIECES, most_pairs)), brute_align(texts))
    same(rows_of(alignment.align(edge, BYTES, PIECES, most_pairs)), brute_align([r[:2] for r in EDGE_ROWS]))
    assert alignment.align(empty, BYTES, PIECES, most_pairs).count() == 0


def test_units_give_the_ids_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    marks = ["word", "Été", "1", "'s", "▁", " ", "  ", "\n", "\t", "\r", " ", "日本", ",", "<s>", "ing", "\x1c", "é"]
    texts = ["".join(rng.choice(marks, rng.integers(1, 14))) for _ in range(3000)]
    monkeypatch.setattr(alignment, "MOST_UNITS", 500)  # it forgets on the way
    aligner = alignment.Aligner(BYTES, PIECES)
    got = [(*x[0].tolist(), x[1]) for k in range(0, len(texts), 100) for x in aligner.align(texts[k : k + 100])]
    assert got == [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in brute_align(enumerate(texts))]


def test_wide_groups_count_distinct_ids():
    a, b = np.array([7] * 100 + [8]), np.array([3] * 60 + [4])
    group, pair, times = alignment.links(a, b, np.array([101]), np.array([61]))
    assert dict(zip(pair.tolist(), times.tolist())) == {7 << 32 | 3: 6000, 7 << 32 | 4: 100, 8 << 32 | 3: 60, 8 << 32 | 4: 1}
