"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Inside a source, the expected number of copies of a
document grows with its size class (the power of two at or below its number of words), by the
fourth root, up to the largest number of copies, so that the expected words of the source are
its target. The whole part is allocated to the document, the rest is its inclusion
probability. Pareto order sampling ranks the documents of a source by the odds of a uniform
number (from a hash of the id, so reruns agree) divided by the odds of inclusion, and takes
them in this order up to the words wanted. Where a source's order is cut is found by sums over
slices of the rank, each step inside the one slice where the sum crosses the target, so that
no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
SEED = "mix-1"
#: Each step cuts the slice in question into so many; the rows left after the last are ordered.
SLICES, STEPS = 1024, 3


def n_words(text: str | Column = "text") -> Column:
    """Number of words, 0 for null: each starts where white space (or the start) meets something else."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    spaced = F.regexp_replace(padded, r"[\x20\x09-\x0D]+", " ")
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - F.when(F.endswith(spaced, F.lit(" ")), 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``sizes (source, size)``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share ``share``
    times all sizes; no target is above ``cap`` times its source's size, what is left over
    goes to the others by weight. With a common level t, targets are min(cap * size, weight * t):
    sources are full in the order of cap * size / weight, and t follows from running sums.
    """
    one = Window.partitionBy(F.lit(1))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = one.orderBy("ratio", F.col("source").asc_nulls_last())
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("double"))
        .withColumn("most", cap * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("goal", F.least(F.lit(share), F.lit(float(cap))) * F.sum("source_size").over(one))
        .withColumn("before", F.sum("most").over(full) - F.col("most"))
        .withColumn("open", F.sum("weight").over(one) - F.sum("weight").over(full) + F.col("weight"))
        # the level if all sources before this one are full and this one is not; levels fall from the first that holds on
        .withColumn("level", (F.col("goal") - F.col("before")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(one))
        .select("source", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("level"), F.col("most"))).alias("target"))
    )


def size_class(size: Column) -> Column:
    """Binary digits of the size: 0 for 0, k + 1 for 2^k up to 2^(k + 1) - 1."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def expected_copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, class, source_size, target, whole, p, wanted`` from ``sizes (source, size)``.

    Of a document of the class, ``whole`` copies are certain and one more has probability
    ``p``; ``wanted`` is how many words of a source's target the certain copies leave.
    With a common level t in a source, expected copies are min(cap, t * growth of the class), and
    t follows from running sums over the classes, largest growth first, as for :func:`targets`.
    """
    goals = targets(sizes, weights, share, cap)
    by_class = sizes.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    growth = F.sqrt(F.sqrt(F.pow(F.lit(2.0), F.greatest(F.col("class") - 1, F.lit(0)))))
    own = Window.partitionBy("source")
    larger, smaller = own.orderBy(F.desc("class")), own.orderBy("class")
    level = F.try_divide(F.col("target") - cap * (F.sum("words").over(larger) - F.col("words")), F.sum("mass").over(smaller))
    copies = F.least(F.lit(float(cap)), F.col("growth") * F.coalesce("level", F.lit(float(cap))))
    copies = F.when(F.col("target") >= cap * F.col("source_size"), float(cap)).otherwise(copies)
    near = F.abs(F.col("expected") - F.round("expected")) < 1e-9
    return (
        by_class.join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("growth", growth)
        .withColumn("mass", F.col("growth") * F.col("words"))
        # the level if all classes above this one are full and this one is not
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("growth") <= cap, F.col("level"))).over(own))
        .withColumn("expected", copies)
        .withColumn("expected", F.when(near, F.round("expected")).otherwise(F.col("expected")))
        .withColumn("whole", F.floor("expected"))
        .withColumn("wanted", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own))
        .select("source", "class", "source_size", "target", F.col("whole").cast("long").alias("whole"), (F.col("expected") - F.col("whole")).alias("p"), "wanted")
    )


def uniform(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 digest of seed and id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cuts(ranked: DataFrame) -> DataFrame:
    """``s, cut, last``: each source takes its documents in slices before ``cut``, and of that slice those up to ``last``
    (rank, id and size; null: none).

    ``ranked (source, doc_id, size, rank, slice, wanted)``."""
    left, cuts = ranked, None
    for step in range(STEPS):
        bits = 10 * (STEPS - 1 - step)
        sums = left.groupBy("source", "wanted", F.shiftright("slice", bits).alias("part")).agg(F.sum("size").alias("words"))
        if cuts is not None:
            sums = sums.join(cuts.select("s", "before"), _same("source", "s"))
        base = F.lit(0).cast("long") if cuts is None else F.col("before")
        own = Window.partitionBy("source")
        reached = sums.withColumn("upto", base + F.sum("words").over(own.orderBy("part"))).withColumn("end", F.max("part").over(own))
        # the first part with which the sum reaches what is wanted, or the last one
        crossing = reached.filter((F.col("upto") >= F.col("wanted")) | (F.col("part") == F.col("end")))
        first = crossing.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
        cuts = stage(first.select("s", F.col("c.part").alias("cut"), F.col("c.before").alias("before")), "cuts")
        left = left.join(cuts.select("s", "cut"), _same("source", "s") & (F.shiftright("slice", bits) == F.col("cut"))).drop("s", "cut")
    # equal rows are taken together, so they are one row here
    inside = left.groupBy("source", "wanted", "rank", "doc_id", "size").agg(F.sum("size").alias("words")).join(cuts.select("s", "before"), _same("source", "s"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size"))
    taken = inside.withColumn("upto", upto).filter(F.col("upto") - F.col("words") / 2 <= F.col("wanted"))
    last = taken.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size")).alias("last"))
    # a row per source, written, so that its size is known before every document is joined to it
    return stage(cuts.join(last, _same("s", "source"), "left").select("s", "cut", "last"), "last-taken")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``: one row per row of ``docs (doc_id, text, source)``.

    ``copies`` is how often the document is taken, a whole number up to ``cap``; ``taken``
    its words. A source's taken words miss its target by half of one document at most.

    * null text: size 0; null source: a source of its own, last in order
    * null ``doc_id`` and repeated ids: ranked like any other; equal ids share a random number
      and are told apart by size only, rows equal in both are taken together
    * documents of size 0 take nothing; a source of such documents has target 0
    * an empty table gives an empty result; other columns are ignored
    """
    return mix_sizes(_sizes(docs), weights, share, cap, seed)


def _sizes(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(docs["text"]).alias("size"))
    return stage(rows, "sizes")


def mix_sizes(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """:func:`mix_sources` for ``rows (doc_id, source, size)``."""
    return _mixed(rows, weights, share, cap, seed).drop("source")


def _mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    odds = stage(expected_copies(rows, weights, share, cap).withColumnsRenamed({"source": "s", "class": "c"}), "odds")
    u, p = F.col("u"), F.col("p")
    placed = (
        rows.join(odds, _same("source", "s") & (size_class(F.col("size")) == F.col("c")))
        .drop("s", "c")
        .withColumn("u", uniform(seed=seed))
        # odds of the number over odds of inclusion, brought to (0, 1) by x / (1 + x)
        .withColumn("rank", F.when((p > 0) & (F.col("size") > 0), u * (1 - p) / (u * (1 - p) + p * (1 - u))))
        .withColumn("slice", F.floor(F.col("rank") * SLICES**STEPS).cast("long"))
        .drop("u", "p")
    )
    placed = stage(placed, "ranked")
    cuts = _cuts(placed.filter("rank IS NOT NULL"))
    here = F.struct("rank", "doc_id", "size") <= F.col("last")
    more = F.coalesce((F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & here), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(more, 1).otherwise(0)).otherwise(0)
    return placed.join(cuts, _same("source", "s"), "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mix_sources` takes its document; all columns stay.

    * rows equal in id, source and size are taken together; rows that share an id only are
      taken each by its own source and size
    * null and empty texts are never taken; null ids and sources are values like others
    * an empty table gives an empty result; columns of any name come through unchanged
    """
    taken = _mixed(_sizes(docs), **options).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    # the input goes through as one struct, so that none of its names can clash
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), n_words(docs["text"]).alias("words"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
