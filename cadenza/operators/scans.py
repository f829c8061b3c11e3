"""Scans over series that are longer than a task: blocks of frames, what they add up to, and rows around their ends.

Blocks are told by frame number, so a series spreads over as many tasks as it has blocks; only
a row per block is put in order by one task of its series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block.
BLOCK = 1 << 16


def block_of(at: str, block: int) -> Column:
    return F.floor(F.col(at) / block)


def running_sums(rows: DataFrame, columns: dict[str, str | Column], at: str = "frame_idx", block: int = BLOCK) -> DataFrame:
    """``rows`` with, for each name of ``columns``, the sum of that column up to the row in its series (by ``at``): inside its block, and of all blocks before."""
    rows = rows.withColumn("__block", block_of(at, block))
    given = {name: F.col(c) if isinstance(c, str) else c for name, c in columns.items()}
    totals = rows.groupBy("track_id", "__block").agg(*(F.sum(c).alias(name) for name, c in given.items()))
    before = Window.partitionBy("track_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("track_id").alias("__track"), F.col("__block").alias("__b"), *(F.sum(name).over(before).alias(f"__{name}") for name in given))
    inside = Window.partitionBy("track_id", "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({name: F.sum(c).over(inside) for name, c in given.items()})
    joined = rows.join(offsets, F.col("track_id").eqNullSafe(F.col("__track")) & (F.col("__block") == F.col("__b")))
    joined = joined.withColumns({name: F.when(F.col(f"__{name}").isNull(), F.col(name)).otherwise(F.col(f"__{name}") + F.coalesce(name, F.lit(0))) for name in given})
    return joined.drop("__block", "__track", "__b", *(f"__{name}" for name in given))


def in_blocks(rows: DataFrame, near: Callable[[DataFrame], DataFrame], before: int, after: int, at: str = "frame_idx", block: int = BLOCK) -> DataFrame:
    """``near(rows)`` block by block. ``near`` adds columns by windows of a ``track_id`` in order of ``at`` that reach at most
    ``before`` rows back and ``after`` ahead; a block has so many rows of its neighbours with it, which go again.

    Numbers of a series must be dense, as those of frames are."""
    if max(before, after) > block:
        raise ValueError(f"a reach of {max(before, after)} rows doesn't fit a block of {block}")
    own, place = block_of(at, block), F.pmod(F.col(at), F.lit(block))
    copies = F.array_compact(F.array(own, F.when(place < after, own - 1), F.when(place >= block - before, own + 1)))
    rows = rows.withColumn("__own", own).withColumn("__block", F.explode(copies)).withColumn("track_id", F.struct(F.col("track_id").alias("track"), F.col("__block").alias("block")))
    return near(rows).filter("__own = __block").withColumn("track_id", F.col("track_id.track")).drop("__own", "__block")
