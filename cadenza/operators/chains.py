"""Mix chains (C-01 to C-19)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as X
from ..sources.staging import stage
from .joins import nearest, overlapping

MOST_NODES, RADIUS_S, OVERLAP_S, SLACK = 100, 1.25, 16.0, 1e-6


def by_position() -> Window:
    return Window.partitionBy("mix_id").orderBy("pos")


#: Chains of more nodes are ranked by contraction.
LONG = 1000
#: Links that are ranked by pointer doubling, at most; more are contracted first.
REST = 1 << 16


def order_chains(mixes: DataFrame, mix_tracks: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(ordered nodes with ``pos`` from 0, problems ``mix_id, problem``).

    From the head, ``next_id`` leads to the end, to a node seen before (cycle) or to a name
    that no node has (dangling). Nodes that were missed are unreachable. A mix with a problem
    has no ordered nodes. Mixes of up to ``long`` nodes are followed by a fold over one map,
    longer ones by contraction, which keeps no mix in one task.
    """
    sizes = stage(mix_tracks.groupBy("mix_id").agg(F.count("*").alias("n")).filter(F.col("n") > long), "long-mixes")
    if sizes.isEmpty():
        return _follow(mixes, mix_tracks)
    is_long, heads = sizes.select("mix_id"), mixes.select(F.col("id").alias("mix_id"), "head_id")
    short_mixes = mixes.join(is_long.withColumnRenamed("mix_id", "id"), "id", "left_anti")
    nodes, problems = _follow(short_mixes, mix_tracks.join(is_long, "mix_id", "left_anti"))
    more, bad = _contract(heads.join(sizes, "mix_id"), mix_tracks.join(is_long, "mix_id", "left_semi"))
    return nodes.unionByName(more), problems.unionByName(bad)


def _follow(mixes: DataFrame, mix_tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes in order, problems) by a fold over the map of each mix, which holds the nodes whole: they are shuffled once."""
    rest = [c for c in mix_tracks.columns if c not in ("mix_id", "id", "next_id")]
    node = F.struct(F.coalesce("next_id", F.lit("")).alias("next"), *rest)
    links = mix_tracks.groupBy("mix_id").agg(F.map_from_entries(F.collect_list(F.struct("id", node.alias("node")))).alias("links"))
    start = mixes.select(F.col("id").alias("mix_id"), "head_id").join(links, "mix_id", "left")
    walk = F.expr(
        """aggregate(sequence(0, coalesce(size(links), 0)),
        named_struct('at', coalesce(head_id, ''), 'path', cast(array() AS array<string>), 'problem', cast(NULL AS string)),
        (s, i) -> CASE WHEN s.at = '' OR s.problem IS NOT NULL THEN s
            WHEN array_contains(s.path, s.at) THEN named_struct('at', s.at, 'path', s.path, 'problem', 'cycle')
            WHEN NOT coalesce(map_contains_key(links, s.at), false) THEN named_struct('at', s.at, 'path', s.path, 'problem', 'dangling')
            ELSE named_struct('at', links[s.at].next, 'path', array_append(s.path, s.at), 'problem', cast(NULL AS string)) END)"""
    )
    walked = start.withColumn("w", walk).withColumn("problem", F.coalesce("w.problem", F.when(F.size("w.path") < F.coalesce(F.size("links"), F.lit(0)), "unreachable")))
    problems = walked.filter("problem IS NOT NULL").select("mix_id", "problem")
    placed = walked.filter("problem IS NULL").select("mix_id", F.posexplode(F.expr("transform(w.path, at -> named_struct('id', at, 'node', links[at]))")).alias("pos", "n"))
    return placed.select("mix_id", "n.id", "pos", *(f"n.node.{c}" for c in rest)), problems


def _contract(mixes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes in order, problems) of ``mixes (mix_id, head_id, n)`` by list ranking.

    Nodes are sorted by id. Each batch of a task follows its own links, so a node knows where they leave
    the batch and how many nodes that is away. Only nodes that such exits lead to, and heads, are ranked among
    all; a node's rank from the end is its way to the exit and the rank of what the exit leads to. Ids that follow
    the chain, as numbers do, leave few exits a batch; ids in no order leave one a node."""
    nodes = stage(nodes, "long-nodes")
    near = nodes.repartitionByRange("mix_id", "id").sortWithinPartitions("mix_id", "id")
    rest = [c for c in nodes.columns if c != "next_id"]
    schema = T.StructType([nodes.schema[c] for c in rest] + [T.StructField("exit", T.StringType()), T.StructField("steps", T.LongType()), T.StructField("cycle", T.BooleanType())])
    near = stage(near.mapInArrow(_to_exits, schema), "exits")
    asked = near.filter("exit IS NOT NULL").select("mix_id", F.col("exit").alias("id")).unionByName(mixes.filter("head_id <> ''").select("mix_id", F.col("head_id").alias("id"))).distinct()
    ends = F.when(F.col("steps").isNull(), "dangling").when(F.col("cycle"), "cycle").when(F.col("exit").isNull(), "end")
    met = asked.join(near.select("mix_id", "id", "exit", "steps", "cycle"), ["mix_id", "id"], "left")
    met = stage(met.select(F.monotonically_increasing_id().alias("at"), "mix_id", "id", "exit", F.coalesce("steps", F.lit(0)).alias("rank"), ends.alias("ends")), "met")
    links = met.join(met.select("mix_id", F.col("id").alias("exit"), F.col("at").alias("to")), ["mix_id", "exit"], "left").select("at", "to", "rank", "ends")
    ranks = met.select("at", "mix_id", "id").join(_ranks(links), "at").drop("at")
    heads = mixes.join(ranks.select("mix_id", F.col("id").alias("head_id"), F.col("rank").alias("length"), "ends"), ["mix_id", "head_id"], "left")
    none = F.coalesce("head_id", F.lit("")) == ""
    problem = F.when(none, "unreachable").when(F.col("ends") != "end", F.col("ends")).when(F.col("length") < F.col("n"), "unreachable")
    heads = stage(heads.withColumn("problem", problem), "heads")
    placed = near.join(heads.filter("problem IS NULL").select("mix_id", "length"), "mix_id").join(ranks.select("mix_id", F.col("id").alias("exit"), "rank"), ["mix_id", "exit"], "left")
    pos = F.col("length") - F.col("steps") - F.coalesce("rank", F.lit(0))
    return placed.select("mix_id", "id", pos.cast("int").alias("pos"), *(c for c in rest if c not in ("mix_id", "id"))), heads.filter("problem IS NOT NULL").select("mix_id", "problem")


def _to_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without ``next_id``, with ``exit`` (where links lead out of the batch, null at an end), ``steps`` (how many
    nodes that is away) and ``cycle`` (they never do)."""
    for batch in batches:
        mix, ids, following = (batch.column(c).to_pylist() for c in ("mix_id", "id", "next_id"))
        at = {key: i for i, key in enumerate(zip(mix, ids))}
        to = np.array([at.get(key, -1) for key in zip(mix, following)], dtype=np.int64)
        steps, last = np.ones(len(to), dtype=np.int64), np.arange(len(to))
        for _ in range(len(to).bit_length()):
            open_ = np.flatnonzero(to >= 0)
            if not len(open_):
                break
            ahead = to[open_]
            steps[open_] += steps[ahead]
            last[open_], to[open_] = last[ahead], to[ahead]
        cycle = to >= 0
        exits = pa.array([None if c else following[i] or None for i, c in zip(last.tolist(), cycle.tolist())], type=pa.string())
        names = [c for c in batch.schema.names if c != "next_id"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), exits, pa.array(steps), pa.array(cycle)], names=[*names, "exit", "steps", "cycle"])


def _ranks(links: DataFrame) -> DataFrame:
    """``at, rank, ends`` of ``links (at, to, rank, ends)``: the ranks on the way from ``at`` to where ``to`` is null, added, and the ``ends`` there; 'cycle' if the way never ends.

    Each round, a quarter of the links step aside: those with a one by a coin whose ``to`` has a zero, so that
    it stays. Links that led to them take over theirs. So rounds shrink like a geometric series and
    all of them together read and write a few times the links. What is left is ranked by doubling; then those that
    stepped aside find their ranks, the last first."""
    loop = F.coalesce(F.col("to") == F.col("at"), F.lit(False))
    closed = lambda df: df.select("at", F.when(~loop, F.col("to")).alias("to"), "rank", F.when(loop, "cycle").otherwise(F.col("ends")).alias("ends"))
    links, aside = stage(closed(links), "links"), []
    while links.count() > REST:
        one = lambda c, k=len(aside): F.xxhash64(F.col(c), F.lit(k)).bitwiseAND(F.lit(1).cast("long")) == 1
        goes, waits = one("at") & (F.col("to").isNull() | ~one("to")), F.col("to").isNotNull() & one("to")
        aside.append(links.filter(goes))
        links = stage(closed(links.filter(~goes & ~waits).unionByName(_over(links.filter(~goes & waits), aside[-1]))), "links")
    known = [_double(links)]
    for gone in reversed(aside):
        told = reduce(DataFrame.unionByName, known).select("at", F.lit(None).cast("long").alias("to"), "rank", "ends")
        found = gone.filter("to IS NULL").unionByName(_over(gone.filter("to IS NOT NULL"), told))
        known.append(stage(found.select("at", "rank", "ends"), "ranks"))
    return reduce(DataFrame.unionByName, known)


def _over(links: DataFrame, ahead: DataFrame) -> DataFrame:
    """``links`` that lead to one of ``ahead`` lead to where that leads; others stay."""
    ahead = ahead.select(F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("rank").alias("further"), F.col("ends").alias("then"))
    met = F.col("further").isNotNull()
    return links.join(ahead, "to", "left").select("at", F.when(met, F.col("beyond")).otherwise(F.col("to")).alias("to"), (F.col("rank") + F.coalesce("further", F.lit(0))).alias("rank"), F.when(met, F.col("then")).otherwise(F.col("ends")).alias("ends"))


def _double(links: DataFrame) -> DataFrame:
    """:func:`_ranks` by pointer doubling: each round, open links take over those of where they lead. What is open after
    as many rounds as double past all links leads round in a cycle."""
    for _ in range(links.count().bit_length()):
        if links.filter("to IS NOT NULL").isEmpty():
            break
        links = stage(links.filter("to IS NULL").unionByName(_over(links.filter("to IS NOT NULL"), links)), "links")
    return links.select("at", "rank", F.when(F.col("to").isNotNull(), "cycle").otherwise(F.col("ends")).alias("ends"))


def flatten_chains(ordered: DataFrame, variants: DataFrame, tracks: DataFrame) -> DataFrame:
    """``mix_id, pos, id, track_id, delta_beats, delta_s, offset_s, grid_bpm, duration_s``.

    A node lasts as long as its variant at that tempo, else its track, else 0; 0 counts as missing."""
    own = variants.groupBy("track_id").agg(F.collect_list(F.struct(F.col("grid_bpm").alias("at"), F.nullif("duration_s", F.lit(0.0)).alias("v"))).alias("own"))  # a few per track
    t = tracks.select(F.col("id").alias("track_id"), F.nullif("duration_s", F.lit(0.0)).alias("t")).join(own, "track_id", "full")
    rows = ordered.join(t, "track_id", "left").withColumn("v", F.expr("get(filter(own, x -> x.at = grid_bpm), 0).v")).withColumn("delta_s", X.beats_to_seconds("delta_beats", "grid_bpm"))
    return rows.select("mix_id", "pos", "id", "track_id", "delta_beats", "delta_s", F.sum("delta_s").over(by_position()).alias("offset_s"), "grid_bpm", F.coalesce("v", "t", F.lit(0.0)).alias("duration_s"))


def end() -> Column:
    return F.col("offset_s") + F.col("duration_s")


def overlap_violations(entries: DataFrame) -> DataFrame:
    """Nodes that the second next one reaches into: ``mix_id, pos, id, far_id``."""
    far, far_id = F.lead("offset_s", 2).over(by_position()), F.lead("id", 2).over(by_position())
    return entries.withColumn("far", far).withColumn("far_id", far_id).filter(F.col("far") < end() - SLACK).select("mix_id", "pos", "id", "far_id")


def min_delta_seconds() -> Column:
    """Least start of a node after its predecessor's, over entries."""
    prev_start, prev_end = F.lag("offset_s").over(by_position()), F.lag(end()).over(by_position())
    before_end = F.lag(end(), 2).over(by_position())
    next_delta = F.lead("delta_s").over(by_position())
    floor = F.greatest(prev_start, before_end, F.when(next_delta.isNotNull(), prev_end - next_delta))
    return F.greatest(F.lit(0.0), F.coalesce(floor - prev_start, F.lit(0.0)))


def min_delta_beats(entries: DataFrame) -> DataFrame:
    """Adds ``min_delta_beats``; 0 for the first node."""
    return entries.withColumn("__s", min_delta_seconds()).withColumn("min_delta_beats", F.when(F.col("pos") == 0, 0).otherwise(F.greatest(F.lit(0), X.seconds_to_beats("__s", "grid_bpm")))).drop("__s")


def apply_gap_edits(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of mixes after their ``edits (id, delta_beats)``, rejected edits with ``reason``).

    A mix whose edits break the overlap rule stays as it was; unknown nodes are rejected."""
    new = edits.select("id", F.col("delta_beats").alias("new"))
    edited = entries.join(new, "id", "left").withColumn("delta_beats", F.coalesce("new", "delta_beats")).withColumn("delta_s", X.beats_to_seconds("delta_beats", "grid_bpm"))
    edited = edited.withColumn("offset_s", F.sum("delta_s").over(by_position()))
    broken = overlap_violations(edited).select("mix_id").distinct()
    touched = edited.filter("new IS NOT NULL").select("mix_id").distinct()
    accepted = edited.join(touched, "mix_id", "left_semi").join(broken, "mix_id", "left_anti").select(entries.columns)
    overlapping = edited.filter("new IS NOT NULL").join(broken, "mix_id", "left_semi").select("id", F.lit("overlap").alias("reason"))
    unknown = edits.select("id").join(entries.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown node"))
    return accepted, overlapping.union(unknown)


def insert_nodes(chain: DataFrame, new: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """``chain (mix_id, pos, id, track_id, delta_s, duration_s)`` with at most one new node per mix, put at the
    clamped ``at`` of ``new (mix_id, at, id, track_id, delta_s, duration_s)``. Full mixes stay as they are."""
    size = chain.groupBy("mix_id").agg(F.count("*").alias("n"))
    put = new.join(size, "mix_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < most)
    put = put.withColumn("at", F.greatest(F.lit(0), F.least("at", "n")).cast("int")).withColumn("delta_s", F.greatest(F.lit(0.0), "delta_s"))
    moved = chain.join(put.select("mix_id", "at"), "mix_id", "left").withColumn("pos", F.when(F.col("pos") >= F.col("at"), F.col("pos") + 1).otherwise(F.col("pos"))).drop("at")
    cols = ["mix_id", "pos", "id", "track_id", "delta_s", "duration_s"]
    return moved.select(cols).unionByName(put.withColumn("pos", F.col("at")).select(cols))


def remove_nodes(chain: DataFrame, gone: DataFrame) -> DataFrame:
    """``chain`` without the nodes ``gone (id)``; others keep their gaps, a new first node's becomes 0."""
    left = chain.join(gone.select("id"), "id", "left_anti")
    place = F.row_number().over(Window.partitionBy("mix_id").orderBy("pos")) - 1
    left = left.withColumn("new", place)
    return left.withColumn("delta_s", F.when((F.col("new") == 0) & (F.col("pos") > 0), 0.0).otherwise(F.col("delta_s"))).withColumn("pos", F.col("new")).select(chain.columns)


def set_gap(chain: DataFrame, edits: DataFrame) -> DataFrame:
    """Gaps of ``edits (id, delta_s)``, at least 0."""
    new = edits.select("id", F.greatest(F.lit(0.0), "delta_s").alias("new"))
    return chain.join(new, "id", "left").withColumn("delta_s", F.coalesce("new", "delta_s")).select(chain.columns)


def set_start(chain: DataFrame, edits: DataFrame) -> DataFrame:
    """Absolute starts of ``edits (id, start_s)``, one per mix, as gaps from the node before."""
    before = F.coalesce(F.lag("o").over(by_position()), F.lit(0.0))
    at = chain.withColumn("o", F.sum("delta_s").over(by_position())).withColumn("before", before).join(edits.select("id", "start_s"), "id")
    return set_gap(chain, at.select("id", (F.greatest(F.lit(0.0), F.col("start_s")) - F.col("before")).alias("delta_s")))


def offsets(chain: DataFrame) -> DataFrame:
    return chain.withColumn("offset_s", F.sum("delta_s").over(by_position()))


def total_duration(mixes: DataFrame, entries: DataFrame) -> DataFrame:
    """``mix_id, total_s``; 0 for empty mixes."""
    total = entries.groupBy("mix_id").agg(F.max(end()).alias("t"))
    return mixes.select(F.col("id").alias("mix_id")).join(total, "mix_id", "left").select("mix_id", F.greatest(F.lit(0.0), F.coalesce("t", F.lit(0.0))).alias("total_s"))


def overlap_zones(entries: DataFrame) -> DataFrame:
    """Adds the zone each node fades in over (``in_start, in_end``) and out over; null where there is none."""
    next_start, next_end = F.lead("offset_s").over(by_position()), F.lead(end()).over(by_position())
    a, b = F.greatest("offset_s", next_start), F.least(end(), next_end)
    some = next_start.isNotNull() & (b > a)
    rows = entries.withColumn("out_start", F.when(some, a)).withColumn("out_end", F.when(some, b))
    return rows.withColumn("in_start", F.lag("out_start").over(by_position())).withColumn("in_end", F.lag("out_end").over(by_position()))


def gain_curves(zones: DataFrame, points: int = 256) -> DataFrame:
    """``mix_id, pos, k, t, gain`` at ``points`` even times over each node."""
    rows = zones.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("t", F.col("offset_s") + F.col("duration_s") * F.col("k") / (points - 1))
    return rows.select("mix_id", "pos", "k", "t", X.gain_at(F.col("t"), F.col("in_start"), F.col("in_end"), F.col("out_start"), F.col("out_end")).alias("gain"))


def active_nodes(entries: DataFrame, probes: DataFrame, width: float = 120.0) -> DataFrame:
    """``probe, mix_id, pos, id``: nodes that sound between the times of ``probes (probe, mix_id, t0, t1)``."""
    nodes = entries.select("mix_id", "pos", "id", "offset_s", end().alias("end_s"))
    asked = probes.select("probe", "mix_id", F.least("t0", "t1").alias("t_from"), F.greatest("t0", "t1").alias("t_to"), "t0", "t1")
    rows = overlapping(nodes, asked, ["mix_id"], ("offset_s", "end_s"), ("t_from", "t_to"), width)
    return rows.filter((F.col("offset_s") <= F.col("t1")) & (F.col("end_s") > F.col("t0"))).select("probe", "mix_id", "pos", "id")


def max_concurrency(entries: DataFrame) -> DataFrame:
    """``mix_id, most``: how many nodes sound at once at most; a node that ends as another starts doesn't count."""
    sounding = entries.filter("duration_s > 0")
    events = sounding.select("mix_id", F.col("offset_s").alias("t"), F.lit(1).alias("d")).union(sounding.select("mix_id", end(), F.lit(-1)))
    order = Window.partitionBy("mix_id").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("now", F.sum("d").over(order)).groupBy("mix_id").agg(F.max("now").alias("most"))


def marker_offset() -> Column:
    return F.greatest(F.lit(0.0), F.col("a_start_s") - F.col("b_start_s"))


def best_marker(markers: DataFrame) -> DataFrame:
    """The highest score of each pair, the earliest on ties, with its ``offset_s``."""
    order = Window.partitionBy("a_id", "b_id").orderBy(F.desc("score"), "a_start_s", "b_start_s")
    best = markers.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return best.select("a_id", "b_id", "a_start_s", "b_start_s", "score", marker_offset().alias("offset_s"))


def drop_offset(drops: DataFrame, markers: DataFrame) -> DataFrame:
    """``drops (a_id, b_id, prev_duration)`` with ``offset_s``: the best marker's, else a plain crossfade before the end."""
    best = best_marker(markers).select("a_id", "b_id", F.col("offset_s").alias("m"))
    return drops.join(best, ["a_id", "b_id"], "left").select(*drops.columns, F.coalesce("m", F.greatest(F.lit(0.0), F.col("prev_duration") - OVERLAP_S)).alias("offset_s"))


def place_legal(drops: DataFrame, markers: DataFrame) -> DataFrame:
    """``drops (a_id, b_id, prev_duration, floor_s)`` with ``offset_s``: the best marker not before the floor, else the floor or the plain crossfade."""
    legal = markers.join(drops.select("a_id", "b_id", "floor_s"), ["a_id", "b_id"]).filter(marker_offset() >= F.col("floor_s") - 1e-9)
    best = best_marker(legal).select("a_id", "b_id", F.col("offset_s").alias("m"))
    other = F.greatest("floor_s", F.greatest(F.lit(0.0), F.col("prev_duration") - OVERLAP_S))
    return drops.join(best, ["a_id", "b_id"], "left").select(*drops.columns, F.coalesce("m", other).alias("offset_s"))


def snap(proposals: DataFrame, markers: DataFrame, beats: DataFrame) -> DataFrame:
    """``proposals (key, a_id, b_id, t, bpm)`` with ``snapped``: the nearest marker within reach, else the nearest
    of ``beats (a_id, beat)``, the earlier one on ties, else the nearest whole beat at ``bpm``."""
    near = proposals.join(markers.select("a_id", "b_id", "rank", marker_offset().alias("o")), ["a_id", "b_id"]).filter(F.abs(F.col("t") - F.col("o")) <= RADIUS_S)
    hit = near.groupBy("key").agg(F.min_by("o", F.struct(F.abs(F.col("t") - F.col("o")), "rank")).alias("m"))
    rows = nearest(proposals, beats, "a_id", "t", "beat").join(hit, "key", "left")
    beat = 60.0 / F.nullif("bpm", F.lit(0))
    whole = F.coalesce(F.floor(F.col("t") / beat + 0.5) * beat, F.col("t"))
    return rows.select(*proposals.columns, F.greatest(F.lit(0.0), F.coalesce("m", "nearest", whole)).alias("snapped"))


def mix_beat_grid(entries: DataFrame, features: DataFrame, totals: DataFrame) -> DataFrame:
    """``mix_id, beat``: the first track's beats, carried on at its tempo to the end of the mix.

    Beats are numbered and told from their numbers, in generated code; no array of a mix's beats is made."""
    first = entries.filter("pos = 0").select("mix_id", "track_id", "offset_s").join(features.select("track_id", "bpm", "beat_grid"), "track_id").join(totals, "mix_id")
    rows = first.withColumn("own", F.size("beat_grid")).withColumn("last", F.coalesce(F.get("beat_grid", F.col("own") - 1) + F.col("offset_s"), F.col("offset_s")))
    rows = rows.withColumn("n", F.col("own") + F.expr("if(total_s - last >= 60.0D / bpm, cast(floor((total_s - last) * bpm / 60.0D) AS int), 0)"))
    rows = rows.filter("beat_grid IS NOT NULL AND n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return rows.select("mix_id", F.when(F.col("k") < F.col("own"), F.get("beat_grid", F.col("k")) + F.col("offset_s")).otherwise(F.expr("last + (k - own + 1) * 60.0D / bpm")).alias("beat"))


def delete_and_heal(chain: DataFrame, deletes: DataFrame, markers: DataFrame) -> DataFrame:
    """``chain`` without ``deletes (id)``; the successor of a removed node is put at the best legal marker with its
    new predecessor (or at its floor), everyone else keeps the gap. ``markers`` are those of :func:`healed_pairs`."""
    return set_gap(remove_nodes(chain, deletes), place_legal_by_node(healed_nodes(chain, deletes), markers))


def healed_nodes(chain: DataFrame, deletes: DataFrame) -> DataFrame:
    """``id, a_id, b_id, prev_duration, floor_s`` of the nodes that get a new predecessor."""
    neighbours = chain.join(deletes.select("id", F.lit(True).alias("gone")), "id", "left").withColumn("after_gone", F.coalesce(F.lag("gone").over(by_position()), F.lit(False)))
    healed = neighbours.filter("gone IS NULL AND after_gone AND pos > 0").select("id")
    left = offsets(remove_nodes(chain, deletes)).withColumn("floor_s", min_delta_seconds()).withColumn("a_id", F.lag("track_id").over(by_position())).withColumn("prev_duration", F.lag("duration_s").over(by_position()))
    return left.join(healed, "id", "left_semi").filter("a_id IS NOT NULL").select("id", "a_id", F.col("track_id").alias("b_id"), "prev_duration", "floor_s")


def healed_pairs(chain: DataFrame, deletes: DataFrame) -> DataFrame:
    """``a_id, b_id``: the new neighbours, whose transitions are to be scored."""
    return healed_nodes(chain, deletes).filter("a_id <> b_id").select("a_id", "b_id").distinct()


def place_legal_by_node(drops: DataFrame, markers: DataFrame) -> DataFrame:
    """``id, delta_s`` of :func:`place_legal` where a pair of tracks may be dropped in several mixes."""
    m = markers.select("a_id", "b_id", "score", "a_start_s", "b_start_s", marker_offset().alias("o"))
    legal = drops.join(m, ["a_id", "b_id"], "left").withColumn("o", F.when(F.col("o") >= F.col("floor_s") - 1e-9, F.col("o")))
    best = legal.groupBy("id", "prev_duration", "floor_s").agg(F.max_by("o", F.when(F.col("o").isNotNull(), F.struct("score", -F.col("a_start_s"), -F.col("b_start_s")))).alias("o"))
    return best.select("id", F.coalesce("o", F.greatest("floor_s", F.greatest(F.lit(0.0), F.col("prev_duration") - OVERLAP_S))).alias("delta_s"))


def markers_on_mix(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """``mix_id, pos, rank, t, score``: markers of every junction on the time axis of its mix."""
    rows = entries.withColumn("b_id", F.lead("track_id").over(by_position())).withColumnRenamed("track_id", "a_id").select("mix_id", "pos", "a_id", "b_id", "offset_s")
    return rows.join(markers, ["a_id", "b_id"]).select("mix_id", "pos", "rank", (F.col("offset_s") + F.col("a_start_s")).alias("t"), "score")
