"""Matching and recommendation (R-01 to R-08). Scores of single pairs are columns in ``functions``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D
from ..sources.staging import stage

#: Rows of a band that are paired at a time with as many others, about as many as most; blocks of a band, if it has rows enough, at least.
#: A row is copied once per block of the other side, a task holds the rows of one block: few large blocks cost little disk, and some ten MB.
BLOCK_ROWS, LEAST_BLOCKS = 1 << 16, 12
#: No band has more grid points.
SLOTS = max(len(D.grid_of(*extent)) for extent in D.BANDS.values())


def track_energies(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """``track_id, intro_rms, outro_rms``: mean rms of the first and of the last segment."""
    from .segments import segment_energy

    energy = segment_energy(segments.select("track_id", "seg_idx", "start_frame", "end_frame"), frames)
    return energy.groupBy("track_id").agg(F.min_by("energy", "seg_idx").alias("intro_rms"), F.max_by("energy", "seg_idx").alias("outro_rms"))


def track_scalars(tracks: DataFrame, variants: DataFrame, energies: DataFrame) -> DataFrame:
    """``id, band, bpm, camelot, grid, intro_rms, outro_rms`` of mixable tracks with variants and ``energies`` (of :func:`track_energies`).

    The pair join needs no more of a track than this."""
    return _scalars(tracks, variants).join(energies.withColumnRenamed("track_id", "id"), "id")


def _scalars(tracks: DataFrame, variants: DataFrame) -> DataFrame:
    from .catalog import grid_map

    own = tracks.filter("mixable").select("id", "camelot", F.col("native_bpm").alias("bpm"), X.resolve_band("genre", "native_bpm").alias("band"))
    return own.join(grid_map(variants).withColumnRenamed("track_id", "id"), "id")


def _slots() -> Column:
    """Grid points of a row's band, in order."""
    out = F.array().cast("array<int>")
    for name, extent in D.BANDS.items():
        out = F.when(F.col("band") == name, F.array(*map(F.lit, D.grid_of(*extent)))).otherwise(out)
    return out


def _ready_to_pair(scalars: DataFrame) -> DataFrame:
    """Scalars with what a pair needs of one track alone: ``mask`` (a bit per grid point of the band), ``pen`` (stretch
    penalty at each, null where the track has no variant), ``key_number`` and ``key_mode``. Pairs then are plain arithmetic."""
    rows = scalars.withColumn("slots", _slots())
    mask = F.expr("aggregate(grid, 0, (m, g) -> m | if(array_contains(slots, g), shiftleft(1, cast(array_position(slots, g) AS int) - 1), 0))")
    pen = F.transform("slots", lambda g: F.when(F.array_contains("grid", g), X.stretch_penalty("bpm", g))) if "bpm" in scalars.columns else F.array().cast("array<double>")
    return rows.withColumn("mask", mask).withColumn("pen", pen).withColumn("key_number", X.camelot_number("camelot")).withColumn("key_mode", X.camelot_mode("camelot"))


def _blocks(n: Column) -> Column:
    """How many blocks ``n`` rows of a band are dealt into."""
    return F.greatest(F.ceil(n / BLOCK_ROWS), F.least(F.lit(LEAST_BLOCKS), F.ceil(n / 64))).cast("int")


def candidate_pairs(scalars: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of different tracks that share a tempo, columns ``a_…`` and ``b_…``.

    For callers who want every pair; :func:`recommend` scores far fewer. Grid points of different
    bands differ, so sharing one implies the same band: an equi-join on band finds each pair once. A band's rows are dealt into blocks by its counts on either
    side, pairs of blocks are spread over all tasks; a bit test tells whether two grids meet.
    """
    rows = _ready_to_pair(scalars)
    a_side = rows if anchors is None else rows.join(anchors.select("id"), "id", "left_semi")
    blocks = lambda df, name: df.groupBy("band").agg(_blocks(F.count("*")).alias(name))
    counts = blocks(a_side, "a_blocks").join(blocks(rows, "b_blocks"), "band")  # a row per band
    dealt = lambda df, x: df.join(counts, "band").select(*(F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "slots"), "a_blocks", "b_blocks")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    a = dealt(a_side, "a").withColumn("i", F.expr("cast(pmod(xxhash64(a_id), a_blocks) AS int)")).withColumn("j", every("b_blocks")).drop("a_blocks", "b_blocks")
    b = dealt(rows, "b").withColumn("j", F.expr("cast(pmod(xxhash64(b_id), b_blocks) AS int)")).withColumn("i", every("a_blocks")).drop("a_blocks", "b_blocks")
    # by number, as Spark would merge partitions by what they read, which is far less than the pairs they make
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(tasks, "a_band", "i", "j"), b.repartition(tasks, "b_band", "i", "j")
    shares = a["a_mask"].bitwiseAND(b["b_mask"]) != 0
    # merged on purpose: Spark sizes a side by its rows before they are dealt to blocks, so it would broadcast what may be very large
    return a.join(b.hint("merge"), (a["a_band"] == b["b_band"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & shares & (a["a_id"] != b["b_id"])).drop("i", "j")


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs with ``score``, ``bpm``, ``key``, ``energy`` (not rounded) and ``slot``, the best shared grid point's place in the band.

    What is used twice is a column of its own, so that the generated method stays below the 8,000 bytes up to which the JVM compiles one."""
    each = {f"x{j}": _both_pens(j) for j in range(SLOTS)}
    rows = pairs.withColumns(each | {"apart": X.wheel_distance(F.col("a_key_number"), F.col("b_key_number"))}).withColumn("bpm", _tempo(F.least(*each)))
    slot = F.lit(None).cast("int")
    for j in reversed(range(SLOTS)):
        slot = F.when(_tempo(F.col(f"x{j}")) == F.col("bpm"), j).otherwise(slot)
    key = X.score_apart(F.col("apart"), F.col("a_key_mode") == F.col("b_key_mode"))
    rows = rows.withColumn("slot", slot).withColumns({"key": key, "energy": X.energy_continuity("a_outro_rms", "b_intro_rms")})
    return rows.withColumn("score", D.W_BPM * F.col("bpm") + D.W_KEY * F.col("key") + D.W_ENERGY * F.col("energy"))


def _both_pens(j: int) -> Column:
    """Penalties of both sides at the ``j``-th grid point of the band, added; null unless both have it."""
    return F.get("a_pen", F.lit(j)) + F.get("b_pen", F.lit(j))


def _tempo(pens: Column) -> Column:
    """The score of two penalties' sum. It falls as they grow, rounding included, so the best of several is that of the least sum."""
    return 1.0 - D.BPM_PENALTY * (0.5 * pens)


def match_pairs(pairs: DataFrame) -> DataFrame:
    """``a_id, b_id, score, bpm, key, energy, shared_grid, best_grid_bpm`` of :func:`candidate_pairs`; scores to 4 digits."""
    return _named(_narrow(_scored(pairs)))


def tempo_scores(pairs: DataFrame) -> DataFrame:
    """``a_id, b_id, grid, score`` of :func:`candidate_pairs`: the shared grid point that suits both best, the lowest on ties, and its score, not rounded."""
    rows = _scored(pairs).select("a_id", "b_id", F.col("a_band").alias("band"), "slot", F.col("bpm").alias("score"))
    return rows.select("a_id", "b_id", F.get(_slots(), F.col("slot")).alias("grid"), "score")


def _narrow(scored: DataFrame, *own: str) -> DataFrame:
    """What ranking needs of a scored pair, and columns of its ``own``; the grid points wait in a mask."""
    r4 = lambda c: X.round_up_half(F.col(c), 4).alias(c)
    return scored.select("a_id", "b_id", *map(r4, ("score", "bpm", "key", "energy")), F.col("a_band").alias("band"), F.col("a_mask").bitwiseAND(F.col("b_mask")).alias("mask"), "slot", *own)


def _named(narrow: DataFrame) -> DataFrame:
    rows = narrow.withColumn("slots", _slots())
    rows = rows.withColumn("shared_grid", F.expr("filter(slots, (g, i) -> (mask & shiftleft(1, i)) <> 0)")).withColumn("best_grid_bpm", F.get("slots", F.col("slot")))
    return rows.select("a_id", "b_id", "score", "bpm", "key", "energy", "shared_grid", "best_grid_bpm", *(["rank"] if "rank" in narrow.columns else []))


def pairs_of(edges: DataFrame, scalars: DataFrame) -> DataFrame:
    """:func:`candidate_pairs` for given ``edges (a_id, b_id)``: those of them that share a tempo."""
    rows = _ready_to_pair(scalars).drop("slots")
    a, b = (rows.select(*(F.col(c).alias(f"{x}_{c}") for c in rows.columns)) for x in "ab")
    return edges.join(a, "a_id").join(b, "b_id").filter((F.col("a_band") == F.col("b_band")) & (F.col("a_mask").bitwiseAND(F.col("b_mask")) != 0))


def recommend(scalars: DataFrame, anchors: DataFrame | None = None, k: int = D.TOP, cutoff: float = D.CUTOFF, seen: Seen = None) -> DataFrame:
    """The ``k`` best matches (all, if ``k`` is not positive) of every track, or of ``anchors (id)``, with ``rank``.

    Ranks are by rounded score, ties by id as text; pairs below the cutoff have none. ``seen`` gets
    the observations that count the scored pairs (``n``) once the result has been computed.
    """
    if k and k > 0:
        return _named(_search(scalars, anchors, k, cutoff, seen))
    scored = _narrow(_scored(candidate_pairs(scalars, anchors)))
    return _named(scored.withColumn("rank", F.row_number().over(_best_first())).filter(F.col("score") >= cutoff))


Seen = list[Observation] | None
#: Rows aimed at in a cell, and at most; parts of a band's tempos, and of its loudness, at most.
CELL_ROWS, MOST_ROWS, QUANTILES = 8, 512, 128
#: Rounding of a bound can't fall below that of a score it bounds.
SLACK = 1e-9


def _best_first() -> Window:
    return Window.partitionBy("a_id").orderBy(F.desc("score"), "b_id")


def _with_cells(rows: DataFrame) -> DataFrame:
    """Rows with ``a_cell`` and ``b_cell``: tracks of a band with one ``key``, like tempos (``tempo``) and like loudness where they end, or begin (``loud``).

    The numbers of tempo and loudness parts are equal and grow with the root of the band's tracks, so that cells stay
    small; a cell of very many tracks is split by id, so that no row of a later join meets an unbounded group.
    ``ask`` is the part in which the loudness at the end lies among beginnings, ``parts`` their number."""
    fractions = F.array(*(F.lit(i / QUANTILES) for i in range(1, QUANTILES)))
    parts = F.least(F.lit(QUANTILES), F.ceil(F.sqrt(F.count("*") / (24 * CELL_ROWS))))
    bands = rows.groupBy("band").agg(parts.cast("int").alias("parts"), *(F.percentile_approx(c, fractions, 1000).alias(f"{c}_q") for c in ("bpm", "intro_rms", "outro_rms")))  # a row per band
    edges = lambda c: F.expr(f"if(parts > 1, transform(sequence(1, parts - 1), i -> element_at({c}_q, cast(floor(i * {QUANTILES} / parts) AS int))), array())")
    bands = bands.withColumns({f"{c}_q": edges(c) for c in ("bpm", "intro_rms", "outro_rms")})
    key = F.coalesce(F.col("key_number") * 2 + F.when(F.col("key_mode") == "A", 0).otherwise(1), F.lit(0))  # tracks without a key are a cell of their own
    part = lambda below, c: F.size(F.expr(f"filter({below}, q -> q < {c})"))
    rows = rows.join(bands, "band").withColumns({"key": key, "tempo": part("bpm_q", "bpm"), "loud": part("intro_rms_q", "intro_rms"), "ask": part("intro_rms_q", "outro_rms")})
    for side, loud in (("a_cell", part("outro_rms_q", "outro_rms")), ("b_cell", F.col("loud"))):
        rows = rows.withColumn(side, (F.col("key") * QUANTILES + F.col("tempo")) * QUANTILES + loud)
    rows = stage(rows.drop("bpm_q", "intro_rms_q", "outro_rms_q"), "parts")
    for side in ("a_cell", "b_cell"):
        sizes = rows.groupBy("band", side).agg(F.ceil(F.count("*") / MOST_ROWS).alias("split"))
        rows = rows.join(sizes, ["band", side]).withColumn(side, F.col(side).cast("long") * 1_000_000 + F.pmod(F.xxhash64("id"), F.col("split"))).drop("split")
    return rows


def _groups(rows: DataFrame, x: str, by: list[str], energy: str) -> DataFrame:
    """What bounds the scores of tracks of a band that are alike in ``by``: their key, all grid points, the least penalty at each, and the loudness they span."""
    least = [F.min(F.get("pen", F.lit(j))) for j in range(SLOTS)]
    return rows.groupBy(F.col("band").alias(f"{x}_band"), *(F.col(c).alias(c if c.endswith("cell") else f"{x}_{c}") for c in by)).agg(
        F.first("key_number").alias(f"{x}_key_number"), F.first("key_mode").alias(f"{x}_key_mode"), F.bit_or("mask").alias(f"{x}_mask"), F.array(*least).alias(f"{x}_pen"), F.min(energy).alias(f"{x}_low"), F.max(energy).alias(f"{x}_high"), F.count("*").alias(f"{x}_rows")
    )


def _wheel() -> Column:
    return X.wheel_score(F.col("a_key_number"), F.col("a_key_mode"), F.col("b_key_number"), F.col("b_key_mode"))


def _bound() -> Column:
    """No pair of side ``a`` (a cell, or one track with ``a_low`` = ``a_high``) and a group ``b`` scores more."""
    bpm = _tempo(F.least(*map(_both_pens, range(SLOTS))))
    apart = F.when(F.col("a_high") < F.col("b_low"), X.energy_continuity("a_high", "b_low")).when(F.col("b_high") < F.col("a_low"), X.energy_continuity("a_low", "b_high")).otherwise(1.0)
    return X.round_up_half(D.W_BPM * bpm + D.W_KEY * _wheel() + D.W_ENERGY * apart + SLACK, 4)


def _near_cells(a_cells: DataFrame, b_cells: DataFrame, wanted: int, cutoff: float) -> DataFrame:
    """``a_band, a_cell, b_cell``: for each cell of anchors, cells about as loud as these end, of the keys that suit best, those
    with the highest bounds until they hold ``wanted`` tracks. What is scored first only has to be good, not the best."""
    has = b_cells.groupBy("b_band", "b_key").agg(F.first("b_key_number").alias("b_key_number"), F.first("b_key_mode").alias("b_key_mode"), F.sum("b_rows").alias("rows"))  # a row per band and key
    asked = a_cells.groupBy("a_band", "a_key").agg(F.first("a_key_number").alias("a_key_number"), F.first("a_key_mode").alias("a_key_mode"), F.first("parts").alias("parts"))
    order = Window.partitionBy("a_band", "a_key").orderBy(F.desc("suits"), "b_key").rowsBetween(Window.unboundedPreceding, -1)
    keys = asked.join(has, F.col("a_band") == F.col("b_band")).withColumn("suits", _wheel())
    keys = keys.withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)) * F.least(F.lit(1.0), 3 / F.col("parts"))).filter(F.col("before") < 2 * wanted).select("a_band", "a_key", "b_key")
    rows = a_cells.join(keys, ["a_band", "a_key"]).withColumn("b_loud", F.explode(F.sequence(F.col("ask") - 1, F.col("ask") + 1))).join(b_cells.withColumn("a_band", F.col("b_band")), ["a_band", "b_key", "b_loud"])
    rows = rows.filter(F.col("a_mask").bitwiseAND(F.col("b_mask")) != 0).withColumn("bound", _bound())
    before = F.sum("b_rows").over(Window.partitionBy("a_band", "a_cell").orderBy(F.desc("bound"), "b_cell").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") < wanted) & (F.col("bound") >= cutoff)).select("a_band", "a_cell", "b_cell")


def _search(scalars: DataFrame, anchors: DataFrame | None, k: int, cutoff: float, seen: Seen) -> DataFrame:
    """Best-first over cells. Every cell of anchors scores near cells first; the ``k``-th score found is each anchor's
    threshold. Of the other cells, found from key to tempo to loudness so that a cell of anchors never meets all cells of its
    band, an anchor scores those whose bound, with its own values, still reaches it. Of tracks alike in all that a score
    is made of, only as many are candidates as a list can hold."""
    rows = _ready_to_pair(scalars).drop("slots", "grid").filter("bpm IS NOT NULL AND intro_rms IS NOT NULL AND outro_rms IS NOT NULL")  # others have no score
    # joins below make far more rows than they read, so their sides are spread over all tasks, however few bytes they are
    spread = lambda df, *by: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    rows = stage(_with_cells(spread(rows, "id")), "cells")
    from_side = rows if anchors is None else rows.join(anchors.select("id"), "id", "left_semi")
    alike = Window.partitionBy("band", "mask", "bpm", "key_number", "key_mode", "intro_rms").orderBy("id")
    to_side = stage(rows.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1).drop("n", "outro_rms", "a_cell", "ask", "parts"), "candidates")  # one of them may be the anchor
    a = from_side.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "band", "mask", "pen", "key_number", "key_mode", "outro_rms")), "a_cell")
    b = to_side.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "band", "mask", "pen", "key_number", "key_mode", "intro_rms")), "b_cell")
    b_cells = stage(_groups(to_side, "b", ["key", "tempo", "loud", "b_cell"], "intro_rms"), "b-cells")
    places = from_side.groupBy(F.col("band").alias("a_band"), "a_cell").agg(F.floor(F.avg("ask")).cast("int").alias("ask"), F.first("parts").alias("parts"))
    a_cells = stage(_groups(from_side, "a", ["key", "a_cell"], "outro_rms").join(places, ["a_band", "a_cell"]), "a-cells")
    meet = lambda x: (F.col("a_band") == F.col("b_band")) & (F.col("a_mask").bitwiseAND(F.col("b_mask")) != 0) & x
    near = stage(_near_cells(a_cells, b_cells, 3 * k, cutoff), "near-cells")

    def scored(found: DataFrame, *own: str) -> DataFrame:
        """What is counted stays where it is: Spark would move filters by score into the join, score each pair twice, and make a method too long to be compiled."""
        pairs, counted = _narrow(_scored(found.filter(meet(F.col("a_id") != F.col("b_id")))), *own), Observation()
        if seen is not None:
            seen.append(counted)
        return pairs.observe(counted, F.count("*").alias("n"))

    best = lambda df: df.withColumn("rank", F.row_number().over(_best_first())).filter(F.col("rank") <= k)
    # cells meet candidates first, so that all that an anchor scores is in one task before the best are taken
    first = scored(spread(near.join(b, [near["b_cell"] == b["b_cell"], near["a_band"] == b["b_band"]]).drop("b_cell"), "a_band", "a_cell").join(a, ["a_band", "a_cell"]))
    first = stage(best(first.filter(F.col("score") >= cutoff)).drop("rank"), "first-matches")
    reached = first.groupBy("a_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(cutoff).alias("least"))
    a = stage(spread(a.join(reached, "a_id", "left").withColumn("least", F.coalesce("least", F.lit(cutoff))), "a_id"), "thresholds")
    lowest = a.groupBy("a_band", "a_cell").agg(F.min("least").alias("lowest"))
    own = ["a_band", "a_cell", "a_key_number", "a_key_mode", "a_mask", "a_pen", "a_low", "a_high", "lowest"]
    others = spread(a_cells.join(lowest, ["a_band", "a_cell"]).select(own), "a_band", "a_cell")
    met: list[str] = []
    for by in (["key"], ["key", "tempo"], ["key", "tempo", "loud", "b_cell"]):
        to = b_cells if "b_cell" in by else _groups(to_side, "b", by, "intro_rms")
        others = others.join(to.withColumn("a_band", F.col("b_band")), ["a_band", *met]).filter(meet(_bound() >= F.col("lowest")))
        met = [c if c == "b_cell" else f"b_{c}" for c in by]
        others = others.select(*own, *met)
    others = stage(others.join(near, ["a_band", "a_cell", "b_cell"], "left_anti").select("a_band", "a_cell", "b_cell"), "other-cells")
    asks = a.withColumns({"a_low": F.col("a_outro_rms"), "a_high": F.col("a_outro_rms")}).join(others, ["a_band", "a_cell"])
    asks = asks.join(b_cells, [asks["b_cell"] == b_cells["b_cell"], asks["a_band"] == b_cells["b_band"]]).filter(meet(_bound() >= F.col("least"))).select(*a.columns, asks["b_cell"])
    asks = spread(asks, "b_cell")
    more = scored(asks.join(b, [asks["b_cell"] == b["b_cell"], asks["a_band"] == b["b_band"]]), "least")
    return best(first.unionByName(more.filter(F.col("score") >= F.col("least")).drop("least")))


def recommend_enriched(recs: DataFrame, listing: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Recommendations with name, artist, attribution and waveform of the candidate."""
    names = listing.select(F.col("id").alias("b_id"), "name", "artist", F.col("attribution.line").alias("attribution"))
    waves = envelopes.select(F.col("track_id").alias("b_id"), "env")
    return recs.join(names, "b_id", "left").join(waves, "b_id", "left")


def compatible_counts(tracks: DataFrame, variants: DataFrame) -> DataFrame:
    """``band, id, partners``: mixable tracks that share a tempo with each, from counts per set of grid points alone."""
    rows = _ready_to_pair(_scalars(tracks, variants)).select("band", "id", "mask")
    sets = rows.groupBy("band", "mask").agg(F.count("*").alias("n"))  # no more rows of a band than sets of its grid points
    met = sets.alias("x").join(sets.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.mask").bitwiseAND(F.col("y.mask")) != 0))
    met = met.groupBy("x.band", "x.mask").agg((F.sum("y.n") - 1).alias("partners"))
    return rows.join(met, ["band", "mask"]).filter("partners > 0").select("band", "id", "partners")


def scale_scores(df: DataFrame, partition: list[str], low: float = 10.0, high: float = 26.0, score: str = "score") -> DataFrame:
    """Adds ``percent`` and ``scaled``: between the lowest and highest of the set; equal scores lie in the middle, a single one on the absolute scale."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score)))
    w = Window.partitionBy(*partition)
    a, b, n = F.min(s).over(w), F.max(s).over(w), F.count("*").over(w)
    scaled: Column = F.when(n < 2, low + (high - low) * s).when(b - a < 1e-9, (low + high) / 2).otherwise(low + (high - low) * ((s - a) / F.nullif(b - a, F.lit(0.0))))
    return df.withColumn("percent", F.floor(s * 100 + 0.5).cast("int")).withColumn("scaled", X.round_up_half(scaled, 6))
