"""Queries of mix chains, table maintenance, ingest planning and streaming twins, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as X
from .. import streaming as ST
from ..functions import dimensions as D
from ..functions import sqlfuncs
from ..operators import chains as C
from ..operators import features as E
from ..operators import ingest as I
from ..operators import licensing as L
from ..operators import matching as R
from ..operators import merge as M
from ..operators import transitions as TR
from ..sources import adapters as A
from ..sources import buckets as B
from ..sources import readers as S
from ..sources.staging import shared_dir
from .registry import query
from .series import ALL_FEATURES, JUNCTIONS, MATCHED, RANKED, RECOMMEND, all_segments, all_wide, curves_sql, junction_markers, made_once, markers, ordered, r, recommended, scalars
from .views import R4, VIEWS

# chains


def entries(s, d):
    return C.flatten_chains(ordered(s, d), A.variants(s, d), A.tracks(s, d))


def simple(s, d):
    """Chains in seconds, as the editing operators take them."""
    return entries(s, d).select("mix_id", "pos", "id", "track_id", "delta_s", "duration_s")


@made_once
def healed_markers(s, d):
    """Markers of the tracks that become neighbours where nodes are removed."""
    matches = R.match_pairs(R.pairs_of(C.healed_pairs(simple(s, d), _removed(s, d)), scalars(s, d)))
    return TR.markers(TR.transition_curves(matches, all_wide(s, d), all_segments(s, d)))


VIEWS["kept_nodes"] = """
SELECT mix_id, id, track_id, duration_s, after_gone AND pos > 0 AS healed, k, CASE WHEN k = 0 AND pos > 0 THEN 0 ELSE delta_s END AS delta_s
FROM (
    SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY pos) - 1 AS k
    FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY mix_id ORDER BY pos), false) AS after_gone FROM (SELECT *, CAST(mix_id AS BIGINT) % 3 = 0 AND pos = CAST(mix_id AS BIGINT) % 4 AS gone FROM chains)) WHERE NOT gone)
"""
VIEWS["healed_markers"] = curves_sql(f"""
SELECT DISTINCT m.a_id, m.b_id, best_grid_bpm AS tempo FROM ({MATCHED}) m
JOIN (SELECT lag(track_id) OVER (PARTITION BY mix_id ORDER BY k) AS a_id, track_id AS b_id, healed FROM kept_nodes) j ON j.a_id = m.a_id AND j.b_id = m.b_id WHERE healed
""") + RANKED
MARKERS = "SELECT * FROM markers"
BEST = f"SELECT a_id, b_id, arg_max(struct_pack(a := a_start_s, b := b_start_s, s := score), (score, -a_start_s, -b_start_s)) AS m FROM ({MARKERS}) GROUP BY a_id, b_id"

query("c01_order_chains", ordered, "SELECT id, mix_id, track_id, delta_beats, grid_bpm, CAST(pos AS INTEGER) AS pos FROM mix_tracks WHERE mix_id IN (SELECT id FROM mixes)")
query("c01_chain_problems", lambda s, d: C.order_chains(A.mixes(s, d), A.mix_tracks(s, d, corrupt=True))[1], """
SELECT DISTINCT mix_id, (['cycle', 'unreachable', 'dangling'])[CAST(mix_id AS BIGINT) % 97] AS problem FROM mix_tracks WHERE n >= 3 AND CAST(mix_id AS BIGINT) % 97 BETWEEN 1 AND 3 AND mix_id IN (SELECT id FROM mixes)
""")
query("c01_long_chains", lambda s, d: C.order_chains(*long_chains(s, d), long=100)[0].select("mix_id", "id", "pos"), "SELECT 'long-' || o_orderkey % 3 AS mix_id, 'o' || o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS INTEGER) AS pos FROM orders")
query("c01_long_problems", lambda s, d: C.order_chains(*long_chains(s, d, corrupt=True), long=100)[1], "SELECT * FROM (VALUES ('long-0', 'unreachable'), ('long-1', 'cycle'), ('long-2', 'dangling')) t(mix_id, problem)")


def long_chains(s, d, corrupt=False):
    """(mixes, nodes): all orders in three mixes; ``corrupt`` skips nodes of the first, and leads the others back and astray."""
    k = F.col("o_orderkey")
    name = lambda x: F.concat(F.lit("o"), x.cast("string"))
    own = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    rows = own.join(own.select((k - 3).alias("o_orderkey"), F.lit(True).alias("more")), "o_orderkey", "left").withColumn("next_id", F.when(F.col("more"), name(k + 3)))
    if corrupt:
        rows = rows.withColumn("next_id", F.when(k == 300, name(k + 9)).when((k % 3 == 1) & F.col("next_id").isNull(), "o301").when(k == 602, "ghost").otherwise(F.col("next_id")))
    nodes = rows.select(name(k).alias("id"), F.concat(F.lit("long-"), (k % 3).cast("string")).alias("mix_id"), F.lit("1").alias("track_id"), "next_id", F.lit(0).alias("delta_beats"), F.lit(120).alias("grid_bpm"))
    return s.range(3).select(F.concat(F.lit("long-"), "id").alias("id"), F.concat(F.lit("o"), "id").alias("head_id")), nodes


query("c02_beats_and_seconds", lambda s, d: A.mix_tracks(s, d).select("id", X.beats_to_seconds("delta_beats", "grid_bpm").alias("seconds"), X.seconds_to_beats(F.col("delta_beats") * 0.37, "grid_bpm").alias("beats")), "SELECT id, delta_beats * 60.0::DOUBLE / grid_bpm AS seconds, CAST(round_even(delta_beats * 0.37::DOUBLE * grid_bpm / 60.0::DOUBLE, 0) AS INTEGER) AS beats FROM mix_tracks")
query("c03_flatten_chains", lambda s, d: r(entries(s, d), "delta_s", "offset_s", "duration_s"), f"SELECT mix_id, pos, id, track_id, delta_beats, {R4('delta_s', 6)} AS delta_s, {R4('offset_s', 6)} AS offset_s, grid_bpm, {R4('duration_s', 6)} AS duration_s FROM chains")
query("c04_overlap_violations", lambda s, d: C.overlap_violations(entries(s, d)), """
SELECT mix_id, pos, id, far_id FROM (SELECT *, lead(offset_s, 2) OVER w AS far, lead(id, 2) OVER w AS far_id FROM chains WINDOW w AS (PARTITION BY mix_id ORDER BY pos)) WHERE far < offset_s + duration_s - 1e-6
""")
MINIMUM = """
SELECT *, greatest(0, coalesce(greatest(lag(offset_s) OVER w, lag(offset_s + duration_s, 2) OVER w, CASE WHEN lead(delta_s) OVER w IS NOT NULL THEN lag(offset_s + duration_s) OVER w - lead(delta_s) OVER w END) - lag(offset_s) OVER w, 0)) AS least_s
FROM chains WINDOW w AS (PARTITION BY mix_id ORDER BY pos)
"""
query("c05_min_delta_beats", lambda s, d: C.min_delta_beats(entries(s, d)).select("id", "min_delta_beats"), f"SELECT id, CASE WHEN pos = 0 THEN 0 ELSE CAST(greatest(0, round_even(least_s * grid_bpm / 60.0::DOUBLE, 0)) AS INTEGER) END AS min_delta_beats FROM ({MINIMUM})")


def gap_edits(s, d):
    m = A.mix_tracks(s, d)
    own = m.filter("cast(mix_id AS bigint) % 11 = 0 AND id = concat(mix_id, '-2')").select("id", (F.col("delta_beats") + 8).alias("delta_beats"))
    return own.union(s.range(1).select(F.lit("nobody").alias("id"), F.lit(4).alias("delta_beats")))


EDITED = """
SELECT *, sum(delta_s) OVER (PARTITION BY mix_id ORDER BY pos) AS offset_s FROM (
    SELECT mix_id, pos, id, track_id, delta_beats + e AS delta_beats, (delta_beats + e) * 60.0::DOUBLE / grid_bpm AS delta_s, grid_bpm, duration_s
    FROM (SELECT *, CASE WHEN id = mix_id || '-2' THEN 8 ELSE 0 END AS e FROM chains WHERE CAST(mix_id AS BIGINT) % 11 = 0 AND mix_id IN (SELECT mix_id FROM chains WHERE pos = 1)))
"""
BROKEN = f"SELECT mix_id FROM (SELECT *, lead(offset_s, 2) OVER (PARTITION BY mix_id ORDER BY pos) AS far FROM ({EDITED})) WHERE far < offset_s + duration_s - 1e-6"
query("c06_gap_edits", lambda s, d: r(C.apply_gap_edits(entries(s, d), gap_edits(s, d))[0].select("id", "delta_beats", "offset_s"), "offset_s"), f"SELECT id, delta_beats, {R4('offset_s', 6)} AS offset_s FROM ({EDITED}) WHERE mix_id NOT IN ({BROKEN})")
query("c06_gap_edits_rejected", lambda s, d: C.apply_gap_edits(entries(s, d), gap_edits(s, d))[1], f"SELECT id, 'overlap' AS reason FROM ({EDITED}) WHERE id = mix_id || '-2' AND mix_id IN ({BROKEN}) UNION ALL SELECT 'nobody', 'unknown node'")


def new_nodes(s, d):
    k = F.col("id").cast("long")
    return A.mixes(s, d).filter(k % 5 == 0).select(F.col("id").alias("mix_id"), (k % 7 - 1).cast("int").alias("at"), F.concat("id", F.lit("-new")).alias("id"), F.lit("3").alias("track_id"), (k % 9 - 2).cast("double").alias("delta_s"), F.lit(50.0).alias("duration_s"))


query("c07_insert_nodes", lambda s, d: r(C.insert_nodes(simple(s, d), new_nodes(s, d)), "delta_s", "duration_s"), f"""
, sizes AS (SELECT x.id AS mix_id, CAST(count(c.id) AS INTEGER) AS n FROM mixes x LEFT JOIN chains c ON c.mix_id = x.id GROUP BY x.id),
put AS (SELECT mix_id, n, greatest(0, least(CAST(CAST(mix_id AS BIGINT) % 7 - 1 AS INTEGER), n)) AS p, greatest(0.0, CAST(CAST(mix_id AS BIGINT) % 9 - 2 AS DOUBLE)) AS delta_s FROM sizes WHERE CAST(mix_id AS BIGINT) % 5 = 0 AND n < 100)
SELECT c.mix_id, CASE WHEN c.pos >= p THEN c.pos + 1 ELSE c.pos END AS pos, c.id, c.track_id, {R4('c.delta_s', 6)} AS delta_s, {R4('c.duration_s', 6)} AS duration_s FROM chains c LEFT JOIN put ON put.mix_id = c.mix_id
UNION ALL SELECT mix_id, p, mix_id || '-new', '3', {R4('delta_s', 6)}, 50.0 FROM put
""".replace(", sizes", "WITH sizes", 1))
query("c07_remove_nodes", lambda s, d: r(C.remove_nodes(simple(s, d), _removed(s, d)), "delta_s", "duration_s"), f"""
SELECT mix_id, CAST(k AS INTEGER) AS pos, id, track_id, {R4('CASE WHEN k = 0 AND pos > 0 THEN 0 ELSE delta_s END', 6)} AS delta_s, {R4('duration_s', 6)} AS duration_s
FROM (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY pos) - 1 AS k FROM chains WHERE NOT (CAST(mix_id AS BIGINT) % 3 = 0 AND pos = CAST(mix_id AS BIGINT) % 4))
""")
query("c07_set_gap", lambda s, d: r(C.set_gap(simple(s, d), _removed(s, d).withColumn("delta_s", F.length("id") - 5.5)), "delta_s", "duration_s"), f"""
SELECT mix_id, pos, id, track_id, {R4("CASE WHEN CAST(mix_id AS BIGINT) % 3 = 0 AND pos = CAST(mix_id AS BIGINT) % 4 THEN greatest(0.0, length(id) - 5.5) ELSE delta_s END", 6)} AS delta_s, {R4('duration_s', 6)} AS duration_s FROM chains
""")
query("c07_set_start", lambda s, d: r(C.set_start(simple(s, d), _removed(s, d).withColumn("start_s", F.length("id") * 6.0)), "delta_s", "duration_s"), f"""
SELECT mix_id, pos, id, track_id, {R4("CASE WHEN CAST(mix_id AS BIGINT) % 3 = 0 AND pos = CAST(mix_id AS BIGINT) % 4 THEN greatest(0.0, length(id) * 6.0::DOUBLE - coalesce(lag(offset_s) OVER (PARTITION BY mix_id ORDER BY pos), 0)) ELSE delta_s END", 6)} AS delta_s, {R4('duration_s', 6)} AS duration_s FROM chains
""")


def _removed(s, d):
    k = F.col("mix_id").cast("long")
    return ordered(s, d).filter((k % 3 == 0) & (F.col("pos") == k % 4)).select("id")


query("c08_total_duration", lambda s, d: r(C.total_duration(A.mixes(s, d), entries(s, d)), "total_s"), f"SELECT m.id AS mix_id, {R4('greatest(0.0, coalesce(max(offset_s + duration_s), 0))', 6)} AS total_s FROM mixes m LEFT JOIN chains c ON c.mix_id = m.id GROUP BY m.id")
ZONES = """
SELECT *, lag(out_start) OVER w AS in_start, lag(out_end) OVER w AS in_end FROM (
    SELECT *, CASE WHEN least(offset_s + duration_s, nxt + nxt_d) > greatest(offset_s, nxt) THEN greatest(offset_s, nxt) END AS out_start, CASE WHEN least(offset_s + duration_s, nxt + nxt_d) > greatest(offset_s, nxt) THEN least(offset_s + duration_s, nxt + nxt_d) END AS out_end
    FROM (SELECT *, lead(offset_s) OVER v AS nxt, lead(duration_s) OVER v AS nxt_d FROM chains WINDOW v AS (PARTITION BY mix_id ORDER BY pos)) WHERE true
) WINDOW w AS (PARTITION BY mix_id ORDER BY pos)
"""
ZONES = ZONES.replace("CASE WHEN least", "CASE WHEN nxt IS NOT NULL AND least")
query("c09_overlap_zones", lambda s, d: r(C.overlap_zones(entries(s, d)).select("id", "in_start", "in_end", "out_start", "out_end"), "in_start", "in_end", "out_start", "out_end"), "SELECT id, " + ", ".join(f"{R4(c, 6)} AS {c}" for c in ("in_start", "in_end", "out_start", "out_end")) + f" FROM ({ZONES})")
GAIN = "coalesce(sin(CASE WHEN in_end > in_start THEN greatest(0.0, least(1.0, (t - in_start) / (in_end - in_start))) END * pi() / 2), 1.0) * coalesce(cos(CASE WHEN out_end > out_start THEN greatest(0.0, least(1.0, (t - out_start) / (out_end - out_start))) END * pi() / 2), 1.0)"
query("c10_gain_at_end", lambda s, d: r(C.overlap_zones(entries(s, d)).select("id", X.gain_at(C.end() - 5.0, F.col("in_start"), F.col("in_end"), F.col("out_start"), F.col("out_end")).alias("gain")), "gain", digits=5), f"SELECT id, {R4(GAIN, 5)} AS gain FROM (SELECT *, offset_s + duration_s - 5.0::DOUBLE AS t FROM ({ZONES}))")
query("c11_gain_curves", lambda s, d: r(C.gain_curves(C.overlap_zones(entries(s, d)), 8), "t", "gain", digits=5), f"SELECT mix_id, pos, k, {R4('t', 5)} AS t, {R4(GAIN, 5)} AS gain FROM (SELECT *, offset_s + duration_s * k / 7 AS t FROM ({ZONES}), (SELECT CAST(unnest(range(8)) AS INTEGER) AS k))")
query("c12_active_nodes", lambda s, d: C.active_nodes(entries(s, d), probes(s, d)), f"""
SELECT event_id AS probe, c.mix_id, pos, c.id FROM events e JOIN chains c ON c.mix_id = CAST(event_id % (SELECT count(*) FROM orders) AS VARCHAR) AND offset_s <= event_id * 37 % 400 + event_id % 50 AND offset_s + duration_s > event_id * 37 % 400
""")


def probes(s, d):
    """A question per event: what sounds in one of the mixes between two times?"""
    k, n = F.col("event_id"), s.read.parquet(f"{d}/orders.parquet").count()
    t0 = (k * 37 % 400).cast("double")
    return s.read.parquet(f"{d}/events.parquet").select(k.alias("probe"), (k % n).cast("string").alias("mix_id"), t0.alias("t0"), (t0 + k % 50).alias("t1"))


query("c12_max_concurrency", lambda s, d: C.max_concurrency(entries(s, d)), """
SELECT mix_id, max(x) AS most FROM (SELECT mix_id, sum(d) OVER (PARTITION BY mix_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS x FROM (SELECT mix_id, offset_s AS t, 1 AS d FROM chains WHERE duration_s > 0 UNION ALL SELECT mix_id, offset_s + duration_s, -1 FROM chains WHERE duration_s > 0)) GROUP BY mix_id
""")
query("c13_best_marker", lambda s, d: r(C.best_marker(markers(s, d)), "score", "offset_s"), f"SELECT a_id, b_id, m.a AS a_start_s, m.b AS b_start_s, {R4('m.s', 6)} AS score, {R4('greatest(0.0, m.a - m.b)', 6)} AS offset_s FROM ({BEST})")
PAIRS = "SELECT id AS a_id, CAST(CAST(id AS BIGINT) + 4 AS VARCHAR) AS b_id, duration_s AS prev_duration, CAST(id AS BIGINT) % 40 * 0.5::DOUBLE AS floor_s FROM tracks"


def drops(s, d):
    own = A.tracks(s, d).select(F.col("id").alias("a_id"), (F.col("id").cast("long") + 4).cast("string").alias("b_id"), F.col("duration_s").alias("prev_duration"), (F.col("id").cast("long") % 40 * 0.5).alias("floor_s"))
    pairs = markers(s, d).select("a_id", "b_id").distinct().select("a_id", "b_id", F.lit(90.0).alias("prev_duration"), (F.pmod(F.col("b_id").cast("long"), F.lit(30)) * 1.0).alias("floor_s"))
    return own.join(pairs, ["a_id", "b_id"], "left_anti").union(pairs)


DROPS = f"SELECT * FROM ({PAIRS}) ANTI JOIN ({BEST}) USING (a_id, b_id) UNION ALL SELECT a_id, b_id, 90.0, CAST(CAST(b_id AS BIGINT) % 30 AS DOUBLE) FROM ({BEST})"
query("c13_drop_offset", lambda s, d: r(C.drop_offset(drops(s, d), markers(s, d)), "offset_s"), f"SELECT a_id, b_id, prev_duration, floor_s, {R4('CASE WHEN m IS NULL THEN greatest(0.0, prev_duration - 16) ELSE greatest(0.0, m.a - m.b) END', 6)} AS offset_s FROM ({DROPS}) LEFT JOIN ({BEST}) USING (a_id, b_id)")
query("c14_place_legal", lambda s, d: r(C.place_legal(drops(s, d), markers(s, d)), "offset_s"), f"""
SELECT x.a_id, x.b_id, prev_duration, floor_s, {R4('coalesce(arg_max(greatest(0.0, a_start_s - b_start_s), (score, -a_start_s, -b_start_s)) FILTER (WHERE m.rank IS NOT NULL AND greatest(0.0, a_start_s - b_start_s) >= floor_s - 1e-9), greatest(floor_s, greatest(0.0, prev_duration - 16)))', 6)} AS offset_s
FROM ({DROPS}) x LEFT JOIN ({MARKERS}) m ON m.a_id = x.a_id AND m.b_id = x.b_id GROUP BY x.a_id, x.b_id, prev_duration, floor_s
""")
query("c15_snap", lambda s, d: r(C.snap(_proposals(s, d), markers(s, d), _beats(s, d)), "snapped"), f"""
WITH p AS (SELECT a_id || '/' || b_id AS key, a_id, b_id, CAST(b_id AS BIGINT) % 31 * 1.1::DOUBLE AS t, CASE WHEN CAST(b_id AS BIGINT) % 3 = 0 THEN 0 ELSE 120 END AS bpm FROM (SELECT a_id, b_id FROM ({BEST}) UNION SELECT a_id, b_id FROM ({PAIRS}))),
near AS (SELECT key, arg_min(o, (abs(t - o), rank)) AS m FROM p JOIN (SELECT *, greatest(0.0, a_start_s - b_start_s) AS o FROM markers) m USING (a_id, b_id) WHERE abs(t - o) <= 1.25 GROUP BY key)
SELECT key, a_id, b_id, t, bpm, {R4('greatest(0.0, coalesce(m, list_min([struct_pack(d := abs(t - b), b := b) FOR b IN beats]).b, floor(t / (60.0::DOUBLE / nullif(bpm, 0)) + 0.5) * (60.0::DOUBLE / nullif(bpm, 0)), t))', 6)} AS snapped
FROM p LEFT JOIN near USING (key) LEFT JOIN (SELECT track_id AS a_id, beats FROM ({ALL_FEATURES})) f USING (a_id)
""")
query("c16_mix_beat_grid", lambda s, d: _beat_grid(s, d), f"""
SELECT mix_id, len(beats) + more AS n, {R4('coalesce(beats[len(beats)], 0) + o + CASE WHEN more > 0 THEN more * 60.0::DOUBLE / bpm ELSE 0 END', 3)} AS last
FROM (SELECT *, CASE WHEN total - l >= 60.0::DOUBLE / bpm THEN CAST(floor((total - l) * bpm / 60.0::DOUBLE) AS BIGINT) ELSE 0 END AS more FROM (
    SELECT mix_id, o, total, bpm, beats, coalesce(beats[len(beats)] + o, o) AS l
    FROM (SELECT mix_id, arg_min(track_id, pos) AS track_id, arg_min(offset_s, pos) AS o, max(offset_s + duration_s) + 5e-10 AS total FROM chains GROUP BY mix_id) JOIN ({ALL_FEATURES}) f USING (track_id)))
""")
query("c17_delete_and_heal", lambda s, d: r(C.delete_and_heal(simple(s, d), _removed(s, d), healed_markers(s, d)), "delta_s", "duration_s"), f"""
WITH placed AS (SELECT *, sum(delta_s) OVER (PARTITION BY mix_id ORDER BY k) AS offset_s FROM kept_nodes),
least_of AS (
    SELECT *, lag(track_id) OVER w AS a_id, lag(duration_s) OVER w AS prev_duration,
        greatest(0, coalesce(greatest(lag(offset_s) OVER w, lag(offset_s + duration_s, 2) OVER w, CASE WHEN lead(delta_s) OVER w IS NOT NULL THEN lag(offset_s + duration_s) OVER w - lead(delta_s) OVER w END) - lag(offset_s) OVER w, 0)) AS floor_s
    FROM placed WINDOW w AS (PARTITION BY mix_id ORDER BY k)),
legal AS (
    SELECT l.id, arg_max(greatest(0.0, a_start_s - b_start_s), (score, -a_start_s, -b_start_s)) AS o
    FROM least_of l JOIN healed_markers m ON m.a_id = l.a_id AND m.b_id = l.track_id WHERE healed AND greatest(0.0, a_start_s - b_start_s) >= floor_s - 1e-9 GROUP BY l.id)
SELECT mix_id, CAST(k AS INTEGER) AS pos, id, track_id, {R4("CASE WHEN healed AND a_id IS NOT NULL THEN greatest(0.0, coalesce(o, greatest(floor_s, greatest(0.0, prev_duration - 16.0)))) ELSE delta_s END", 6)} AS delta_s, {R4('duration_s', 6)} AS duration_s
FROM least_of LEFT JOIN legal USING (id)
""")
VIEWS["junction_markers"] = curves_sql(f"SELECT DISTINCT m.a_id, m.b_id, best_grid_bpm AS tempo FROM ({MATCHED}) m JOIN ({JUNCTIONS}) j ON j.a_id = m.a_id AND j.b_id = m.b_id") + RANKED
query("c18_markers_on_mix", lambda s, d: r(C.markers_on_mix(junction_markers(s, d), entries(s, d)), "t"), f"""
SELECT mix_id, pos, rank, {R4('offset_s + a_start_s', 6)} AS t, score FROM (SELECT *, lead(track_id) OVER (PARTITION BY mix_id ORDER BY pos) AS b_id FROM chains) c JOIN junction_markers m ON m.a_id = c.track_id AND m.b_id = c.b_id
""")
query("c19_time_label", lambda s, d: entries(s, d).select("id", X.time_label(F.col("offset_s") * 40 - 100).alias("label")), """
SELECT id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS label FROM (SELECT id, CAST(floor(greatest(0.0, offset_s * 40 - 100)) AS BIGINT) AS s FROM chains)
""")


def _proposals(s, d):
    pairs = drops(s, d).select("a_id", "b_id").distinct()
    b = F.col("b_id").cast("long")
    return pairs.select(F.concat_ws("/", "a_id", "b_id").alias("key"), "a_id", "b_id", (b % 31 * 1.1).alias("t"), F.when(b % 3 == 0, 0).otherwise(120).alias("bpm"))


def _beats(s, d):
    """A row per beat of every track."""
    return all_wide(s, d).select(F.col("track_id").alias("a_id"), F.explode("beat_grid").alias("beat"))


def _beat_grid(s, d):
    e = entries(s, d)
    out = C.mix_beat_grid(e, all_wide(s, d), C.total_duration(A.mixes(s, d), e).withColumn("total_s", F.col("total_s") + 5e-10))
    return out.groupBy("mix_id").agg(F.count("*").alias("n"), X.round_up_half(F.max("beat"), 3).alias("last"))


# maintenance


def incoming_tracks(s, d):
    k = F.col("id").cast("long")
    t = A.tracks(s, d).filter(k % 3 == 0)
    return t.withColumns({"id": F.when(k % 9 == 0, F.concat(F.lit("new-"), "id")).otherwise(F.col("id")), "name": F.concat("name", F.lit("!")), "native_bpm": F.when(k % 2 == 0, F.col("native_bpm") + 1), "status": F.lit("fetched"), "status_error": F.lit(None).cast("string"), "audio_key": F.lit(None).cast("string")})


INCOMING = """
SELECT CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN 'new-' || id ELSE id END AS id, name || '!' AS name, artist, genre, license, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN native_bpm + 1 END AS native_bpm, camelot, duration_s, popularity, 'fetched' AS status, CAST(NULL AS VARCHAR) AS status_error,
    license_nd, license_sa, license_nc, mixable, CAST(NULL AS VARCHAR) AS audio_key FROM tracks WHERE CAST(id AS BIGINT) % 3 = 0
"""
UPSERTED = "SELECT coalesce(i.id, t.id) AS id, " + ", ".join(f"CASE WHEN i.id IS NOT NULL THEN i.{c} ELSE t.{c} END AS {c}" for c in M.ALWAYS) + ", " + ", ".join(f"coalesce(i.{c}, t.{c}) AS {c}" for c in ("native_bpm", "camelot", "duration_s", "popularity", "audio_key")) + f" FROM tracks t FULL JOIN ({INCOMING}) i ON i.id = t.id"
query("m01_upsert_tracks", lambda s, d: M.upsert_tracks(A.tracks(s, d), incoming_tracks(s, d)), UPSERTED)
query("m01_bucketed_upsert", lambda s, d: bucketed(s, d, A.tracks(s, d), incoming_tracks(s, d), ["id"], M.upsert_tracks), UPSERTED)


def bucketed(s, d, first, then, keys, merge):
    """A table of buckets after two versions, the older of which is dropped."""
    path = f"{shared_dir(s)}/buckets-{uuid.uuid4().hex}"
    for rows in (first, then):
        B.upsert(rows, path, keys, merge, 16)
    B.drop_versions(s, path, 1)
    return B.read_version(s, path)


query("m02_upsert_variants", lambda s, d: M.upsert_variants(A.variants(s, d), A.variant_plan(s, d).filter("cast(track_id AS bigint) % 5 = 0").withColumn("duration_s", F.lit(1.0))), "SELECT * REPLACE (CASE WHEN CAST(track_id AS BIGINT) % 5 = 0 THEN 1.0 ELSE duration_s END AS duration_s) FROM variant_plan WHERE CAST(track_id AS BIGINT) % 5 = 0 OR (CAST(track_id AS BIGINT) + grid_bpm) % 17 <> 0")
query("m02_bucketed_upsert", lambda s, d: bucketed(s, d, A.variants(s, d), A.variant_plan(s, d).filter("cast(track_id AS bigint) % 5 = 0").withColumn("duration_s", F.lit(1.0)), ["track_id", "grid_bpm"], M.upsert_variants), "SELECT * REPLACE (CASE WHEN CAST(track_id AS BIGINT) % 5 = 0 THEN 1.0 ELSE duration_s END AS duration_s) FROM variant_plan WHERE CAST(track_id AS BIGINT) % 5 = 0 OR (CAST(track_id AS BIGINT) + grid_bpm) % 17 <> 0")
query("m03_upsert_mixes", lambda s, d: M.upsert_mixes(A.mixes(s, d), A.mixes(s, d).filter("cast(id AS bigint) % 4 = 0").withColumns({"name": F.lit("x"), "created_at": F.lit(0.0), "updated_at": F.lit(9.0)})), "SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'x' ELSE name END AS name, head_id, created_at, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 9.0 ELSE updated_at END AS updated_at FROM mixes")
query("m03_upsert_mix_tracks", lambda s, d: M.upsert_mix_tracks(A.mix_tracks(s, d), A.mix_tracks(s, d).filter("delta_beats > 150").withColumns({"mix_id": F.lit("z"), "delta_beats": F.lit(7)})), "SELECT id, mix_id, track_id, next_id, CASE WHEN delta_beats > 150 THEN 7 ELSE delta_beats END AS delta_beats, grid_bpm FROM mix_tracks")


def status_events(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, ["pending", "fetched", "analyzed", "ready", "failed", "cleared"])), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"), F.col("event_id").cast("double").alias("at"))


EVENTS = "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, (['pending', 'fetched', 'analyzed', 'ready', 'failed', 'cleared'])[event_id % 6 + 1] AS kind FROM events"
query("m04_status_events", lambda s, d: M.apply_status_events(A.tracks(s, d), status_events(s, d)), f"""
SELECT t.* REPLACE (coalesce(l.status, t.status) AS status, CASE WHEN l.k IS NULL THEN status_error WHEN l.k = 'failed' THEN 'e' || l.kq END AS status_error, CASE WHEN coalesce(c, 0) = 0 THEN native_bpm END AS native_bpm, CASE WHEN coalesce(c, 0) = 0 THEN camelot END AS camelot)
FROM tracks t LEFT JOIN (SELECT id, arg_max(kind, seq) FILTER (WHERE kind NOT IN ('failed', 'cleared')) AS status, arg_max(kind, seq) FILTER (WHERE kind <> 'cleared') AS k, max(seq) FILTER (WHERE kind <> 'cleared') AS kq, count(*) FILTER (WHERE kind = 'cleared') AS c FROM ({EVENTS}) GROUP BY id) l ON l.id = t.id
""")
query("m05_mix_edits", lambda s, d: M.apply_mix_edits(A.mixes(s, d), A.mix_tracks(s, d), _mix_edits(s, d))[0], "SELECT id, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN NULL ELSE head_id END AS head_id, created_at, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 2.0 WHEN CAST(id AS BIGINT) % 6 = 0 THEN 1.0 ELSE updated_at END AS updated_at FROM mixes")
query("m05_node_edits", lambda s, d: M.apply_mix_edits(A.mixes(s, d), A.mix_tracks(s, d), _mix_edits(s, d))[1], "SELECT id, mix_id, track_id, next_id, CASE WHEN delta_beats = 100 THEN 101 ELSE delta_beats END AS delta_beats, grid_bpm FROM mix_tracks")


def _mix_edits(s, d):
    m, n = A.mixes(s, d), A.mix_tracks(s, d)
    k = F.col("id").cast("long")
    edit = lambda df, target, field, value, at: df.select(F.lit(target).alias("target"), "id", F.lit(field).alias("field"), F.lit(value).cast("string").alias("value"), F.lit(at).alias("at"))
    names = edit(m.filter(k % 6 == 0), "mix", "name", "renamed", 1.0).union(edit(m.filter(k % 6 == 0), "mix", "name", "older", 0.5))
    return names.union(edit(m.filter(k % 10 == 0), "mix", "head_id", None, 2.0)).union(edit(n.filter("delta_beats = 100"), "node", "delta_beats", "101", 1.0))


def _gone(s, d):
    return A.raw_tracks(s, d).filter("cast(id AS bigint) % 8 = 1").select("id")


query("m06_delete_tracks", lambda s, d: M.delete_tracks(A.tracks(s, d), A.variants(s, d), A.mix_tracks(s, d), _gone(s, d))[0], "SELECT * FROM tracks WHERE CAST(id AS BIGINT) % 8 <> 1")
query("m06_cascade_variants", lambda s, d: M.delete_tracks(A.tracks(s, d), A.variants(s, d), A.mix_tracks(s, d), _gone(s, d))[1], "SELECT * FROM variants WHERE CAST(track_id AS BIGINT) % 8 <> 1")
query("m06_cascade_nodes", lambda s, d: M.delete_tracks(A.tracks(s, d), A.variants(s, d), A.mix_tracks(s, d), _gone(s, d))[2], "SELECT id, mix_id, track_id, next_id, delta_beats, grid_bpm FROM mix_tracks WHERE CAST(track_id AS BIGINT) % 8 <> 1")
query("m06_delete_mixes", lambda s, d: M.delete_mixes(A.mixes(s, d), A.mix_tracks(s, d), A.mixes(s, d).filter("cast(id AS bigint) % 2 = 0"))[1], "SELECT id, mix_id, track_id, next_id, delta_beats, grid_bpm FROM mix_tracks WHERE mix_id NOT IN (SELECT id FROM mixes WHERE CAST(id AS BIGINT) % 2 = 0)")


def reversed_chains(s, d):
    from pyspark.sql import Window

    o = ordered(s, d).filter("cast(mix_id AS bigint) % 5 = 0")
    return o.withColumn("pos", F.max("pos").over(Window.partitionBy("mix_id")) - F.col("pos"))


def _replace(s, d):
    return M.replace_chains(A.mixes(s, d), A.mix_tracks(s, d), reversed_chains(s, d), A.variants(s, d), A.tracks(s, d))


REVERSED = """
SELECT mix_id, n - 1 - p AS pos, id, track_id, delta_beats, grid_bpm, duration_s, sum(delta_s) OVER (PARTITION BY mix_id ORDER BY n - 1 - p) AS offset_s FROM (SELECT *, pos AS p, count(*) OVER (PARTITION BY mix_id) AS n FROM chains WHERE CAST(mix_id AS BIGINT) % 5 = 0)
"""
REFUSED = f"SELECT DISTINCT mix_id FROM (SELECT *, lead(offset_s, 2) OVER (PARTITION BY mix_id ORDER BY pos) AS far FROM ({REVERSED})) WHERE far < offset_s + duration_s - 1e-6"
query("m07_replace_chains", lambda s, d: _replace(s, d)[1], f"""
SELECT id, mix_id, track_id, next_id, delta_beats, grid_bpm FROM mix_tracks WHERE mix_id NOT IN (SELECT mix_id FROM ({REVERSED}) WHERE mix_id NOT IN ({REFUSED}))
UNION ALL SELECT id, mix_id, track_id, lead(id) OVER (PARTITION BY mix_id ORDER BY pos), delta_beats, grid_bpm FROM ({REVERSED}) WHERE mix_id NOT IN ({REFUSED})
""")
query("m07_refused_chains", lambda s, d: _replace(s, d)[2], REFUSED)

# ingest planning

DONE = """
SELECT t.id, CASE WHEN NOT mixable THEN true ELSE audio_key IN (SELECT key FROM inventory) AND coalesce((SELECT bool_and(object_key IN (SELECT key FROM inventory)) FROM variants v WHERE v.track_id = t.id), false) END AS done FROM tracks t
"""
TODO = f"SELECT s.id, ordinal FROM seed s LEFT JOIN ({DONE}) f USING (id) WHERE NOT coalesce(done, false)"


def flags(s, d):
    return I.published_flags(A.tracks(s, d), A.variants(s, d), A.inventory(s, d))


def todo(s, d):
    return I.ingest_plan(A.seed(s, d), flags(s, d))[0]


query("i01_published_flags", flags, DONE)
query("i02_ingest_plan", todo, TODO)
query("i02_skipped", lambda s, d: I.ingest_plan(A.seed(s, d), flags(s, d))[1], f"SELECT s.id, ordinal FROM seed s JOIN ({DONE}) f USING (id) WHERE done")
query("i03_cost_report", lambda s, d: I.cost_report(todo(s, d)), f"SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) AS metadata_requests, count(*) AS downloads FROM ({TODO})")
BATCHES = f"SELECT batch, string_agg(id, ' ' ORDER BY k) AS ids, count(*) AS n FROM (SELECT id, k, CAST(floor(k / 50) AS BIGINT) AS batch FROM (SELECT id, row_number() OVER (ORDER BY ordinal, id) - 1 AS k FROM ({TODO}))) GROUP BY batch"
query("i04_request_batches", lambda s, d: I.request_batches(todo(s, d)), BATCHES)
query("i05_completeness_audit", lambda s, d: I.completeness_audit(I.request_batches(todo(s, d)), _responses(s, d)), f"""
SELECT batch, count(*) AS asked, count(*) FILTER (WHERE got) AS returned, string_agg(id, ' ' ORDER BY id) FILTER (WHERE NOT got) AS missing
FROM (SELECT batch, id, NOT (batch % 4 = 1 AND length(id) = 3) AS got FROM (SELECT batch, unnest(string_split(ids, ' ')) AS id FROM ({BATCHES}))) GROUP BY batch HAVING count(*) FILTER (WHERE got) < count(*)
""")
query("i06_reuse_split", lambda s, d: I.reuse_split(todo(s, d), A.seed(s, d).filter("ordinal % 2 = 0"), _wavs(s, d)), f"SELECT id, ordinal, ordinal % 2 = 0 AND ordinal % 3 = 0 AS cached FROM ({TODO})")
query("i07_resume_stage", lambda s, d: I.resume_stage(A.seed(s, d), A.tracks(s, d), A.inventory(s, d)), """
SELECT s.id, CASE WHEN NOT coalesce(mixable, true) THEN 'none' WHEN coalesce(list_position(['pending', 'fetched', 'analyzed', 'ready'], status), 1) < 2 OR audio_key IS NULL OR audio_key NOT IN (SELECT key FROM inventory) THEN 'fetch'
    WHEN list_position(['pending', 'fetched', 'analyzed', 'ready'], status) < 3 OR native_bpm IS NULL THEN 'analyse' WHEN status <> 'ready' THEN 'render' ELSE 'none' END AS next
FROM seed s LEFT JOIN tracks t USING (id)
""")
REENCODE = """
SELECT kind, id, grid_bpm, src, dst, CASE WHEN dst IN (SELECT key FROM stock) THEN 'present' WHEN src IN (SELECT key FROM stock) THEN 'encode' ELSE 'missing-source' END AS action, now <> dst AS repoint FROM (
    SELECT 'master' AS kind, id, CAST(NULL AS INTEGER) AS grid_bpm, 'audio/' || id || '.wav' AS src, 'audio/' || id || '.opus' AS dst, audio_key AS now FROM tracks WHERE audio_key IS NOT NULL
    UNION ALL SELECT 'variant', track_id, grid_bpm, 'variants/' || track_id || '_' || grid_bpm || '.wav', 'variants/' || track_id || '_' || grid_bpm || '.opus', object_key FROM variants)
"""
STOCK = "WITH stock AS (SELECT key FROM inventory UNION SELECT 'audio/' || id || '.wav' FROM seed WHERE ordinal % 3 = 0 UNION SELECT 'audio/' || id || '.opus' FROM seed WHERE ordinal % 7 = 0)\n"


def reencode(s, d):
    keys = A.inventory(s, d).select("key").union(_wavs(s, d).select("key")).union(A.seed(s, d).filter("ordinal % 7 = 0").select(F.concat(F.lit("audio/"), "id", F.lit(".opus"))))
    return I.reencode_plan(A.tracks(s, d), A.variants(s, d), keys, "opus")


query("i08_reencode_plan", reencode, STOCK + REENCODE)
query("i09_reencode_report", lambda s, d: I.reencode_report(reencode(s, d)), STOCK + f"SELECT action, count(*) AS n, count(*) FILTER (WHERE repoint) AS to_repoint FROM ({REENCODE}) GROUP BY action")
query("i10_repoint", lambda s, d: I.repoint(A.tracks(s, d), A.variants(s, d), reencode(s, d))[0], STOCK + f"SELECT t.* REPLACE (coalesce(p.dst, audio_key) AS audio_key) FROM tracks t LEFT JOIN (SELECT id, dst FROM ({REENCODE}) WHERE kind = 'master' AND action <> 'missing-source') p USING (id)")
query("i11_orphan_objects", lambda s, d: I.orphan_objects(A.inventory(s, d), A.tracks(s, d), A.variants(s, d)), """
SELECT 'stray/' || i AS key, 'orphan' AS problem FROM range(10) t(i) UNION ALL SELECT audio_key, 'absent' FROM tracks WHERE audio_key IS NOT NULL AND CAST(id AS BIGINT) % 13 = 0 UNION ALL SELECT object_key, 'absent' FROM variants WHERE CAST(track_id AS BIGINT) % 13 = 0
""")


def _responses(s, d):
    rows = I.request_batches(todo(s, d)).select("batch", F.explode(F.split("ids", " ")).alias("id"))
    return rows.filter("NOT (batch % 4 = 1 AND length(id) = 3)")


def _wavs(s, d):
    return A.seed(s, d).filter("ordinal % 3 = 0").select(F.concat(F.lit("audio/"), "id", F.lit(".wav")).alias("key"))


# streaming twins

query("st02_latency_windows", lambda s, d: r(ST.latency_windows(A.latency(s, d), "1 hour"), "avg_ms").select("stage", F.unix_seconds("start").alias("start_s"), "n", "avg_ms", "max_ms"), f"SELECT stage, CAST(epoch(time_bucket(INTERVAL 1 HOUR, latency.at)) AS BIGINT) AS start_s, count(*) AS n, {R4('avg(ms)', 6)} AS avg_ms, max(ms) AS max_ms FROM latency GROUP BY ALL")
query("st02_sliding_windows", lambda s, d: ST.latency_windows(A.latency(s, d), "2 hours", "1 hour").select("stage", F.unix_seconds("start").alias("start_s"), "n", "max_ms"), "SELECT stage, CAST(epoch(time_bucket(INTERVAL 1 HOUR, latency.at)) AS BIGINT) - 3600 * k AS start_s, count(*) AS n, max(ms) AS max_ms FROM latency, (VALUES (0), (1)) x(k) GROUP BY ALL")
query("st03_coalesce_edits", lambda s, d: ST.coalesce_edits(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("value").cast("int").alias("delta_beats"), F.col("ts").alias("at"), F.col("event_id").alias("seq")), "1 day").select("id", F.unix_seconds("start").alias("start_s"), "delta_beats"), "SELECT CAST(user_id AS VARCHAR) AS id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, CAST(trunc(arg_max(value, (ts, event_id))) AS INTEGER) AS delta_beats FROM events GROUP BY ALL")
query("st03_gestures", lambda s, d: ST.gestures(own_edits(s, d), "6 hours").select("id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "first_beats", "last_beats", "n"), """
WITH told AS (SELECT *, CASE WHEN tm - lag(tm) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM (SELECT CAST(user_id AS VARCHAR) AS id, CAST(trunc(value) AS INTEGER) AS beats, ts AS tm, event_id AS seq FROM events) WINDOW w AS (PARTITION BY id ORDER BY tm, seq)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY tm, seq ROWS UNBOUNDED PRECEDING) AS g FROM told)
SELECT id, epoch_us(min(tm)) AS start_us, epoch_us(max(tm)) AS end_us, arg_min(beats, (tm, seq)) AS first_beats, arg_max(beats, (tm, seq)) AS last_beats, count(*) AS n FROM grouped GROUP BY id, g
""")
query("st04_stuck_tracks", lambda s, d: ST.stuck_tracks(own_steps(s, d), 4.0).select("id", "status", F.unix_micros("since").alias("since_us")), """
WITH steps AS (SELECT CAST(event_id % 3331 AS VARCHAR) AS id, event_id % 4 + 1 AS o, ts AS tm FROM events),
told AS (SELECT *, max(o) OVER (PARTITION BY id ORDER BY tm, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps)
SELECT id, (['pending', 'fetched', 'analyzed', 'ready'])[o] AS status, epoch_us(tm) AS since_us
FROM (SELECT *, coalesce(lead(tm) OVER (PARTITION BY id ORDER BY tm, o), (SELECT max(ts) FROM events)) AS until FROM told WHERE before IS NULL OR o > before) WHERE o < 4 AND until - tm > INTERVAL 4 DAY
""")
query("st04_status_high_water", lambda s, d: ST.status_high_water(status_events(s, d)), f"SELECT id, (['pending', 'fetched', 'analyzed', 'ready'])[greatest(1, coalesce(max(list_position(['pending', 'fetched', 'analyzed', 'ready'], kind)), 1))] AS status, bool_or(kind = 'failed') AS failed FROM ({EVENTS}) GROUP BY id")



def own_edits(s, d):
    """Edits of nodes: who, how far, when, and in which order."""
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("value").cast("int").alias("delta_beats"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def own_steps(s, d):
    """Events as steps of some thousand tracks."""
    k = F.col("event_id")
    return s.read.parquet(f"{d}/events.parquet").select((k % 3331).cast("string").alias("id"), F.element_at(F.array(*map(F.lit, D.STATUSES)), (k % 4 + 1).cast("int")).alias("kind"), F.col("ts").alias("at"))


# SQL functions


def sql_functions(s, d):
    sqlfuncs.register_functions(s)
    A.tracks(s, d).createOrReplaceTempView("cadenza_tracks")
    return s.sql("SELECT id, band_of(native_bpm) AS band, stretch_penalty(native_bpm, 120) AS penalty, beats_to_seconds(16, CAST(native_bpm AS INT)) AS seconds, camelot_score(camelot, '8A') AS score FROM cadenza_tracks")


query("u01_sql_functions", lambda s, d: r(sql_functions(s, d), "penalty", "seconds", "score"), f"""
SELECT t.id, b.band, {R4('least(1.0, abs(120 / native_bpm - 1) / 0.10::DOUBLE)', 6)} AS penalty, {R4('16 * 60.0::DOUBLE / CAST(trunc(native_bpm) AS INTEGER)', 6)} AS seconds,
    CASE WHEN right(camelot, 1) = 'A' THEN CASE d WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.4 ELSE {R4('greatest(0.0, 0.25 - 0.05 * (d - 3))', 6)} END ELSE CASE d WHEN 0 THEN 0.8 WHEN 1 THEN 0.35 ELSE 0.1 END END::DOUBLE AS score
FROM (SELECT *, least(abs(CAST(left(camelot, -1) AS INTEGER) - 8), 12 - abs(CAST(left(camelot, -1) AS INTEGER) - 8)) AS d FROM tracks) t LEFT JOIN bands b ON native_bpm >= lo - 0.5 AND native_bpm < hi + 0.5
""")


def table_function(s, d):
    sqlfuncs.register_recommend(recommended(s, d))
    ids = scalars(s, d).select("id")
    ids.createOrReplaceTempView("cadenza_ids")
    return s.sql("SELECT i.id, r.b_id, r.score, r.rank FROM cadenza_ids i, LATERAL recommend(i.id, 3) r")


query("u02_recommend_function", table_function, f"SELECT a_id AS id, b_id, score, rank FROM ({RECOMMEND}) WHERE rank <= 3")


# tables written below the shared folder, and read back


def _folder(s):
    return f"{shared_dir(s)}/{uuid.uuid4().hex}"


def published(s, d):
    at = _folder(s)
    t, v = A.tracks(s, d), A.variants(s, d)
    M.publish_tracks(t.filter("status = 'ready'"), v, at)
    M.publish_tracks(t, v, at)
    rows, own = M.read_published(s, at)
    return rows.filter("mixable AND status = 'ready'").join(own.groupBy(F.col("track_id").alias("id")).agg(F.count("*").alias("n_variants")), "id").select("id", "n_variants")


def added_columns(s, d):
    t = A.tracks(s, d).select("id", "name")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("popularity", T.DoubleType()), T.StructField("codec", T.StringType(), False)])
    return M.check_schema(M.add_missing_columns(t, schema, {"codec": "aac"}), ["id", "name", "popularity", "codec"])


def appended(s, d):
    at = _folder(s)
    for _ in range(2):
        M.append_latency(A.latency(s, d), at)
    return s.read.parquet(at).groupBy("stage").agg(F.count("*").alias("n"))


def ingested(s, d):
    """Tracks in two files, the second with other names and statuses, through the stream."""
    at = _folder(s)
    t = A.tracks(s, d).select("id", "name", "status", "native_bpm")
    t.filter("cast(id AS bigint) % 3 <> 0").coalesce(1).write.parquet(f"{at}/in")
    for _ in range(2):
        stream = s.readStream.schema(t.schema).parquet(f"{at}/in")
        ST.start_incremental_ingest(stream, f"{at}/out", f"{at}/check").awaitTermination()
        t.filter("cast(id AS bigint) % 4 = 0").select("id", F.concat("name", F.lit("!")).alias("name"), F.lit("ready").alias("status"), F.lit(None).cast("double").alias("native_bpm")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return ST.read_ingested(s, f"{at}/out")


def own_features(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("track_id"), F.col("embedding").alias("samples"))
    return r(E.feature_job(rows, _loudest, "track_id string, peak double"), "peak")


def _loudest(batch):
    return batch.assign(peak=[float(abs(x).max()) for x in batch["samples"]])[["track_id", "peak"]]


def viewed(s, d):
    sqlfuncs.register_views({"cadenza_tracks": A.tracks(s, d), "cadenza_variants": A.variants(s, d)})
    return s.sql("SELECT id, count(*) AS n FROM cadenza_tracks JOIN cadenza_variants ON id = track_id GROUP BY id")


def written(s, d):
    at = _folder(s)
    for rows in (A.variants(s, d).filter("grid_bpm < 100"), A.variants(s, d)):
        S.write_table(rows, at, ["grid_bpm"])
    return s.read.parquet(at).groupBy("grid_bpm").agg(F.count("*").alias("n"))


VARIANT_COUNTS = "SELECT track_id AS id, count(*) AS n FROM variants GROUP BY track_id"
query("m08_publish_tracks", published, f"SELECT id, n AS n_variants FROM tracks JOIN ({VARIANT_COUNTS}) USING (id) WHERE mixable AND status = 'ready'")
query("m10_add_missing_columns", added_columns, "SELECT id, name, CAST(NULL AS DOUBLE) AS popularity, 'aac' AS codec FROM tracks")
query("m11_append_latency", appended, "SELECT stage, 2 * count(*) AS n FROM latency GROUP BY stage")
query("st01_incremental_ingest", ingested, """
SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN native_bpm END AS native_bpm
FROM tracks WHERE CAST(id AS BIGINT) % 3 <> 0 OR CAST(id AS BIGINT) % 4 = 0
""")
query("s07_write_table", written, "SELECT grid_bpm, count(*) AS n FROM variants GROUP BY grid_bpm")
query("u03_accept_gate", lambda s, d: L.accept(A.tracks(s, d), F.col("duration_s") > 120).select("id"), "SELECT id FROM tracks WHERE duration_s > 120")
query("u04_feature_job", own_features, f"SELECT CAST(vec_id AS VARCHAR) AS track_id, {R4('list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))', 6)} AS peak FROM embeddings")
query("u05_views", viewed, f"SELECT id, n FROM tracks JOIN ({VARIANT_COUNTS}) USING (id)")
