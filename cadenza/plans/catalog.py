"""Queries of the catalogue operators, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D
from ..operators import catalog as C
from ..operators import licensing as L
from ..operators import tempo as G
from ..sources import adapters as A
from ..sources import files as FS
from ..sources import readers as S
from ..sources.staging import shared_dir
from .registry import query
from .series import by_path, signals
from .views import R4

T13 = "id, name, artist, genre, license, license_nd, license_sa, license_nc, mixable, native_bpm, camelot, duration_s, status"


def _ids(spark, sf, every=3):
    return A.raw_tracks(spark, sf).filter(F.col("id").cast("long") % every == 0).select("id")


# sources


def sample_responses(s, d):
    """``batch, asked, body``: fixture responses of up to 50 ids, some short, some empty, some errors."""
    k = F.col("id").cast("long")
    rows = A.raw_tracks(s, d).withColumn("batch", F.floor(k / D.BATCH).cast("long"))
    result = F.struct("id", "name", F.col("artist").alias("artist_name"), X.license_url().alias("license_ccurl"), (k % 4 != 0).alias("audiodownload_allowed"), F.lit("").alias("audiodownload"))
    kept = rows.withColumn("r", F.when((F.col("batch") % 7 != 1) & ~((F.col("batch") % 7 == 3) & (k % D.BATCH >= 40)), result))
    lists = kept.groupBy("batch").agg(F.collect_list("r").alias("results"), F.count("*").alias("asked"))
    bad = F.col("batch") % 7 == 5
    body = F.struct(F.struct(F.when(bad, 5).otherwise(0).alias("code"), F.when(bad, "quota").alias("error_message")).alias("headers"), F.when(~bad, F.col("results")).alias("results"))
    return lists.select("batch", "asked", F.to_json(body).alias("body"))


query("s03_flatten_api", lambda s, d: S.flatten_api_responses(sample_responses(s, d), "body", "asked").drop("body", "asked"), """
WITH given AS (
    SELECT CAST(id AS BIGINT) // 50 AS batch, id, name, artist, CASE WHEN variant IS NOT NULL THEN license END AS license, CAST(id AS BIGINT) % 4 <> 0 AS allowed,
        CAST(id AS BIGINT) // 50 % 7 <> 1 AND NOT (CAST(id AS BIGINT) // 50 % 7 = 3 AND CAST(id AS BIGINT) % 50 >= 40) AS there
    FROM (SELECT r.*, p.variant FROM raw_tracks r JOIN parsed p USING (id))),
told AS (SELECT batch, CASE WHEN batch % 7 = 5 THEN 'error' WHEN count(*) FILTER (WHERE there) < count(*) THEN 'retry' ELSE 'ok' END AS outcome FROM given GROUP BY batch)
SELECT batch, outcome, NULL AS error, id, name, artist, license, allowed FROM given JOIN told USING (batch) WHERE outcome = 'ok'
UNION ALL SELECT batch, outcome, CASE WHEN outcome = 'error' THEN 'quota' END, NULL, NULL, NULL, NULL, NULL FROM told WHERE outcome <> 'ok'
""")
def stored(s, d):
    """Signals, their metadata and seeds as files: ``audio/<id>.wav``, ``meta/<id>.json`` of every track, ``seed/<genre>.json``."""
    path = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    own = A.raw_tracks(s, d)
    # in so many tasks, however few rows there are: each row becomes a file
    sounds = signals(s, d).select(F.concat(F.lit("audio/"), "track_id", F.lit(".wav")).alias("name"), FS.wav_content("samples", "sr").alias("content"))
    meta = own.select(F.concat(F.lit("meta/"), "id", F.lit(".json")).alias("name"), F.to_json(F.struct("name", "artist", "genre", "license")).cast("binary").alias("content"))
    seeds = own.groupBy(F.coalesce("genre", F.lit("none")).alias("g")).agg(F.collect_list(F.struct("id", "name", "artist", "genre", F.col("native_bpm").alias("bpm"), "license", "duration_s")).alias("tracks"))
    seeds = seeds.select(F.concat(F.lit("seed/"), F.regexp_replace("g", " ", "_"), F.lit(".json")).alias("name"), F.to_json(F.struct(F.lit("all").alias("mode"), "tracks")).cast("binary").alias("content"))
    FS.write_blobs(sounds.union(meta).union(seeds), path)
    return path


stored_once = by_path(stored)
query("s01_catalog_seed", lambda s, d: S.read_catalog_seed(s, f"{stored_once(s, d)}/seed").select("mode", "id", "name", "artist", "genre", "bpm", "license"), "SELECT 'all' AS mode, id, name, artist, genre, native_bpm AS bpm, license FROM raw_tracks")
query("s02_sidecars", lambda s, d: S.read_sidecars(s, f"{stored_once(s, d)}/meta"), "SELECT id, name, artist, genre, license FROM raw_tracks")
SOUNDS = "SELECT CAST(vec_id // 64 AS VARCHAR) AS track_id, ([2560, 3840, 5120])[vec_id // 64 % 3 + 1] AS sr, embedding FROM embeddings"
query("s04_wav_ranges", lambda s, d: FS.read_wav_ranges(s, f"{stored_once(s, d)}/audio", 1500).select("track_id", "sr", "n_samples", "duration_s", "first", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda t, x: t + F.rint(x * 32768).cast("long")).alias("total")), f"""
SELECT track_id, sr, n_samples, n_samples / CAST(sr AS DOUBLE) AS duration_s, f * 1500 AS first, CAST(least(1500, n_samples - f * 1500) AS INTEGER) AS n, CAST(list_sum([CAST(round_even(CAST(v AS DOUBLE) * 32767, 0) AS BIGINT) FOR v IN x[f * 1500 + 1:f * 1500 + 1500]]) AS BIGINT) AS total
FROM (SELECT *, unnest(range(0, (n_samples + 1499) // 1500)) AS f FROM (SELECT CAST(g AS VARCHAR) AS track_id, ([2560, 3840, 5120])[g % 3 + 1] AS sr, x, len(x) AS n_samples FROM (SELECT vec_id // 64 AS g, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY g)))
""")
query("s04_wav_headers", lambda s, d: FS.read_wav_headers(s, f"{stored_once(s, d)}/audio").select("track_id", "sr", "channels", "n_samples"), f"SELECT track_id, any_value(sr) AS sr, 1 AS channels, CAST(sum(len(embedding)) AS BIGINT) AS n_samples FROM ({SOUNDS}) GROUP BY track_id")
query("s05_blob_inventory", lambda s, d: S.blob_inventory(s, stored_once(s, d), "audio/"), f"SELECT 'audio/' || track_id || '.wav' AS key, CAST(44 + 2 * sum(len(embedding)) AS BIGINT) AS size FROM ({SOUNDS}) GROUP BY track_id")
query("s06_object_keys", lambda s, d: S.with_object_keys(A.tracks(s, d).select("id"), "opus"), "SELECT id, 'audio/' || id || '.opus' AS master_key, 'audio/' || id || '.wav' AS source_key, 'meta/' || id || '.json' AS meta_key, 'audio/ogg' AS mime FROM tracks")

# projections and lookups

query("q01_get_track", lambda s, d: C.get_track(A.tracks(s, d), "42"), "SELECT * FROM tracks WHERE id = '42'")
query("q02_list_tracks", lambda s, d: C.list_tracks(A.tracks(s, d)), "SELECT * FROM tracks")
query("q03_list_mixable", lambda s, d: C.list_mixable(A.tracks(s, d), False), "SELECT * FROM tracks WHERE NOT mixable")
query("q04_track_summaries", lambda s, d: C.track_summaries(A.tracks(s, d)), f"SELECT {T13} FROM tracks")
query("q05_count_tracks", lambda s, d: C.count_rows(A.tracks(s, d)), "SELECT count(*) AS n FROM tracks")
query("q05_count_mixes", lambda s, d: C.count_rows(A.mixes(s, d)), "SELECT count(*) AS n FROM mixes")
query("q07_track_statuses", lambda s, d: C.track_statuses(A.tracks(s, d), A.seed(s, d)), "SELECT s.id, coalesce(status, 'pending') AS status, status_error FROM seed s LEFT JOIN tracks t ON s.id = t.id")
query("q08_list_variants", lambda s, d: C.list_variants(A.variants(s, d)), "SELECT * FROM variants")
query("q08_variants_of_track", lambda s, d: C.list_variants(A.variants(s, d), "40"), "SELECT * FROM variants WHERE track_id = '40'")
query("q09_grid_map", lambda s, d: C.grid_map(A.variants(s, d)), "SELECT id AS track_id, grid FROM grids", lists=("grid",))
query("q10_list_mixes", lambda s, d: C.list_mixes(A.mixes(s, d)), "SELECT * FROM mixes")
query("q10_mix_nodes", lambda s, d: C.mix_nodes(A.mix_tracks(s, d), "7"), "SELECT id, mix_id, track_id, next_id, delta_beats, grid_bpm FROM mix_tracks WHERE mix_id = '7'")
query("q10_get_node", lambda s, d: C.get_node(A.mix_tracks(s, d), "7-2"), "SELECT id, mix_id, track_id, next_id, delta_beats, grid_bpm FROM mix_tracks WHERE id = '7-2'")
query("q11_mix_picker", lambda s, d: C.mix_picker(A.mixes(s, d), A.mix_tracks(s, d)), "SELECT m.id, name, updated_at, count(t.id) AS n_tracks FROM mixes m LEFT JOIN mix_tracks t ON t.mix_id = m.id GROUP BY ALL")
query("q12_catalog_listing", lambda s, d: C.catalog_listing(A.tracks(s, d), A.variants(s, d)).withColumns({"url": F.col("attribution.url"), "line": F.col("attribution.line")}).drop("attribution"), f"""
SELECT {', '.join('t.' + c for c in T13.split(', '))}, coalesce(grid, []) AS grid, list_filter([CASE WHEN license_nd THEN 'ND' END, CASE WHEN license_sa THEN 'SA' END, CASE WHEN license_nc THEN 'NC' END], lambda x: x IS NOT NULL) AS badges,
    'https://creativecommons.org/licenses/' || lower(variant) || '/' || version || '/' || coalesce(lower(jurisdiction) || '/', '') AS url, '“' || t.name || '” by ' || t.artist || ' — ' || t.license AS line
FROM tracks t JOIN parsed p USING (id) LEFT JOIN grids g ON g.id = t.id WHERE t.status = 'ready'
""", lists=("grid", "badges"))
query("q14_resolve_audio", lambda s, d: C.resolve_audio(_requests(s, d), A.tracks(s, d), A.variants(s, d)), """
SELECT r.track_id, r.grid_bpm, CASE WHEN r.grid_bpm IS NULL THEN audio_key ELSE object_key END AS object_key
FROM (SELECT id AS track_id, g AS grid_bpm FROM raw_tracks, (SELECT unnest([NULL, 80, 120, 163]) AS g)) r
LEFT JOIN tracks t ON t.id = r.track_id LEFT JOIN variants v ON v.track_id = r.track_id AND v.grid_bpm = r.grid_bpm
""")
query("q15_pair_verdict", lambda s, d: C.pair_verdict(_pairs(s, d), A.tracks(s, d), A.variants(s, d)), """
SELECT a_id, b_id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN '404' WHEN NOT a.mixable OR NOT b.mixable THEN '403' WHEN NOT coalesce(list_has_any(ga.grid, gb.grid), false) THEN '409' ELSE 'ok' END AS verdict
FROM (SELECT id AS a_id, CAST(CAST(id AS BIGINT) * 7 % 1999 AS VARCHAR) AS b_id FROM raw_tracks) p
LEFT JOIN tracks a ON a.id = a_id LEFT JOIN tracks b ON b.id = b_id LEFT JOIN grids ga ON ga.id = a_id LEFT JOIN grids gb ON gb.id = b_id
""")
query("q16_license_audit", lambda s, d: C.license_audit(A.tracks(s, d)), "SELECT license_nd, license_sa, license_nc, count(*) AS n FROM tracks GROUP BY ALL")


def _requests(s, d):
    return A.raw_tracks(s, d).select(F.col("id").alias("track_id"), F.explode(F.array(F.lit(None).cast("int"), F.lit(80), F.lit(120), F.lit(163))).alias("grid_bpm"))


def _pairs(s, d):
    return A.raw_tracks(s, d).select(F.col("id").alias("a_id"), (F.col("id").cast("long") * 7 % 1999).cast("string").alias("b_id"))


# licences

query("l01_parse_license", lambda s, d: L.parse_license(A.raw_tracks(s, d).select("id", "license")), "SELECT p.id, license, variant, version, jurisdiction, nd AS license_nd, sa AS license_sa, nc AS license_nc FROM parsed p LEFT JOIN licence_flags USING (variant)")
query("l02_quarantined", lambda s, d: L.split_licenses(A.raw_tracks(s, d))[1], "SELECT * FROM raw_tracks WHERE license = 'CC0'")
query("l03_license_url", lambda s, d: A.raw_tracks(s, d).select("id", X.license_url().alias("url")), "SELECT id, CASE WHEN variant IS NOT NULL THEN 'https://creativecommons.org/licenses/' || lower(variant) || '/' || version || '/' || coalesce(lower(jurisdiction) || '/', '') END AS url FROM parsed")
query("l04_license_from_url", lambda s, d: A.raw_tracks(s, d).select("id", X.license_url().alias("url")).select("id", X.license_from_url("url").alias("license")), "SELECT id, CASE WHEN variant IS NOT NULL THEN license END AS license FROM parsed")
query("l05_attribution", lambda s, d: L.attribution(A.tracks(s, d)).select("id", "attribution.text", "attribution.title", "attribution.artist", "attribution.line"), "SELECT id, '“' || name || '” by ' || artist AS text, name AS title, artist, '“' || name || '” by ' || artist || ' — ' || license AS line FROM tracks")
query("l06_badges", lambda s, d: L.license_badges(A.tracks(s, d)).select("id", "badges"), "SELECT id, list_filter([CASE WHEN license_nd THEN 'ND' END, CASE WHEN license_sa THEN 'SA' END, CASE WHEN license_nc THEN 'NC' END], lambda x: x IS NOT NULL) AS badges FROM tracks", lists=("badges",))
query("l07_refused", lambda s, d: L.gate_mixable(A.tracks(s, d))[1], "SELECT * REPLACE (false AS mixable, CAST(NULL AS VARCHAR) AS audio_key, 'ready' AS status) FROM tracks WHERE license_nd")
query("l08_download_gate", lambda s, d: L.gate_download(A.raw_tracks(s, d).select("id", F.when(F.col("id").cast("long") % 3 > 0, F.col("id").cast("long") % 3 == 1).alias("audiodownload_allowed")))[1], "SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 > 0 THEN CAST(id AS BIGINT) % 3 = 1 END AS audiodownload_allowed, 'download not allowed' AS reason FROM raw_tracks WHERE CAST(id AS BIGINT) % 3 <> 1")

# tempo

query("g01_band_of", lambda s, d: A.raw_tracks(s, d).select("id", X.band_of("native_bpm").alias("band")), "SELECT id, band FROM raw_tracks LEFT JOIN bands ON native_bpm >= lo - 0.5 AND native_bpm < hi + 0.5")
query("g02_resolve_band", lambda s, d: A.tracks(s, d).select("id", X.resolve_band("genre", "native_bpm").alias("band")), "SELECT id, band FROM banded")
query("g03_grid_points", lambda s, d: G.with_grid(A.tracks(s, d)).select("id", "grid"), "SELECT id, coalesce(list(g ORDER BY g) FILTER (WHERE abs(g / native_bpm - 1) <= 0.10), []) AS grid FROM banded LEFT JOIN points USING (band) GROUP BY id", lists=("grid",))
query("g04_shared_grid", lambda s, d: _grid_pairs(s, d).select("a_id", "b_id", X.shared_grid("ga", "gb").alias("shared")), "SELECT a_id, b_id, list_sort(list_intersect(a.grid, b.grid)) AS shared FROM (SELECT id AS a_id, CAST(CAST(id AS BIGINT) * 7 % 1999 AS VARCHAR) AS b_id FROM raw_tracks) JOIN grids a ON a.id = a_id JOIN grids b ON b.id = b_id", lists=("shared",))
query("g05_stretch_penalty", lambda s, d: A.variants(s, d).join(A.tracks(s, d), F.col("track_id") == F.col("id")).select("track_id", "grid_bpm", X.stretch_penalty("native_bpm", "grid_bpm").alias("penalty")), "SELECT track_id, grid_bpm, least(1.0, abs(grid_bpm / native_bpm - 1) / 0.10::DOUBLE) AS penalty FROM variants JOIN tracks ON id = track_id")
query("g06_variant_plan", lambda s, d: A.variant_plan(s, d), "SELECT * FROM variant_plan")
query("g07_missing_variants", lambda s, d: G.missing_variants(A.variant_plan(s, d), A.variants(s, d)), "SELECT * FROM variant_plan WHERE (CAST(track_id AS BIGINT) + grid_bpm) % 17 = 0")
query("g08_catalog_grid_coverage", lambda s, d: G.grid_coverage_of(A.tracks(s, d)), f"""
SELECT a.band, count(*) AS pairs, count(*) FILTER (WHERE list_has_any(a.coarse, b.coarse)) AS coarse_pairs, count(*) FILTER (WHERE list_has_any(a.fine, b.fine)) AS fine_pairs
FROM (SELECT band, native_bpm AS bpm, list_filter(range(lo, hi + 1, 5), lambda g: abs(g / native_bpm - 1) <= 0.10) AS coarse, list_filter(range(lo, hi + 1, 1), lambda g: abs(g / native_bpm - 1) <= 0.10) AS fine FROM (SELECT DISTINCT band, native_bpm FROM banded) JOIN bands USING (band)) a
JOIN (SELECT band, native_bpm AS bpm, list_filter(range(lo, hi + 1, 5), lambda g: abs(g / native_bpm - 1) <= 0.10) AS coarse, list_filter(range(lo, hi + 1, 1), lambda g: abs(g / native_bpm - 1) <= 0.10) AS fine FROM (SELECT DISTINCT band, native_bpm FROM banded) JOIN bands USING (band)) b ON a.band = b.band AND a.bpm <= b.bpm
GROUP BY a.band
""")
query("g09_catalog_coherence", lambda s, d: G.catalog_coherence(A.tracks(s, d)), f"""
SELECT unnest(['every banded track reaches its grid', 'some track is ND', 'some track is SA', 'some track is NC', 'some track is unrestricted', 'some mixable pair shares a point']) AS rule,
    unnest([bool_and(band IS NULL OR n > 0), bool_or(license_nd), bool_or(license_sa), bool_or(license_nc), bool_or(NOT license_nd AND NOT license_sa AND NOT license_nc), (SELECT max(c) > 1 FROM (SELECT count(*) AS c FROM variant_plan GROUP BY grid_bpm))]) AS holds
FROM (SELECT id, any_value(band) AS band, any_value(license_nd) AS license_nd, any_value(license_sa) AS license_sa, any_value(license_nc) AS license_nc, count(*) FILTER (WHERE abs(g / native_bpm - 1) <= 0.10) AS n FROM banded LEFT JOIN points USING (band) GROUP BY id)
""")


def _grid_pairs(s, d):
    g = C.grid_map(A.variants(s, d))
    return _pairs(s, d).join(g.select(F.col("track_id").alias("a_id"), F.col("grid").alias("ga")), "a_id").join(g.select(F.col("track_id").alias("b_id"), F.col("grid").alias("gb")), "b_id")


# aggregation and ranking

DECK = """
SELECT genre, CAST(rank AS INTEGER) AS rank, id, popularity, total, has_popularity, least(total, 10) AS showing FROM (
    SELECT genre, id, popularity, row_number() OVER (PARTITION BY genre ORDER BY coalesce(-popularity, 0), substr(sha256(genre || ':' || id), 1, 16)) AS rank, count(*) OVER (PARTITION BY genre) AS total, bool_or(popularity IS NOT NULL) OVER (PARTITION BY genre) AS has_popularity
    FROM (SELECT * REPLACE (coalesce(nullif(genre, ''), 'other') AS genre) FROM tracks WHERE {where})) WHERE rank <= 10
"""
query("a01_latency_summary", lambda s, d: C.latency_summary(A.latency(s, d)), f"SELECT stage, count(*) AS n, {R4('avg(ms)', 6)} AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM latency GROUP BY stage")
query("a02_genre_deck", lambda s, d: C.genre_deck(A.tracks(s, d)), DECK.format(where="mixable AND (status IS NULL OR status = 'ready')"))
query("a03_genre_deck_all", lambda s, d: C.genre_deck(A.tracks(s, d), include_unusable=True), DECK.format(where="true"))
STATE = """
SELECT coalesce(s.id, t.id) AS id, ordinal, s.id IS NOT NULL AS in_config, coalesce(status, 'pending') AS status, status_error, coalesce(n, 0) AS n_variants, status_error IS NOT NULL AND coalesce(status, 'pending') <> 'ready' AS failed
FROM seed s FULL JOIN tracks t ON s.id = t.id LEFT JOIN (SELECT track_id, count(*) AS n FROM variants GROUP BY track_id) v ON v.track_id = coalesce(s.id, t.id)
"""
query("a04_ingestion_state", lambda s, d: C.ingestion_state(A.seed(s, d), A.tracks(s, d), A.variants(s, d)), STATE)
query("a05_ingestion_report", lambda s, d: C.ingestion_report(C.ingestion_state(A.seed(s, d), A.tracks(s, d), A.variants(s, d))), f"""
SELECT count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'fetched') AS n_fetched, count(*) FILTER (WHERE status = 'analyzed') AS n_analyzed, count(*) FILTER (WHERE status = 'ready') AS n_ready,
    count(*) FILTER (WHERE in_config) AS configured, count(*) FILTER (WHERE NOT in_config) AS unconfigured, count(*) FILTER (WHERE failed) AS failed, bool_and(NOT in_config OR status = 'ready') AS complete FROM ({STATE})
""")
query("a06_stage_projections", lambda s, d: C.stage_projections(C.latency_summary(A.latency(s, d)), s.createDataFrame([(500, 1), (500, 8), (10000, 1), (10000, 8)], "n_tracks int, cores int")), f"""
SELECT stage, n_tracks, cores, {R4('h', 6)} AS hours, CASE WHEN h < 1 THEN CAST(round_even(h * 60, 0) AS BIGINT) || ' min' ELSE CAST(round_even(h * 10, 0) AS BIGINT) // 10 || '.' || CAST(round_even(h * 10, 0) AS BIGINT) % 10 || ' h' END AS label
FROM (SELECT stage, n_tracks, cores, {R4('avg(ms)', 6)} / 1000.0::DOUBLE * n_tracks * 4.0::DOUBLE * 3.0::DOUBLE / cores / 3600.0::DOUBLE AS h FROM latency, (VALUES (500, 1), (500, 8), (10000, 1), (10000, 8)) AS x(n_tracks, cores) GROUP BY stage, n_tracks, cores)
""")
query("a06_latency_projections", lambda s, d: C.latency_projections(C.latency_summary(A.latency(s, d)), s.createDataFrame([(500,), (10000,)], "n_tracks int"), A.tracks(s, d).filter("mixable").count()), f"""
SELECT stage, n_tracks, round_even({R4('avg(ms)', 6)} / greatest((SELECT count(*) FROM tracks WHERE mixable) - 1, 1) * (n_tracks - 1), 0) AS ms FROM latency, (VALUES (500), (10000)) x(n_tracks) GROUP BY stage, n_tracks
""")
query("a07_storage_totals", lambda s, d: C.storage_totals(A.inventory(s, d)), "SELECT CASE WHEN key LIKE 'audio/%' THEN 'masters' WHEN key LIKE 'variants/%' THEN 'variants' ELSE 'other' END AS kind, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM inventory GROUP BY kind")
query("a07_storage_by_policy", lambda s, d: C.storage_by_policy(A.inventory(s, d)), r"""
SELECT codec, CAST(p AS INTEGER) AS variants_kept, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM (
    SELECT regexp_extract(key, '[.]([a-z0-9]+)$', 1) AS codec, size, CASE WHEN key LIKE 'audio/%' THEN 0 ELSE row_number() OVER (PARTITION BY regexp_extract(key, '^(variants/[0-9]+|audio/)', 1) ORDER BY TRY_CAST(regexp_extract(key, '_([0-9]+)[.]', 1) AS INTEGER)) END AS k
    FROM inventory WHERE key LIKE 'audio/%' OR key LIKE 'variants/%'), (VALUES (9), (3), (1), (0)) t(p) WHERE k <= p GROUP BY codec, p
""")
query("a08_catalog_rollup", lambda s, d: C.catalog_rollup(A.tracks(s, d)), "SELECT band, license, status, count(*) AS n, CAST(grouping_id(band, license, status) AS BIGINT) AS level FROM banded GROUP BY ROLLUP (band, license, status)")
query("a09_top_k", lambda s, d: C.top_k(A.tracks(s, d).select("artist", "id", "duration_s"), ["artist"], [F.desc("duration_s"), F.col("id")], 3), "SELECT artist, id, duration_s, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY duration_s DESC, id) AS r FROM tracks) WHERE r <= 3")
query("a10_ids_union", lambda s, d: C.ids_union(A.seed(s, d), A.tracks(s, d)), "SELECT id FROM seed UNION SELECT id FROM tracks")
query("a10_ids_missing", lambda s, d: C.ids_missing(A.seed(s, d), A.tracks(s, d)), "SELECT id FROM seed EXCEPT SELECT id FROM tracks")
query("a10_ids_common", lambda s, d: C.ids_common(A.seed(s, d), A.tracks(s, d)), "SELECT id FROM seed INTERSECT SELECT id FROM tracks")
