"""Projections, lookups, summaries and rankings of the catalogue (Q-01 to Q-16, A-01 to A-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D
from .licensing import attribution, license_badges

SUMMARY = ["id", "name", "artist", "genre", "license", "license_nd", "license_sa", "license_nc", "mixable", "native_bpm", "camelot", "duration_s", "status"]


def get_track(tracks: DataFrame, id: str) -> DataFrame:
    return tracks.filter(F.col("id") == id)


def list_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.orderBy("id")


def list_mixable(tracks: DataFrame, mixable: bool = True) -> DataFrame:
    return tracks.filter(F.col("mixable") == mixable).orderBy("id")


def track_summaries(tracks: DataFrame) -> DataFrame:
    return tracks.select(SUMMARY).orderBy("id")


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def track_analysis(features: DataFrame, id: str) -> DataFrame:
    return features.filter(F.col("track_id") == id)


def track_segments(segments: DataFrame, id: str) -> DataFrame:
    return segments.filter(F.col("track_id") == id).orderBy("seg_idx")


def track_statuses(tracks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``id, status, status_error``; with ``ids (id)``, one row for each, unknown ones pending."""
    own = tracks.select("id", "status", "status_error")
    if ids is not None:
        own = ids.select("id").join(own, "id", "left")
    return own.withColumn("status", F.coalesce("status", F.lit("pending"))).orderBy("id")


def list_variants(variants: DataFrame, track_id: str | None = None) -> DataFrame:
    rows = variants if track_id is None else variants.filter(F.col("track_id") == track_id)
    return rows.orderBy("track_id", "grid_bpm")


def grid_map(variants: DataFrame) -> DataFrame:
    """``track_id, grid``: each track's tempos, in order."""
    return variants.groupBy("track_id").agg(F.array_sort(F.collect_list("grid_bpm")).alias("grid"))


def list_mixes(mixes: DataFrame) -> DataFrame:
    """Newest edit first."""
    return mixes.orderBy(F.desc("updated_at"), "id")


def mix_nodes(mix_tracks: DataFrame, mix_id: str) -> DataFrame:
    return mix_tracks.filter(F.col("mix_id") == mix_id)


def get_node(mix_tracks: DataFrame, id: str) -> DataFrame:
    return mix_tracks.filter(F.col("id") == id)


def mix_picker(mixes: DataFrame, mix_tracks: DataFrame) -> DataFrame:
    counts = mix_tracks.groupBy(F.col("mix_id").alias("id")).agg(F.count("*").alias("n"))
    return mixes.join(counts, "id", "left").select("id", "name", "updated_at", F.coalesce("n", F.lit(0)).alias("n_tracks"))


def catalog_listing(tracks: DataFrame, variants: DataFrame) -> DataFrame:
    """Ready tracks with their tempos, licence badges and attribution."""
    rows = license_badges(attribution(tracks.filter(F.col("status") == "ready")))
    grids = grid_map(variants).withColumnRenamed("track_id", "id")
    return rows.join(grids, "id", "left").select(*SUMMARY, F.coalesce("grid", F.array().cast("array<int>")).alias("grid"), "badges", "attribution")


def track_detail(tracks: DataFrame, features: DataFrame, segments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Summary, segments in order and beats; both empty where nothing was analysed."""
    rows = tracks.select(SUMMARY) if ids is None else tracks.select(SUMMARY).join(ids.select("id"), "id", "left_semi")
    lists = segments.groupBy(F.col("track_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seg_idx", "label", "start_frame", "end_frame"))).alias("segments"))
    beats = features.select(F.col("track_id").alias("id"), "beat_grid")
    empty = F.expr("cast(array() AS array<struct<seg_idx:int,label:string,start_frame:int,end_frame:int>>)")
    return rows.join(lists, "id", "left").join(beats, "id", "left").withColumn("segments", F.coalesce("segments", empty)).withColumn("beat_grid", F.coalesce("beat_grid", F.array().cast("array<double>")))


def resolve_audio(requests: DataFrame, tracks: DataFrame, variants: DataFrame) -> DataFrame:
    """``requests (track_id, grid_bpm)`` with ``object_key``: the master without a tempo, else the variant; null if there is none."""
    masters = tracks.select(F.col("id").alias("track_id"), "audio_key")
    rows = requests.join(masters, "track_id", "left").join(variants.select("track_id", "grid_bpm", "object_key"), ["track_id", "grid_bpm"], "left")
    return rows.select("track_id", "grid_bpm", F.when(F.col("grid_bpm").isNull(), F.col("audio_key")).otherwise(F.col("object_key")).alias("object_key"))


def pair_verdict(pairs: DataFrame, tracks: DataFrame, variants: DataFrame) -> DataFrame:
    """``a_id, b_id, verdict``: 404 for an unknown id, 403 for an unmixable side, 409 without a shared tempo, else ok."""
    side = tracks.select("id", "mixable").join(grid_map(variants).withColumnRenamed("track_id", "id"), "id", "left")
    a = side.select(F.col("id").alias("a_id"), F.col("mixable").alias("a_ok"), F.col("grid").alias("a_grid"))
    b = side.select(F.col("id").alias("b_id"), F.col("mixable").alias("b_ok"), F.col("grid").alias("b_grid"))
    verdict = (
        F.when(F.col("a_ok").isNull() | F.col("b_ok").isNull(), "404")
        .when(~F.col("a_ok") | ~F.col("b_ok"), "403")
        .when(~F.coalesce(F.arrays_overlap("a_grid", "b_grid"), F.lit(False)), "409")
        .otherwise("ok")
    )
    return pairs.join(a, "a_id", "left").join(b, "b_id", "left").select("a_id", "b_id", verdict.alias("verdict"))


def license_audit(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("license_nd", "license_sa", "license_nc").agg(F.count("*").alias("n"))


def latency_summary(latency: DataFrame) -> DataFrame:
    return latency.groupBy("stage").agg(F.count("*").alias("n"), X.round_up_half(F.avg("ms"), 6).alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def usable() -> Column:
    return F.coalesce(F.col("mixable"), F.lit(True)) & (F.col("status").isNull() | (F.col("status") == "ready"))


def genre_deck(tracks: DataFrame, per_genre: int = D.DECK_SIZE, include_unusable: bool = False) -> DataFrame:
    """The ``per_genre`` leading tracks of each genre, one row each, with the genre's totals.

    By popularity (none counts as 0), then by the first 8 bytes of the SHA-256 of ``genre:id``.
    ``tracks`` may lack ``popularity`` and ``status``.
    """
    for name, kind in (("popularity", "double"), ("status", "string"), ("mixable", "boolean")):
        if name not in tracks.columns:
            tracks = tracks.withColumn(name, F.lit(None).cast(kind))
    genre = F.coalesce(F.nullif(F.col("genre"), F.lit("")), F.lit("other"))
    rows = (tracks if include_unusable else tracks.filter(usable())).withColumn("genre", genre)
    rows = rows.withColumn("lot", F.substring(F.sha2(F.concat_ws(":", "genre", "id"), 256), 1, 16))
    order = Window.partitionBy("genre").orderBy(F.coalesce(-F.col("popularity"), F.lit(0.0)), "lot")
    totals = rows.groupBy("genre").agg(F.count("*").alias("total"), F.some(F.col("popularity").isNotNull()).alias("has_popularity"))
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_genre).select("genre", "rank", "id", "popularity")
    return top.join(totals, "genre").withColumn("showing", F.least("total", F.lit(per_genre)).cast("long"))


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, which must name tie columns, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("rank") <= k)


def ingestion_state(seed: DataFrame, tracks: DataFrame, variants: DataFrame) -> DataFrame:
    """Seeded ids and ids of the table: status, error, variants, and whether the seed names them."""
    counts = variants.groupBy(F.col("track_id").alias("id")).agg(F.count("*").alias("n_variants"))
    rows = seed.withColumn("in_config", F.lit(True)).join(tracks.select("id", "status", "status_error"), "id", "full_outer").join(counts, "id", "left")
    status = F.coalesce("status", F.lit("pending"))
    return rows.select(
        "id", "ordinal", F.coalesce("in_config", F.lit(False)).alias("in_config"), status.alias("status"), "status_error", F.coalesce("n_variants", F.lit(0)).alias("n_variants"),
        (F.col("status_error").isNotNull() & (status != "ready")).alias("failed"),
    )


def ingestion_report(state: DataFrame) -> DataFrame:
    return state.agg(
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in D.STATUSES), F.count_if("in_config").alias("configured"), F.count_if(~F.col("in_config")).alias("unconfigured"),
        F.count_if("failed").alias("failed"), F.coalesce(F.every(~F.col("in_config") | (F.col("status") == "ready")), F.lit(True)).alias("complete"),
    )


def stage_projections(summary: DataFrame, scenarios: DataFrame, longer: float = 4.0, engine: float = 3.0) -> DataFrame:
    """``summary (stage, avg_ms)`` projected to ``scenarios (n_tracks, cores)``: hours of work, and a label in whole minutes or tenths of hours."""
    hours = F.col("avg_ms") / 1000.0 * F.col("n_tracks") * longer * engine / F.col("cores") / 3600.0
    tenths = F.rint(hours * 10).cast("long")
    whole = lambda x: x.cast("long").cast("string")
    text = F.when(hours < 1, F.concat(whole(F.rint(hours * 60)), F.lit(" min"))).otherwise(F.concat(whole(F.floor(tenths / 10)), F.lit("."), whole(tenths % 10), F.lit(" h")))
    return summary.join(F.broadcast(scenarios)).select("stage", "n_tracks", "cores", X.round_up_half(hours, 6).alias("hours"), text.alias("label"))


def latency_projections(summary: DataFrame, sizes: DataFrame, n_mixable: int) -> DataFrame:
    """``stage, n_tracks, ms``: a scan measured over ``n_mixable`` tracks, in proportion to the others of a catalogue of ``sizes (n_tracks)``, to whole milliseconds."""
    ms = F.rint(F.col("avg_ms") / max(n_mixable - 1, 1) * (F.col("n_tracks") - 1))
    return summary.join(F.broadcast(sizes)).select("stage", "n_tracks", ms.alias("ms"))


def storage_totals(inventory: DataFrame) -> DataFrame:
    kind = F.when(F.startswith("key", F.lit("audio/")), "masters").when(F.startswith("key", F.lit("variants/")), "variants").otherwise("other")
    return inventory.groupBy(kind.alias("kind")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def storage_by_policy(inventory: DataFrame, policies: tuple[int, ...] = (9, 3, 1, 0)) -> DataFrame:
    """``codec, variants_kept, objects, bytes``: what each policy of keeping masters and the first variants of a track
    by tempo would store, by codec (the ending of the key)."""
    name = F.regexp_extract("key", r"^(audio|variants)/(.+?)(?:_([0-9]+))?[.]([a-z0-9]+)$", 2)
    part = lambda i: F.regexp_extract("key", r"^(audio|variants)/(.+?)(?:_([0-9]+))?[.]([a-z0-9]+)$", i)
    rows = inventory.select(part(1).alias("kind"), name.alias("id"), part(3).try_cast("int").alias("bpm"), part(4).alias("codec"), "size").filter("kind <> ''")
    rank = F.when(F.col("kind") == "audio", 0).otherwise(F.row_number().over(Window.partitionBy("kind", "codec", "id").orderBy("bpm")))
    kept = rows.withColumn("rank", rank).withColumn("variants_kept", F.explode(F.array(*map(F.lit, policies)))).filter("rank <= variants_kept")
    return kept.groupBy("codec", "variants_kept").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def catalog_rollup(tracks: DataFrame) -> DataFrame:
    """Counts by band, licence and status at every level of detail."""
    band = X.resolve_band("genre", "native_bpm").alias("band")
    return tracks.select(band, "license", "status").rollup("band", "license", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def ids_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def ids_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of ``a`` that ``b`` lacks."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def ids_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))
