"""Ingest planning as batch data work (I-01 to I-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D


def published_flags(tracks: DataFrame, variants: DataFrame, inventory: DataFrame) -> DataFrame:
    """``id, done``: unmixable, or master and at least one variant present and no variant missing."""
    keys = inventory.select(F.col("key"), F.lit(True).alias("there"))
    v = variants.join(keys.withColumnRenamed("key", "object_key"), "object_key", "left")
    v = v.groupBy(F.col("track_id").alias("id")).agg(F.every(F.col("there").isNotNull()).alias("variants_there"))
    m = tracks.select("id", "mixable", "audio_key").join(keys.withColumnRenamed("key", "audio_key"), "audio_key", "left").join(v, "id", "left")
    return m.select("id", F.when(~F.col("mixable"), True).otherwise(F.col("there").isNotNull() & F.coalesce("variants_there", F.lit(False))).alias("done"))


def ingest_plan(seed: DataFrame, flags: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(todo, skipped) of ``seed (id, ordinal)``; ``limit`` takes the first of the plan by ordinal."""
    rows = seed.join(flags, "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    todo = rows.filter(~F.col("done")).drop("done")
    return (todo if limit is None else todo.orderBy("ordinal").limit(limit)), rows.filter("done").drop("done")


def cost_report(todo: DataFrame, online: bool = True, batch: int = D.BATCH) -> DataFrame:
    n = F.count("*") if online else F.lit(0) * F.count("*")
    return todo.agg(F.ceil(n / batch).cast("long").alias("metadata_requests"), n.cast("long").alias("downloads"))


def request_batches(todo: DataFrame, size: int = D.BATCH) -> DataFrame:
    """``batch, ids, n``: ids in order, ``size`` to a request, joined by spaces.

    Numbers come from counts per range of ordinals and ranks inside, so no task sorts the whole plan."""
    ranged = todo.withColumn("range", F.floor(F.col("ordinal") / size).cast("long"))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    coarse = counts.withColumn("block", F.floor(F.col("range") / 4096).cast("long"))
    blocks = coarse.groupBy("block").agg(F.sum("n").alias("b")).withColumn("b0", F.sum("b").over(Window.orderBy("block")) - F.col("b"))  # one row for each 4096 ranges
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("range")) - F.col("n")
    starts = coarse.withColumn("in", inside).join(blocks.select("block", "b0"), "block").select("range", (F.col("b0") + F.col("in")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("ordinal", "id")) - 1
    numbered = ranged.withColumn("r", rank).join(starts, "range").withColumn("k", F.col("before") + F.col("r"))
    lists = numbered.groupBy(F.floor(F.col("k") / size).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("l"), F.count("*").alias("n"))
    return lists.select("batch", F.array_join("l.id", " ").alias("ids"), "n")


def completeness_audit(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Batches with fewer results than ids: ``batch, asked, returned, missing``. ``responses (batch, id)`` are the results.

    A short answer never means that a track is gone; its ids are asked for again."""
    asked = batches.select("batch", F.explode(F.split("ids", " ")).alias("id"))
    got = responses.select("batch", "id").distinct().withColumn("got", F.lit(True))
    rows = asked.join(got, ["batch", "id"], "left")
    out = rows.groupBy("batch").agg(F.count("*").alias("asked"), F.count("got").alias("returned"), F.array_sort(F.collect_list(F.when(F.col("got").isNull(), F.col("id")))).alias("missing"))
    return out.filter("returned < asked").select("batch", "asked", "returned", F.array_join("missing", " ").alias("missing"))


def reuse_split(todo: DataFrame, sidecars: DataFrame, inventory: DataFrame, refetch: bool = False) -> DataFrame:
    """``todo`` with ``cached``: side-car and PCM master are both there."""
    key = F.concat(F.lit("audio/"), "id", F.lit(".wav"))
    rows = todo.withColumn("__key", key).join(sidecars.select("id").distinct().withColumn("__s", F.lit(True)), "id", "left")
    rows = rows.join(inventory.select(F.col("key").alias("__key")).distinct().withColumn("__o", F.lit(True)), "__key", "left")
    cached = F.lit(False) if refetch else F.col("__s").isNotNull() & F.col("__o").isNotNull()
    return rows.withColumn("cached", cached).drop("__key", "__s", "__o")


def resume_stage(seed: DataFrame, tracks: DataFrame, inventory: DataFrame, force: bool = False) -> DataFrame:
    """``id, next``: fetch, analyse, render or none, by the status reached and the artefacts that are left."""
    reached = F.coalesce(F.array_position(F.array(*map(F.lit, D.STATUSES)), F.col("status")), F.lit(1))
    rows = seed.select("id").join(tracks.select("id", "mixable", "status", "audio_key", "native_bpm"), "id", "left")
    rows = rows.join(inventory.select(F.col("key").alias("audio_key")).distinct().withColumn("there", F.lit(True)), "audio_key", "left")
    blocked = F.coalesce(~F.col("mixable"), F.lit(False))
    nxt = (
        F.when(blocked, "none").when(F.lit(force) | (reached < 2) | F.col("there").isNull(), "fetch").when((reached < 3) | F.col("native_bpm").isNull(), "analyse").when(reached < 4, "render").otherwise("none")
    )
    return rows.select("id", nxt.alias("next"))


def reencode_plan(tracks: DataFrame, variants: DataFrame, inventory: DataFrame, codec: str = "aac") -> DataFrame:
    """``kind, id, grid_bpm, src, dst, action, repoint`` for every master and variant; unmixable tracks are left out."""
    ext = D.CODECS[codec][0]
    key = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    tid, bpm = F.col("id"), F.col("grid_bpm").cast("string")
    m = tracks.filter("audio_key IS NOT NULL").select(F.lit("master").alias("kind"), "id", F.lit(None).cast("int").alias("grid_bpm"), key("audio/", tid, ".wav").alias("src"), key("audio/", tid, f".{ext}").alias("dst"), F.col("audio_key").alias("now"))
    v = variants.select(F.lit("variant").alias("kind"), F.col("track_id").alias("id"), "grid_bpm", "object_key").select("kind", "id", "grid_bpm", key("variants/", tid, "_", bpm, ".wav").alias("src"), key("variants/", tid, "_", bpm, f".{ext}").alias("dst"), F.col("object_key").alias("now"))
    keys = inventory.select("key").distinct()
    rows = m.unionByName(v).join(keys.select(F.col("key").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left").join(keys.select(F.col("key").alias("src"), F.lit(True).alias("has_src")), "src", "left")
    action = F.when(F.col("has_dst").isNotNull(), "present").when(F.col("has_src").isNotNull(), "encode").otherwise("missing-source")
    return rows.select("kind", "id", "grid_bpm", "src", "dst", action.alias("action"), (F.col("now") != F.col("dst")).alias("repoint"))


def reencode_report(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.count_if("repoint").alias("to_repoint"))


def repoint(tracks: DataFrame, variants: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with the new keys of all objects that have a source."""
    good = plan.filter("action <> 'missing-source'")
    m = good.filter("kind = 'master'").select("id", F.col("dst").alias("__dst"))
    v = good.filter("kind = 'variant'").select(F.col("id").alias("track_id"), "grid_bpm", F.col("dst").alias("__dst"))
    return (
        tracks.join(m, "id", "left").withColumn("audio_key", F.coalesce("__dst", "audio_key")).select(tracks.columns),
        variants.join(v, ["track_id", "grid_bpm"], "left").withColumn("object_key", F.coalesce("__dst", "object_key")).select(variants.columns),
    )


def orphan_objects(inventory: DataFrame, tracks: DataFrame, variants: DataFrame) -> DataFrame:
    """``key, problem``: objects that no row names (``orphan``), and named ones that are not there (``absent``)."""
    named = tracks.filter("audio_key IS NOT NULL").select(F.col("audio_key").alias("key")).union(variants.select("object_key")).distinct()
    have = inventory.select("key").distinct()
    return have.join(named, "key", "left_anti").withColumn("problem", F.lit("orphan")).union(named.join(have, "key", "left_anti").withColumn("problem", F.lit("absent")))


def publish(spark: SparkSession, seed: DataFrame, audio: DataFrame, path: str, gate: Column | None = None, frame: int = 2048, hop: int = 512) -> DataFrame:
    """One batch run over ``seed (id, genre, license, …)`` and ``audio (track_id, sr, samples, error)``: what is
    published already is skipped, then licence gate, analysis and segments of what passes, variant plan, and the
    tables written below ``path`` (analysis and segments in ``analysis``, tracks and variants in ``catalog``, as snapshots).

    Tempo, key and length are those of the audio, at its own rate; a ``bpm`` of the seed is not used.
    Returns ``id, outcome``. A track that can't be read gets its error; the run goes on.
    """
    from ..sources import snapshots
    from . import features, licensing, merge, segments, tempo

    before = merge.read_published(spark, f"{path}/catalog")
    done = seed.limit(0).select("id") if before is None else before[0].filter("status = 'ready'").select("id")
    skipped = seed.join(done, "id", "left_semi")
    known, quarantined = licensing.split_licenses(seed.join(done, "id", "left_anti"))
    mixable, refused = licensing.gate_mixable(licensing.parse_license(known).withColumns({"audio_key": F.lit(None).cast("string"), "status": F.lit("pending")}))
    if gate is not None:
        mixable = licensing.accept(mixable, gate)
    wanted = audio.join(mixable.select(F.col("id").alias("track_id")), "track_id", "left_semi")  # before any audio is framed
    analysis = f"{path}/analysis"
    n = max(snapshots.numbers(spark, analysis), default=-1) + 1
    # audio is decoded and transformed once, here; the rest reads the table written
    features.analyse(features.track_series(wanted, frame, hop)).write.mode("overwrite").parquet(f"{analysis}/v={n}/tracks")
    rows = spark.read.parquet(f"{analysis}/v={n}/tracks")
    heard = rows.filter("error IS NULL AND n > 0")
    cut = None
    for (rate,) in heard.select("sr").distinct().collect():  # a handful: smoothing widths follow from the rate
        some = segments.segment(features.frames_of(heard.filter(F.col("sr") == rate)), hop / rate)
        cut = some if cut is None else cut.union(some)
    if cut is None:
        cut = segments.segment(features.frames_of(heard), hop / 22_050)
    snapshots.write_snapshot(spark, analysis, {"segments": cut}, number=n)
    found = heard.select(F.col("track_id").alias("id"), F.col("bpm").alias("native_bpm"), "camelot", "duration_s")
    ready = mixable.drop("native_bpm", "camelot", "duration_s").join(found, "id").withColumns({"status": F.lit("ready"), "audio_key": F.concat(F.lit("audio/"), "id", F.lit(".m4a")), "genre": F.coalesce(X.resolve_band("genre", "native_bpm"), F.lit(""))})
    plan = tempo.variant_plan(ready.withColumn("genre", F.nullif("genre", F.lit(""))))
    tracks = ready if before is None else merge.upsert_tracks(before[0], ready)
    merge.publish_tracks(tracks, plan if before is None else merge.upsert_variants(before[1], plan), f"{path}/catalog")
    outcome = F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), "error")).when(F.coalesce("n", F.lit(0)) == 0, "failed: no frames").otherwise("ready")
    made = mixable.select("id").join(rows.select(F.col("track_id").alias("id"), "error", "n"), "id", "left").select("id", outcome.alias("outcome"))
    others = ((skipped, "skipped: published already"), (refused, "refused: no derivatives"), (quarantined, "quarantined: unknown licence"))
    for rows, why in others:
        made = made.union(rows.select("id", F.lit(why)))
    return made
