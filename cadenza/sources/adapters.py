"""Catalogue tables derived from the driver's star schema, as FIXTURES.md lays them down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X

HOP = 0.25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks, those with an unknown licence too."""
    k = F.col("p_partkey")
    licences = ["CC BY 3.0", "CC BY-SA 3.0", "CC BY-NC 4.0", "CC BY-ND 3.0", "CC BY-NC-SA 2.5", "CC BY-NC-ND 3.0", "CC BY-SA 2.0 UK", "CC0"]
    bpm = 66.0 + (k * 37 % 1220) / 10.0
    status = F.when(k % 10 == 0, "pending").when(k % 10 == 1, "fetched").when(k % 10 == 2, "analyzed").otherwise("ready")
    return _table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"),
        F.when(k % 3 == 0, "auto").when(k % 3 == 1, F.lower("p_type")).otherwise(X.band_of(bpm)).alias("genre"),
        F.element_at(F.array(*map(F.lit, licences)), (k % 8 + 1).cast("int")).alias("license"),
        bpm.alias("native_bpm"), F.concat((k % 12 + 1).cast("string"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B")).alias("camelot"),
        (30.0 + (k * 17 % 2400) / 10.0).alias("duration_s"), F.when(k % 4 != 0, F.col("p_size").cast("double")).alias("popularity"),
        status.alias("status"), F.when((k % 10 == 1) & (k % 3 == 0), "boom").alias("status_error"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with a known licence, its flags, the gate and the object key of the master."""
    nd = X.licence_flag("nd")
    return (
        raw_tracks(spark, sf_dir)
        .filter(X.licence_variant().isNotNull())
        .withColumns({"license_nd": nd, "license_sa": X.licence_flag("sa"), "license_nc": X.licence_flag("nc"), "mixable": ~nd})
        .withColumn("audio_key", F.when(F.col("mixable"), F.concat(F.lit("audio/"), "id", F.lit(".m4a"))))
    )


def variant_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tempo import variant_plan as plan

    return plan(tracks(spark, sf_dir))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned variants without those that the fixture leaves out."""
    return variant_plan(spark, sf_dir).filter((F.col("track_id").cast("long") + F.col("grid_bpm")) % 17 != 0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(order)
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("track_id"), (F.row_number().over(order) - 1).alias("frame_idx"), F.col("value").alias("rms"),
        F.coalesce(F.greatest(F.col("value") - before, F.lit(0.0)), F.lit(0.0)).alias("flux"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("bass_ratio"),
    )


def series_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, owner`` of every track: whose frames stand for the track's, as there are fewer series than tracks."""
    n = _table(spark, sf_dir, "events").agg(F.count_distinct("user_id")).first()[0]
    return raw_tracks(spark, sf_dir).select("id", (F.col("id").cast("long") % F.lit(max(n, 1))).cast("string").alias("owner"))


def mix_tracks(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """Nodes of the saved mixes; ``corrupt`` adds the cycles, orphans and dangling links of the fixture."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    k = F.col("l_orderkey")
    rows = _table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    node = lambda p: F.concat(k.cast("string"), F.lit("-"), p.cast("string"))
    following = F.when(F.col("pos") < F.col("n"), node(F.col("pos") + 1))
    if corrupt:
        last, long = F.col("pos") == F.col("n"), F.col("n") >= 3
        following = (
            F.when(long & (k % 97 == 1) & last, node(F.lit(1)))
            .when(long & (k % 97 == 2) & (F.col("pos") == 1), node(F.lit(3)))
            .when(long & (k % 97 == 3) & last, "ghost")
            .otherwise(following)
        )
    return rows.select(
        node(F.col("pos")).alias("id"), k.cast("string").alias("mix_id"), F.col("l_partkey").cast("string").alias("track_id"), following.alias("next_id"),
        F.when(F.col("pos") == 1, 0).otherwise(F.col("l_quantity").cast("int") * 4).alias("delta_beats"), (120 + 5 * (k % 2)).cast("int").alias("grid_bpm"),
    )


def mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    key = F.col("o_orderkey").cast("string")
    return (
        _table(spark, sf_dir, "orders")
        .join(with_lines, "o_orderkey", "left")
        .select(key.alias("id"), F.concat(F.lit("mix "), key).alias("name"), F.when(F.col("has"), F.concat(key, F.lit("-1"))).alias("head_id"), at.alias("created_at"), at.alias("updated_at"))
    )


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("track_id"), F.col("value").alias("ms"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("ts").cast("timestamp").alias("at")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, size`` of the objects in store: planned ones but for some, and ten that no row names."""
    t = tracks(spark, sf_dir).filter("audio_key IS NOT NULL AND cast(id AS bigint) % 13 <> 0").select(F.col("audio_key").alias("key"), (F.col("duration_s") * 8000).cast("long").alias("size"))
    v = variants(spark, sf_dir).filter("cast(track_id AS bigint) % 13 <> 0").select(F.col("object_key").alias("key"), (F.col("duration_s") * 8000).cast("long").alias("size"))
    other = spark.range(10).select(F.concat(F.lit("stray/"), "id").alias("key"), F.lit(1).cast("long").alias("size"))
    return t.union(v).union(other)


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ordinal`` of the configured tracks, ten of which the catalogue doesn't have."""
    own = _table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ordinal"))
    more = spark.range(1, 11).select(F.concat(F.lit("seed-"), "id").alias("id"), (F.col("id") + 1_000_000_000).alias("ordinal"))
    return own.union(more)
