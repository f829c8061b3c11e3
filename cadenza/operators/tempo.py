"""Tempo-grid planning (G-01 to G-09); the column forms are in ``functions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D


def with_grid(tracks: DataFrame) -> DataFrame:
    """Adds ``band`` and ``grid``."""
    return tracks.withColumn("band", X.resolve_band("genre", "native_bpm")).withColumn("grid", X.grid_points("native_bpm", "band"))


def variant_plan(tracks: DataFrame, extension: str = "m4a") -> DataFrame:
    """``track_id, grid_bpm, ratio, object_key, duration_s`` of every variant that mixable tracks should have."""
    each = with_grid(tracks.filter("mixable")).select("id", "native_bpm", "duration_s", F.explode("grid").alias("grid_bpm"))
    ratio = F.col("grid_bpm") / F.col("native_bpm")
    return each.select(
        F.col("id").alias("track_id"), "grid_bpm", ratio.alias("ratio"), F.concat(F.lit("variants/"), "id", F.lit("_"), F.col("grid_bpm").cast("string"), F.lit(f".{extension}")).alias("object_key"), (F.col("duration_s") / ratio).alias("duration_s")
    )


def missing_variants(plan: DataFrame, variants: DataFrame) -> DataFrame:
    return plan.join(variants.select("track_id", "grid_bpm"), ["track_id", "grid_bpm"], "left_anti")


def bands(spark: SparkSession) -> DataFrame:
    """``band, lo, hi, grid``: six rows."""
    return spark.createDataFrame([(n, a, b, D.grid_of(a, b)) for n, (a, b) in D.BANDS.items()], "band string, lo int, hi int, grid array<int>")


def grid_coverage(spark: SparkSession, step: float = 0.5, spacing: int = D.GRID_SPACING) -> DataFrame:
    """Per band: pairs of native tempos that share a point at ``spacing`` and at 1 BPM, the loss in percent,
    and the worst stretch of the pairs that share one. Native tempos lie ``step`` apart inside the band."""
    rows = []
    for name, (low, high) in D.BANDS.items():
        rows.append((name, low, high, D.grid_of(low, high, spacing), D.grid_of(low, high, 1)))
    table = spark.createDataFrame(rows, "band string, lo int, hi int, coarse array<int>, fine array<int>")
    near = lambda grid, bpm: F.filter(grid, lambda g: F.abs(g / bpm - 1) <= D.MOST_STRETCH)
    native = table.withColumn("k", F.explode(F.expr(f"sequence(0, cast((hi - lo) / {step} AS int))"))).withColumn("bpm", F.col("lo") + F.col("k") * step)
    native = native.select("band", "bpm", near(F.col("coarse"), F.col("bpm")).alias("coarse"), near(F.col("fine"), F.col("bpm")).alias("fine"))
    a, b = native.alias("a"), native.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bpm") <= F.col("b.bpm")))
    stretch = F.array_min(F.transform(F.array_intersect("a.coarse", "b.coarse"), lambda g: F.greatest(F.abs(g / F.col("a.bpm") - 1), F.abs(g / F.col("b.bpm") - 1))))
    out = pairs.groupBy(F.col("a.band").alias("band")).agg(
        F.count("*").alias("pairs"), F.count_if(F.arrays_overlap("a.coarse", "b.coarse")).alias("coarse_pairs"), F.count_if(F.arrays_overlap("a.fine", "b.fine")).alias("fine_pairs"), F.max(stretch).alias("worst")
    )
    lost = X.round_up_half(100.0 * (F.col("fine_pairs") - F.col("coarse_pairs")) / F.col("fine_pairs"), 2)
    return out.select("band", "pairs", "coarse_pairs", "fine_pairs", lost.alias("lost_percent"), X.round_up_half(F.col("worst"), 6).alias("worst_stretch"))


def catalog_coherence(tracks: DataFrame) -> DataFrame:
    """``rule, holds``: what a catalogue must offer for planning to work."""
    t = with_grid(tracks)
    one = t.agg(
        F.coalesce(F.every(F.col("band").isNull() | (F.size("grid") > 0)), F.lit(True)).alias("every banded track reaches its grid"),
        *(F.coalesce(F.some(F.col(f"license_{f}")), F.lit(False)).alias(f"some track is {f.upper()}") for f in ("nd", "sa", "nc")),
        F.coalesce(F.some(~F.col("license_nd") & ~F.col("license_sa") & ~F.col("license_nc")), F.lit(False)).alias("some track is unrestricted"),
    )
    pair = t.filter("mixable").select(F.explode("grid").alias("g")).groupBy("g").count().agg(F.coalesce(F.max("count") > 1, F.lit(False)).alias("some mixable pair shares a point"))
    rules = [*one.columns, *pair.columns]
    return one.join(pair).select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("holds")) for r in rules))).alias("x")).select("x.rule", "x.holds")


def band_gaps(spark: SparkSession) -> DataFrame:
    """Neighbouring bands that leave tempos between them: empty if the bands are whole."""
    order = Window.orderBy("lo")  # six rows
    return bands(spark).withColumn("next", F.lead("lo").over(order)).filter("next - 0.5 > hi + 0.5").select("band", "hi", "next")


def grid_coverage_of(tracks: DataFrame, spacing: int = D.GRID_SPACING) -> DataFrame:
    """:func:`grid_coverage` counts over the native tempos that the catalogue holds: pairs of distinct tempos of a band.

    Tempos that reach the same grid points are counted together, and only such groups (few per
    band, however many tempos there are) are paired."""
    tempos = with_grid(tracks).filter("band IS NOT NULL").select("band", F.col("native_bpm").alias("bpm")).distinct()
    spark = tracks.sparkSession
    table = spark.createDataFrame([(n, D.grid_of(a, b, spacing), D.grid_of(a, b, 1)) for n, (a, b) in D.BANDS.items()], "band string, coarse array<int>, fine array<int>")
    near = lambda grid: F.filter(grid, lambda g: F.abs(g / F.col("bpm") - 1) <= D.MOST_STRETCH)
    rows = tempos.join(F.broadcast(table), "band").select("band", near("coarse").alias("coarse"), near("fine").alias("fine"))
    groups = rows.groupBy("band", "coarse", "fine").agg(F.count("*").alias("n")).withColumn("key", F.concat_ws("|", F.array_join("coarse", ","), F.array_join("fine", ",")))
    pairs = groups.alias("a").join(groups.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.key") <= F.col("b.key")))
    # a group with itself: every two of its tempos, and each tempo with itself
    n = F.when(F.col("a.key") == F.col("b.key"), F.expr("a.n * (a.n + 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
    shared = lambda c: F.sum(F.when(F.arrays_overlap(f"a.{c}", f"b.{c}"), n).otherwise(0))
    return pairs.groupBy(F.col("a.band").alias("band")).agg(F.sum(n).alias("pairs"), shared("coarse").alias("coarse_pairs"), shared("fine").alias("fine_pairs"))
