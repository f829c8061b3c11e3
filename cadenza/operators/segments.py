"""Segmentation by novelty (N-01 to N-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from .features import by_frame
from .scans import in_blocks, running_sums

LEAST_FRAMES, LEAST_SEGMENTS = 16, 4


def per_track() -> Window:
    return Window.partitionBy("track_id")


def smoothing(hop_dur: float) -> int:
    return max(1, int(0.5 / hop_dur))


def moving_average(column: str | Column, k: int) -> Column:
    """Centred over ``k`` frames, zeros beyond the ends (always divided by ``k``)."""
    return F.sum(X.col(column)).over(by_frame().rowsBetween(-(k // 2), (k - 1) // 2)) / k


def blended_feature(frames: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Adds ``feature``: smoothed loudness over its peak and half of the smoothed flux over its own. With ``block``, series are split."""
    smooth = lambda df: df.withColumn("feature", moving_average("r", k) + 0.5 * moving_average("f", k))
    share = lambda df, r, f: df.withColumn("r", F.col("rms") / (r + 1e-12)).withColumn("f", F.col("flux") / (f + 1e-12))
    if not block:
        return smooth(share(frames, F.max("rms").over(per_track()), F.max("flux").over(per_track()))).drop("r", "f")
    peaks = frames.groupBy(F.col("track_id").alias("__id")).agg(F.max("rms").alias("__r"), F.max("flux").alias("__f"))
    rows = share(frames.join(peaks, F.col("track_id").eqNullSafe(F.col("__id"))), F.col("__r"), F.col("__f")).drop("__id", "__r", "__f")
    return in_blocks(rows, smooth, k // 2, (k - 1) // 2, block=block).drop("r", "f")


def novelty(frames: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Adds ``novelty``: the smoothed size of the slope of ``feature``, rounded to 9 digits. With ``block``, series are split."""

    def near(rows: DataFrame) -> DataFrame:
        before, after = F.lag("feature").over(by_frame()), F.lead("feature").over(by_frame())
        slope = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col("feature")).when(after.isNull(), F.col("feature") - before).otherwise((after - before) / 2)
        rows = rows.withColumn("slope", F.abs(slope))
        return rows.withColumn("novelty", X.round_up_half(moving_average("slope", k), 9)).drop("slope")

    # a slope reaches a frame further than the average of slopes
    return in_blocks(frames, near, k // 2 + 1, (k - 1) // 2 + 1, block=block) if block else near(frames)


def local_maxima(frames: DataFrame, column: str = "novelty", block: int | None = None) -> DataFrame:
    """``track_id, frame_idx, height``: frames above both neighbours; of a level run the middle one, rounded down. Ends never count.

    With ``block``, series are split, runs that cross blocks included."""
    change = lambda df: df.withColumn("__change", F.coalesce((F.col(column) != F.lag(column).over(by_frame())).cast("int"), F.lit(0)))
    if block:
        runs = running_sums(in_blocks(frames, change, 1, 0, block=block), {"run": "__change"}, block=block)
    else:
        runs = change(frames).withColumn("run", F.sum("__change").over(by_frame().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("track_id", "run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"), F.first(column).alias("height"))
    order = Window.partitionBy("track_id").orderBy("run")
    beside = lambda df: df.withColumn("before", F.lag("height").over(order)).withColumn("after", F.lead("height").over(order))
    runs = in_blocks(runs, beside, 1, 1, "run", block) if block else beside(runs)  # runs are numbered from 0 on
    return runs.filter("before < height AND after < height").select("track_id", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("frame_idx"), "height")


def suppress_close(peaks: DataFrame, min_gap: int) -> DataFrame:
    """Highest first (later frames first on ties), peaks nearer than ``min_gap`` frames to a kept one go.

    A greedy fold over the peaks of one track, whose number the track's length bounds."""
    lists = peaks.groupBy("track_id").agg(F.collect_list(F.struct((-F.col("height")).alias("h"), (-F.col("frame_idx")).alias("f"))).alias("p"))
    kept = F.expr(f"aggregate(array_sort(p), cast(array() AS array<struct<h:double,f:int>>), (kept, x) -> if(exists(kept, y -> abs(x.f - y.f) < {min_gap}), kept, array_append(kept, x)))")
    return lists.select("track_id", F.explode(kept).alias("x")).select("track_id", (-F.col("x.f")).alias("frame_idx"), (-F.col("x.h")).alias("height"))


def strongest_peaks(peaks: DataFrame, n: int = 7) -> DataFrame:
    order = Window.partitionBy("track_id").orderBy(F.desc("height"), F.desc("frame_idx"))
    return peaks.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).drop("n")


def boundaries_to_segments(peaks: DataFrame, lengths: DataFrame) -> DataFrame:
    """``track_id, seg_idx, start_frame, end_frame`` from inner peaks and ``lengths (track_id, n_frames)``."""
    ends = lengths.select("track_id", F.explode(F.array(F.lit(0), F.col("n_frames").cast("int"))).alias("b"))
    inner = peaks.join(lengths, "track_id").filter("frame_idx > 0 AND frame_idx < n_frames - 1").select("track_id", F.col("frame_idx").alias("b"))
    order = Window.partitionBy("track_id").orderBy("b")
    all_ = ends.union(inner).distinct().withColumn("end_frame", F.lead("b").over(order)).withColumn("seg_idx", F.row_number().over(order) - 1)
    return all_.filter("end_frame IS NOT NULL").select("track_id", "seg_idx", F.col("b").alias("start_frame"), "end_frame")


def segment_energy(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``energy`` (mean rms, 9 digits) and the track's ``lo``, ``hi`` quantiles of it."""
    from .features import prefix_sums

    p = prefix_sums(frames, ("rms",))
    at = lambda k, v: p.select("track_id", F.col("k").alias(k), F.col("p_rms").alias(v))
    rows = segments.join(at("start_frame", "p0"), ["track_id", "start_frame"]).join(at("end_frame", "p1"), ["track_id", "end_frame"])
    rows = rows.withColumn("energy", X.round_up_half((F.col("p1") - F.col("p0")) / (F.col("end_frame") - F.col("start_frame")), 9)).drop("p0", "p1")
    q = rows.groupBy("track_id").agg(F.percentile("energy", F.lit(0.33)).alias("lo"), F.percentile("energy", F.lit(0.66)).alias("hi"))
    return rows.join(q, "track_id")


def label_segments(segments: DataFrame, hop_dur: float) -> DataFrame:
    """Labels in the order intro, outro, breakdown, drop, verse; tracks under 16 frames are one ``full`` segment."""
    n = F.count("*").over(per_track())
    length = F.max("end_frame").over(per_track())
    label = (
        F.when(length < LEAST_FRAMES, "full").when(F.col("seg_idx") == 0, "intro").when(F.col("seg_idx") == n - 1, "outro")
        .when(F.col("energy") <= F.col("lo"), "breakdown").when(F.col("energy") >= F.col("hi"), "drop").otherwise("verse")
    )
    return segments.withColumn("label", label).select(
        "track_id", "seg_idx", "label", "start_frame", "end_frame", X.round_up_half(F.col("start_frame") * hop_dur, 4).alias("start_s"), X.round_up_half(F.col("end_frame") * hop_dur, 4).alias("end_s"), X.round_up_half(F.col("energy"), 6).alias("energy")
    )


def peaks_of(frames: DataFrame, hop_dur: float, block: int | None = None) -> DataFrame:
    k = smoothing(hop_dur)
    return local_maxima(novelty(blended_feature(frames, k, block), k, block), block=block)


def segment(frames: DataFrame, hop_dur: float, min_segments: int = LEAST_SEGMENTS) -> DataFrame:
    """Labelled segments of every track in ``frames (track_id, frame_idx, rms, flux)``."""
    lengths = frames.groupBy("track_id").agg(F.count("*").alias("n_frames"))
    peaks = strongest_peaks(suppress_close(peaks_of(frames, hop_dur), max(1, int(3.0 / hop_dur))), max(min_segments + 2, 7))
    peaks = peaks.join(lengths.filter(F.col("n_frames") >= LEAST_FRAMES).select("track_id"), "track_id", "left_semi")
    return label_segments(segment_energy(boundaries_to_segments(peaks, lengths), frames), hop_dur)
