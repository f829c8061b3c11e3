"""Feature time series (F-01 to F-14). Long tables hold a row per frame, wide ones arrays per track."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D
from .scans import running_sums

SERIES = ("rms", "flux", "bass_ratio")


def by_frame() -> Window:
    return Window.partitionBy("track_id").orderBy("frame_idx")


def _spectrum(x: np.ndarray, frame: int, hop: int, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of some frames of ``x`` and their magnitudes, ``step`` frames at a time: Hann windows, no padding."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    n = 0 if len(x) < frame else 1 + (len(x) - frame) // hop
    for at in range(0, n, step):
        numbers = np.arange(at, min(n, at + step))
        yield numbers, np.abs(np.fft.rfft(x[numbers[:, None] * hop + np.arange(frame)] * window, axis=1)) / window.sum()


def spectra(audio: DataFrame, frame: int = 2048, hop: int = 512) -> DataFrame:
    """``track_id, frame_idx, bin, freq, mag`` from ``audio (track_id, sr, samples)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = frame // 2 + 1
        for batch in batches:
            for track, sr, samples in zip(batch["track_id"], batch["sr"], batch["samples"], strict=True):
                for numbers, mag in _spectrum(np.asarray(samples if samples is not None else [], float), frame, hop):
                    yield pd.DataFrame({"track_id": track, "frame_idx": np.repeat(numbers, bins), "bin": np.tile(np.arange(bins), len(numbers)), "freq": np.tile(np.arange(bins) * sr / frame, len(numbers)), "mag": mag.ravel()})

    return audio.select("track_id", "sr", "samples").mapInPandas(run, "track_id string, frame_idx int, bin int, freq double, mag double")


def frame_features(audio: DataFrame, frame: int = 2048, hop: int = 512, low: float = 20.0, high: float = 150.0, keep_errors: bool = False) -> DataFrame:
    """``track_id, frame_idx, rms, flux, bass_ratio`` from ``audio (track_id, sr, samples)``, one pass per track.

    Each frame is transformed once, some hundred at a time, so memory is that of the samples
    whatever the track's length. ``flux`` sums the rises of magnitude since the frame before
    (first frame 0), ``bass_ratio`` is the share of the bins from ``low`` to ``high`` Hz.
    Tracks without a whole frame have no rows; with ``keep_errors`` those with an ``error`` have one row, with it.
    """
    columns = ["track_id", "sr", "samples", *(["error"] if keep_errors else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if keep_errors and batch["error"].notna().any():
                yield batch.loc[batch["error"].notna(), ["track_id", "error"]].assign(frame_idx=pd.array([pd.NA] * int(batch["error"].notna().sum()), "Int32"), rms=None, flux=None, bass_ratio=None)
            for track, sr, samples in zip(batch["track_id"], batch["sr"], batch["samples"], strict=True):
                x = np.asarray(samples if samples is not None else [], float)
                before = None
                for numbers, mag in _spectrum(x, frame, hop):
                    squares = np.cumsum(np.r_[0.0, x[numbers[0] * hop : numbers[-1] * hop + frame] ** 2])
                    start = (numbers - numbers[0]) * hop
                    freq = np.arange(mag.shape[1]) * sr / frame
                    rises = np.maximum(np.diff(mag, axis=0, prepend=mag[:1] if before is None else before[None]), 0.0)
                    bass = mag[:, (freq >= low) & (freq <= high)].sum(axis=1)
                    before = mag[-1]
                    yield pd.DataFrame({"track_id": track, "frame_idx": numbers, "rms": np.sqrt((squares[start + frame] - squares[start]).clip(min=0) / frame), "flux": rises.sum(axis=1), "bass_ratio": bass / (mag.sum(axis=1) + 1e-12)} | ({"error": None} if keep_errors else {}))

    return audio.select(*columns).mapInPandas(run, "track_id string, frame_idx int, rms double, flux double, bass_ratio double" + (", error string" if keep_errors else ""))


#: Tempos between which :func:`estimate_tempo` looks.
SLOWEST, FASTEST = 70.0, 180.0
SERIES_OF_TRACK = "track_id string, sr int, duration_s double, hop_dur double, n int, rms array<double>, flux array<double>, bass_ratio array<double>, pitch array<double>, ac array<double>, error string"


def track_series(audio: DataFrame, frame: int = 2048, hop: int = 512, low: float = 20.0, high: float = 150.0) -> DataFrame:
    """One row per track of ``audio (track_id, sr, samples)``, from one transform per frame: the series of
    :func:`frame_features`, magnitudes summed per pitch class, and the autocorrelation of the onsets.

    ``hop_dur`` follows from the track's own rate, ``duration_s`` is that of its samples. What a
    frame leaves behind (the last spectrum, twelve sums) is carried on, so spectra are never kept.
    Tracks with an ``error`` (if ``audio`` has that column) keep it and have no series.
    """
    errors = "error" in audio.columns
    nothing = dict.fromkeys(f.split()[0] for f in SERIES_OF_TRACK.split(", "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if errors and isinstance(row.error, str):
                    yield pd.DataFrame([nothing | {"track_id": row.track_id, "error": row.error}]).astype({"sr": "Int32", "n": "Int32", "duration_s": "Float64", "hop_dur": "Float64"})
                    continue
                x = np.asarray(row.samples if row.samples is not None else [], float)
                parts, pitch, before = [], np.zeros(12), None
                freq = np.arange(frame // 2 + 1) * row.sr / frame
                bass, voiced = (freq >= low) & (freq <= high), (freq > 80) & (freq < 2500)
                classes = np.rint(69 + 12 * np.log2(freq[voiced] / 440.0)).astype(int) % 12
                for numbers, mag in _spectrum(x, frame, hop):
                    squares = np.cumsum(np.r_[0.0, x[numbers[0] * hop : numbers[-1] * hop + frame] ** 2])
                    start = (numbers - numbers[0]) * hop
                    rises = np.maximum(np.diff(mag, axis=0, prepend=mag[:1] if before is None else before[None]), 0.0)
                    before = mag[-1]
                    pitch += np.bincount(classes, mag[:, voiced].sum(axis=0), 12)
                    parts.append((np.sqrt((squares[start + frame] - squares[start]).clip(min=0) / frame), rises.sum(axis=1), mag[:, bass].sum(axis=1) / (mag.sum(axis=1) + 1e-12)))
                rms, flux, ratio = (np.concatenate(s) for s in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 3
                most = 12 * (round(60.0 / SLOWEST * row.sr / hop) + 1)
                series = {"rms": [rms], "flux": [flux], "bass_ratio": [ratio], "pitch": [pitch], "ac": [_correlation(flux, most)]}
                yield pd.DataFrame({"track_id": [row.track_id], "sr": [row.sr], "duration_s": [len(x) / row.sr], "hop_dur": [hop / row.sr], "n": [len(rms)]} | series | {"error": [None]})

    return audio.select("track_id", "sr", "samples", *(["error"] if errors else [])).mapInPandas(run, SERIES_OF_TRACK)


def _correlation(x: np.ndarray, most_lag: int) -> np.ndarray:
    """Autocorrelation of the mean-free series up to ``most_lag`` or its last lag, divided by that at 0."""
    x = x - x.mean() if len(x) else x
    ac = np.array([x[: len(x) - lag] @ x[lag:] for lag in range(min(most_lag + 1, len(x)))])
    return ac / ac[0] if len(ac) and ac[0] > 0 else ac


def frames_of(series: DataFrame) -> DataFrame:
    """``track_id, frame_idx, rms, flux, bass_ratio``: the long form of :func:`track_series`."""
    rows = series.filter("n > 0").select("track_id", F.posexplode(F.arrays_zip(*SERIES)).alias("frame_idx", "x"))
    return rows.select("track_id", "frame_idx", *(f"x.{c}" for c in SERIES))


def analyse(series: DataFrame) -> DataFrame:
    """:func:`track_series` with ``bpm``, ``beat_grid`` (seconds), ``tonic``, ``mode``, ``camelot``, ``confidence``.

    Tracks without a whole frame have 120 BPM, no beats, and the key of silence; failed ones have none of it."""
    rows = _with_tempo(series).withColumn("period", F.lit(60.0) / F.col("tempo") / F.col("hop_dur"))
    phase = f"array_max(transform(sequence(0, {PHASES - 1}), p -> struct(aggregate({_beats('p')}, 0.0D, (s, k) -> s + coalesce(get(flux, cast(floor(period * p / {PHASES} + k * period) AS int)), 0.0D)) AS s, -p AS low))).low"
    rows = rows.withColumn("phase", -F.expr(phase))
    beats = F.expr(f"if(n > 0, transform({_beats('phase')}, k -> floor((period * phase / {PHASES} + k * period) * hop_dur * 100000.0D + 0.5D) / 100000.0D), cast(array() AS array<double>))")
    rows = rows.withColumn("beat_grid", beats).withColumn("energies", chroma_of("pitch")).withColumn("key", key_of("energies"))
    heard = F.col("error").isNull()
    return rows.select(
        *series.columns, F.when(heard, X.round_up_half(F.col("tempo"), 2)).alias("bpm"), F.when(heard, F.col("beat_grid")).alias("beat_grid"), *(F.when(heard, F.col(f"key.{c}")).alias(c) for c in ("tonic", "mode", "camelot", "confidence"))
    )


#: Offsets of the first beat that are tried, evenly over a period.
PHASES = 24


def _beats(phase: str) -> str:
    """Numbers of the beats of a track with ``period`` that start at a phase."""
    return f"sequence(0, greatest(0, cast(ceil((n - period * {phase} / {PHASES}) / period) AS int) - 1))"


def chroma_of(pitch: str) -> Column:
    """Twelve sums of magnitudes, compressed and scaled to sum 1."""
    e = F.transform(pitch, lambda m: F.log1p(m))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def key_of(energies: str) -> Column:
    """``struct<tonic, mode, camelot, confidence>``: the best correlated of 24 rotated profiles, the first on ties."""
    profiles = []
    for s, t in enumerate(D.TONICS):
        for mode, profile, codes in (("major", D.MAJOR, D.CAMELOT_MAJOR), ("minor", D.MINOR, D.CAMELOT_MINOR)):
            w = np.roll(np.array(profile) - np.mean(profile), s)
            profiles.append(F.struct(F.array(*map(F.lit, (w / np.sqrt((w**2).sum())).tolist())).alias("w"), F.lit(len(profiles)).alias("i"), F.lit(t).alias("tonic"), F.lit(mode).alias("mode"), F.lit(codes[s]).alias("camelot")))
    e = F.col(energies)
    mean = F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / 12
    size = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)))
    product = lambda w: F.aggregate(F.zip_with(e, w, lambda x, y: (x - mean) * y), F.lit(0.0), lambda s, x: s + x)
    r = lambda p: F.when(size > 0, X.round_up_half(product(p["w"]) / size, 9)).otherwise(-2.0)
    best = F.array_max(F.transform(F.array(*profiles), lambda p: F.struct(r(p).alias("r"), (-p["i"]).alias("low"), p["tonic"].alias("tonic"), p["mode"].alias("mode"), p["camelot"].alias("camelot"))))
    return F.struct(best["tonic"].alias("tonic"), best["mode"].alias("mode"), best["camelot"].alias("camelot"), X.round_up_half(best["r"], 4).alias("confidence"))


def feature_job(audio: DataFrame, job: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's own feature function over batches of audio rows (filter ``audio`` first: nothing is pushed below it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield job(batch)

    return audio.mapInPandas(run, schema)


def frame_rms(audio: DataFrame, frame: int = 2048, hop: int = 512) -> DataFrame:
    """``track_id, frame_idx, rms`` of the same windows."""
    return frame_features(audio, frame, hop).select("track_id", "frame_idx", "rms")


def onset_strength(spectrum: DataFrame) -> DataFrame:
    """``track_id, frame_idx, flux``: rises of magnitude from frame to frame, summed over bins; the first frame 0."""
    before = F.lag("mag").over(Window.partitionBy("track_id", "bin").orderBy("frame_idx"))
    rise = F.coalesce(F.greatest(F.col("mag") - before, F.lit(0.0)), F.lit(0.0))
    return spectrum.withColumn("rise", rise).groupBy("track_id", "frame_idx").agg(F.sum("rise").alias("flux"))


def bass_ratio(spectrum: DataFrame, low: float = 20.0, high: float = 150.0) -> DataFrame:
    inside = F.when(F.col("freq").between(low, high), F.col("mag")).otherwise(0.0)
    return spectrum.groupBy("track_id", "frame_idx").agg((F.sum(inside) / (F.sum("mag") + 1e-12)).alias("bass_ratio"))


def prefix_sums(frames: DataFrame, columns: tuple[str, ...] = SERIES, block: int | None = None) -> DataFrame:
    """``track_id, k, p_…``: sums of the first k frames, k from 0 to n. With ``block``, a series is split into blocks of so many frames."""
    if block:
        rows = running_sums(frames.select("track_id", "frame_idx", *columns), {f"p_{c}": c for c in columns}, block=block).select("track_id", (F.col("frame_idx") + 1).alias("k"), *(f"p_{c}" for c in columns))
    else:
        upto = by_frame().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = frames.select("track_id", (F.col("frame_idx") + 1).alias("k"), *(F.sum(c).over(upto).alias(f"p_{c}") for c in columns))
    zero = frames.select("track_id").distinct().select("track_id", F.lit(0).alias("k"), *(F.lit(0.0).alias(f"p_{c}") for c in columns))
    return rows.unionByName(zero)


def window_means(windows: DataFrame, frames: DataFrame, column: str = "rms", block: int | None = None) -> DataFrame:
    """``windows (track_id, start, stop)`` with ``mean`` of the frames from ``start`` to ``stop`` (exclusive, one at least), by two lookups
    of prefix sums. Windows that reach past the ends of their series have none."""
    p = prefix_sums(frames, (column,), block)
    at = lambda k, v: p.select("track_id", F.col("k").alias(k), F.col(f"p_{column}").alias(v))
    rows = windows.withColumn("__end", F.greatest("stop", F.col("start") + 1)).withColumn("__start", F.col("start"))
    rows = rows.join(at("__start", "__p0"), ["track_id", "__start"], "left").join(at("__end", "__p1"), ["track_id", "__end"], "left")
    return rows.select(*windows.columns, ((F.col("__p1") - F.col("__p0")) / (F.col("__end") - F.col("__start"))).alias("mean"))


def prefix_arrays(frames: DataFrame) -> DataFrame:
    """``track_id, p``: the prefix sums of a track as one array, in order."""
    return prefix_sums(frames).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("k", *(f"p_{c}" for c in SERIES)))).alias("p"))


def wide_features(frames: DataFrame, tracks: DataFrame, hop_dur: float) -> DataFrame:
    """One row per track with frames: tempo, hop, counts, evenly spaced beats and prefix-sum arrays."""
    return features_of(prefix_arrays(frames).join(tracks.select(F.col("id").alias("track_id"), F.col("native_bpm").alias("bpm")), "track_id"), hop_dur)


def features_of(rows: DataFrame, hop_dur: float) -> DataFrame:
    """:func:`wide_features` of ``rows (track_id, bpm, p)``."""
    n = F.size("p") - 1
    beats = F.expr(f"transform(sequence(0, cast(ceil(n_frames * {hop_dur} * bpm / 60.0) AS int)), k -> k * 60.0D / bpm)")
    rows = rows.select("track_id", "bpm", F.lit(hop_dur).alias("hop_dur"), n.alias("n_frames"), (n * hop_dur).alias("duration_s"), *(F.col(f"p.p_{c}").alias(f"p_{c}") for c in SERIES))
    return rows.withColumn("beat_grid", F.filter(beats, lambda b: b < F.col("duration_s")))


def window_mean(prefix: str | Column, start: Column, end: Column) -> Column:
    """Mean over frames ``start`` to ``end`` (exclusive, one frame at least) from a prefix-sum array."""
    end = F.greatest(end, start + 1)
    return (F.element_at(X.col(prefix), (end + 1).cast("int")) - F.element_at(X.col(prefix), (start + 1).cast("int"))) / (end - start)


def autocorrelation(frames: DataFrame, most_lag: int, column: str = "flux") -> DataFrame:
    """``track_id, lag, ac`` of the mean-free series, lags 0 to ``most_lag`` or the track's last, divided by lag 0.

    A task has the series of one track at a time; lags are not exploded into rows of frames."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ac = _correlation(part.sort_values("frame_idx")["x"].to_numpy(float), most_lag)
        return pd.DataFrame({"track_id": key[0], "lag": np.arange(len(ac)), "ac": ac})

    return frames.select("track_id", "frame_idx", F.col(column).alias("x")).groupBy("track_id").applyInPandas(run, "track_id string, lag int, ac double")


def estimate_tempo(frames: DataFrame, hop_dur: float, low: float = SLOWEST, high: float = FASTEST) -> DataFrame:
    """``track_id, bpm``: the autocorrelation peak in range, compared with its musical multiples by a comb
    under a mild prior around 115 BPM, then refined by a parabola; 120 where the range is empty."""
    most = 12 * (round(60.0 / low / hop_dur) + 1)
    ac = autocorrelation(frames, most).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "ac"))), lambda s: s["ac"]).alias("ac"))
    n = frames.groupBy("track_id").agg(F.count("*").alias("n"))
    return _with_tempo(ac.join(n, "track_id").withColumn("hop_dur", F.lit(float(hop_dur))), low, high).select("track_id", F.col("tempo").alias("bpm"))


def _with_tempo(rows: DataFrame, low: float = SLOWEST, high: float = FASTEST) -> DataFrame:
    """Adds ``tempo`` to ``rows (ac, n, hop_dur)``; the autocorrelation reaches twelve times the longest lag in range."""
    names = rows.columns
    at = "get(ac, cast({} AS int))"
    comb = " + ".join(f"if(rint(c * {k}) < n, coalesce({at.format(f'rint(c * {k})')}, 0.0) / {k}, 0.0)" for k in (1, 2, 3, 4))
    score = f"({comb}) * (0.6D + 0.4D * exp(-0.5D * pow(log2(60.0D / (c * hop_dur) / 115.0D) / 0.6D, 2)))"
    sql = f"""
    aggregate(
        transform(array(0.5D, 2.0D / 3.0D, 1.0D, 1.5D, 2.0D, 3.0D), m -> m * lag0), struct(cast(lag0 AS double) AS c, -1e9D AS s),
        (best, c) -> CASE
            WHEN 60.0D / (c * hop_dur) < {low - 1} OR 60.0D / (c * hop_dur) > {high + 1} OR c >= n / 2.0D THEN best
            WHEN {score} > best.s THEN struct(c AS c, {score} AS s)
            ELSE best END
    ).c"""
    lag_of = lambda bpm: F.rint(F.lit(60.0 / bpm) / F.col("hop_dur")).cast("int")
    rows = rows.withColumn("lag_lo", F.greatest(F.lit(1), lag_of(high))).withColumn("top", F.least(lag_of(low), F.col("n") - 1).cast("int"))
    rows = rows.withColumn("lags", F.slice("ac", F.col("lag_lo") + 1, F.greatest(F.col("top") - F.col("lag_lo") + 1, F.lit(0))))
    rows = rows.withColumn("lag0", F.array_position("lags", F.array_max("lags")) - 1 + F.col("lag_lo")).withColumn("lag", F.rint(F.expr(sql)).cast("int"))
    a, b, c = (F.expr(at.format(f"lag + {d}")) for d in (-1, 0, 1))
    bend = a - 2 * b + c
    fine = F.when((F.col("lag") >= 1) & (F.col("lag") < F.col("n") - 1) & (F.abs(bend) > 1e-12), F.col("lag") + 0.5 * (a - c) / bend).otherwise(F.col("lag"))
    return rows.select(*names, F.when(F.col("top") <= F.col("lag_lo"), 120.0).otherwise(60.0 / (fine * F.col("hop_dur"))).alias("tempo"))


def beat_grid(frames: DataFrame, tempo: DataFrame, hop_dur: float, phases: int = 24) -> DataFrame:
    """``track_id, offset, beats`` (seconds): of ``phases`` offsets in a period the one with most onset energy, the first on ties.

    Energies are added in the order of the frames, so phases that hit the same frames have equal sums however rows are dealt to tasks."""
    own = frames.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "flux"))), lambda x: x["flux"]).alias("flux"))
    base = tempo.join(own, "track_id").withColumn("n", F.size("flux")).withColumn("period", 60.0 / F.col("bpm") / hop_dur)
    hit = f"filter(transform(sequence(0, greatest(0, cast(ceil((n - period * p / {phases}) / period) AS int) - 1)), k -> get(flux, cast(floor(period * p / {phases} + k * period) AS int))), x -> x IS NOT NULL)"
    sums = f"transform(sequence(0, {phases - 1}), p -> struct(aggregate({hit}, cast(NULL AS double), (s, x) -> coalesce(s + x, x)) AS s, -p AS low))"
    out = base.withColumn("phase", -F.array_max(F.expr(sums))["low"]).withColumn("offset", F.col("period") * F.col("phase") / phases)
    beats = F.expr(f"transform(sequence(0, greatest(0, cast(ceil((n - offset) / period) AS int) - 1)), k -> (offset + k * period) * {hop_dur}D)")
    return out.select("track_id", "offset", beats.alias("beats"))


def chroma(spectrum: DataFrame, low: float = 80.0, high: float = 2500.0) -> DataFrame:
    """``track_id, pc, energy``: magnitudes folded to twelve pitch classes, compressed and scaled to sum 1."""
    pc = F.pmod(F.rint(69 + 12 * F.log2(F.col("freq") / 440.0)).cast("int"), F.lit(12))
    inside = spectrum.filter((F.col("freq") > low) & (F.col("freq") < high)).groupBy("track_id", pc.alias("pc")).agg(F.sum("mag").alias("m"))
    every = inside.select("track_id").distinct().withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11))))
    rows = every.join(inside, ["track_id", "pc"], "left").withColumn("e", F.log1p(F.coalesce("m", F.lit(0.0))))
    total = F.sum("e").over(Window.partitionBy("track_id"))
    return rows.select("track_id", "pc", F.when(total > 0, F.col("e") / total).otherwise(0.0).alias("energy"))


def estimate_key(pitch: DataFrame) -> DataFrame:
    """``track_id, tonic, mode, camelot, confidence``: the best correlated of 24 rotated profiles."""
    spark = pitch.sparkSession
    rows = [(s, m, (k + s) % 12, p[k], t, c[s]) for s, t in enumerate(D.TONICS) for m, p, c in (("major", D.MAJOR, D.CAMELOT_MAJOR), ("minor", D.MINOR, D.CAMELOT_MINOR)) for k in range(12)]
    profiles = spark.createDataFrame(rows, "shift int, mode string, pc int, weight double, tonic string, camelot string")
    r = pitch.join(F.broadcast(profiles), "pc").groupBy("track_id", "shift", "mode", "tonic", "camelot").agg(F.corr("energy", "weight").alias("r"))
    r = r.withColumn("r", X.round_up_half(F.coalesce(F.nanvl("r", F.lit(-2.0)), F.lit(-2.0)), 9))
    order = Window.partitionBy("track_id").orderBy(F.desc("r"), "shift", "mode")
    return r.withColumn("n", F.row_number().over(order)).filter("n = 1").select("track_id", "tonic", "mode", "camelot", X.round_up_half(F.col("r"), 4).alias("confidence"))


def normalize_tonic(df: DataFrame, column: str = "tonic") -> tuple[DataFrame, DataFrame]:
    """(rows with sharps only and their ``camelot``, rows whose key has no code). Needs ``mode``."""
    tonic = X.choose(F.col(column), D.FLATS)
    named = df.withColumn(column, F.coalesce(tonic, F.col(column)))
    code = F.when(F.col("mode") == "major", X.choose(F.col(column), dict(zip(D.TONICS, D.CAMELOT_MAJOR, strict=True)))).when(F.col("mode") == "minor", X.choose(F.col(column), dict(zip(D.TONICS, D.CAMELOT_MINOR, strict=True))))
    named = named.withColumn("camelot", code)
    return named.filter("camelot IS NOT NULL"), named.filter("camelot IS NULL").drop("camelot")


def rescale(features: DataFrame, ratio: Column) -> DataFrame:
    """Features as they are at ``ratio`` times the tempo; frames stay."""
    return features.withColumn("__r", ratio).select(
        *(c for c in features.columns if c not in ("bpm", "duration_s", "hop_dur", "beat_grid")), X.round_up_half(F.col("bpm") * F.col("__r"), 2).alias("bpm"), (F.col("duration_s") / F.col("__r")).alias("duration_s"),
        (F.col("hop_dur") / F.col("__r")).alias("hop_dur"), F.expr("transform(beat_grid, b -> floor(b / __r * 100000.0D + 0.5D) / 100000.0D)").alias("beat_grid"),
    )


def envelope(features: DataFrame, points: int, bpm: Column | None = None) -> DataFrame:
    """``track_id, points, env, duration_s, hop_dur, bpm``: evenly spaced rms values over their peak."""
    ratio = F.lit(1.0) if bpm is None else F.coalesce(bpm / F.col("bpm"), F.lit(1.0))
    index = F.expr(f"transform(sequence(0, {points - 1}), k -> if(k = {points - 1}, n_frames - 1, cast(k * ((n_frames - 1.0D) / {points - 1}.0D) AS int)))")
    rms = F.transform(index, lambda i: F.element_at("p_rms", i + 2) - F.element_at("p_rms", i + 1))
    rows = features.filter("n_frames > 0").withColumn("e", rms).withColumn("top", F.array_max("e")).withColumn("__ratio", ratio)
    env = F.expr("transform(e, x -> floor(x / if(top = 0, 1.0D, top) * 10000.0D + 0.5D) / 10000.0D)")
    return rows.select("track_id", F.lit(points).alias("points"), env.alias("env"), (F.col("duration_s") / F.col("__ratio")).alias("duration_s"), (F.col("hop_dur") / F.col("__ratio")).alias("hop_dur"), (F.col("bpm") * F.col("__ratio")).alias("bpm"))


def native_envelopes(features: DataFrame, selected: DataFrame, sizes: tuple[int, ...] = (120, 480)) -> DataFrame:
    """Envelopes of every size for the tracks in ``selected (id)`` only."""
    some = features.join(selected.select(F.col("id").alias("track_id")), "track_id", "left_semi")
    out = envelope(some, sizes[0])
    for n in sizes[1:]:
        out = out.unionByName(envelope(some, n))
    return out


def analysis_audit(features: DataFrame, segments: DataFrame) -> DataFrame:
    """Per track: beats near the tempo, enough beats, and segments whole from intro to outro."""
    beats = features.select("track_id", "bpm", F.size("beat_grid").alias("n_beats"), F.posexplode_outer("beat_grid").alias("k", "b"))
    gap = F.col("b") - F.lag("b").over(Window.partitionBy("track_id").orderBy("k"))
    spacing = beats.withColumn("gap", gap).groupBy("track_id", "bpm", "n_beats").agg(F.percentile("gap", F.lit(0.5)).alias("spacing"))
    spacing = spacing.select("track_id", F.coalesce(F.abs(F.col("spacing") - 60 / F.col("bpm")) < 0.02, F.lit(False)).alias("beats_fit_tempo"), (F.col("n_beats") > 10).alias("enough_beats"))
    order = Window.partitionBy("track_id").orderBy("seg_idx")
    last = F.lead("seg_idx").over(order).isNull()
    s = segments.withColumn("whole", F.coalesce(F.lag("end_frame").over(order), F.lit(0)) == F.col("start_frame")).withColumn("last", last)
    s = s.groupBy("track_id").agg(
        F.every("whole").alias("contiguous"), F.every((F.col("seg_idx") > 0) | F.col("label").isin("intro", "full")).alias("starts_with_intro"), F.every(~F.col("last") | F.col("label").isin("outro", "full", "intro")).alias("ends_with_outro")
    )
    return spacing.join(s, "track_id", "left")
