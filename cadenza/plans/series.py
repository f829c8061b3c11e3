"""Queries of features, segmentation, matching and transitions, with the SQL that checks them."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D
from ..operators import chains as C
from ..operators import features as E
from ..operators import matching as R
from ..operators import segments as N
from ..operators import transitions as T
from ..sources import adapters as A
from ..sources.staging import is_staged, shared_dir, stage, staged_tables
from .registry import query
from .views import R4, VIEWS

H = A.HOP


def r(df, *columns, digits=6):
    """``df`` with sums in floating point rounded, as their order differs between engines."""
    return df.withColumns({c: X.round_up_half(F.col(c), digits) for c in columns})


def audio(s, d):
    """Vectors as short signals."""
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("track_id"), F.lit(64).alias("sr"), F.col("embedding").alias("samples"))


def spectrum(s, d):
    return E.spectra(audio(s, d), 16, 4)


def pitch_classes(s, d):
    """Series of the short signals at a rate at which their bins are audible."""
    return E.track_series(audio(s, d).withColumn("sr", F.lit(64 * 40)), 16, 4)


RATES = [2560, 3840, 5120]


def signals(s, d):
    """Vectors one after another, 64 to a track, at one of three rates."""
    g = F.floor(F.col("vec_id") / 64).cast("long")
    own = s.read.parquet(f"{d}/embeddings.parquet").groupBy(g.alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    rate = F.element_at(F.array(*map(F.lit, RATES)), (F.col("g") % 3 + 1).cast("int"))
    return own.select(F.col("g").cast("string").alias("track_id"), rate.alias("sr"), F.flatten(F.transform("v", lambda x: x["embedding"])).alias("samples"))


def wide(s, d):
    return E.wide_features(A.frames(s, d), A.raw_tracks(s, d), H)


def segments(s, d):
    return N.segment(A.frames(s, d), H)


def made_once(make):
    """``make(s, d)`` written to the shared folder; the queries of an application that start from it read the one table."""
    made = {}

    @wraps(make)
    def table(s, d):
        key = (s.sparkContext.applicationId, d)
        if key not in made or not is_staged(s, made[key][0]):
            with staged_tables() as paths:
                df = stage(make(s, d), make.__name__)
            made[key] = paths[-1], df
        return made[key][1]

    return table


def by_path(make):
    """``make(s, d)`` returns a folder; the queries of an application that start from it read the one folder."""
    made = {}

    @wraps(make)
    def folder(s, d):
        key = (s.sparkContext.applicationId, d)
        if key not in made:
            made[key] = make(s, d)
        return made[key]

    return folder


@made_once
def all_wide(s, d):
    """Features of every track, by the series that stand for it."""
    own = A.series_owners(s, d).join(A.raw_tracks(s, d).select("id", "native_bpm"), "id")
    arrays = E.prefix_arrays(A.frames(s, d)).withColumnRenamed("track_id", "owner")
    return E.features_of(own.join(arrays, "owner").select(F.col("id").alias("track_id"), F.col("native_bpm").alias("bpm"), "p"), H)


@made_once
def all_segments(s, d):
    """Segments of every track, as the segmentation finds them."""
    own = A.series_owners(s, d).select(F.col("id").alias("track_id"), "owner")
    return segments(s, d).withColumnRenamed("track_id", "owner").join(own, "owner").drop("owner")


@made_once
def markers(s, d):
    """Markers of the three best recommendations of every track."""
    return T.markers(curves(s, d))


@made_once
def slices(s, d):
    """Segments of every series, as the segmentation finds them."""
    return segments(s, d).select("track_id", "seg_idx", "label", "start_frame", "end_frame")


PREFIX = ", ".join(f"sum({c}) OVER w AS p_{c}" for c in E.SERIES)

# features

query("f02_frame_rms", lambda s, d: r(E.frame_rms(audio(s, d), 16, 4), "rms"), f"""
SELECT track_id, frame_idx, {R4('sqrt(list_sum(list_transform(x[frame_idx * 4 + 1:frame_idx * 4 + 16], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 16)', 6)} AS rms
FROM (SELECT CAST(vec_id AS VARCHAR) AS track_id, embedding AS x, CAST(unnest(range(0, 1 + (len(embedding) - 16) // 4)) AS INTEGER) AS frame_idx FROM embeddings)
""")
DFT = """
x AS (SELECT CAST(vec_id AS VARCHAR) AS track_id, embedding, CAST(unnest(range(0, 1 + (len(embedding) - 16) // 4)) AS INTEGER) AS frame_idx FROM embeddings),
k AS (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS k), b AS (SELECT CAST(unnest(range(0, 9)) AS INTEGER) AS bin),
spectrum AS (
    SELECT track_id, frame_idx, bin, bin * 4.0::DOUBLE AS freq,
        sqrt(pow(sum((0.5 - 0.5 * cos(2 * pi() * k / 16)) * CAST(embedding[frame_idx * 4 + k + 1] AS DOUBLE) * cos(2 * pi() * bin * k / 16)), 2) + pow(sum((0.5 - 0.5 * cos(2 * pi() * k / 16)) * CAST(embedding[frame_idx * 4 + k + 1] AS DOUBLE) * sin(2 * pi() * bin * k / 16)), 2)) / 8.0::DOUBLE AS mag
    FROM x, k, b GROUP BY ALL)
"""
query("f01_spectra", lambda s, d: r(spectrum(s, d).drop("freq"), "mag", digits=5), f"WITH {DFT} SELECT track_id, frame_idx, bin, {R4('mag', 5)} AS mag FROM spectrum")
query("f03_onset_strength", lambda s, d: r(E.frame_features(audio(s, d), 16, 4).select("track_id", "frame_idx", "flux"), "flux", digits=5), f"""
WITH {DFT} SELECT track_id, frame_idx, {R4('sum(rise)', 5)} AS flux FROM (SELECT track_id, frame_idx, coalesce(greatest(mag - lag(mag) OVER (PARTITION BY track_id, bin ORDER BY frame_idx), 0), 0) AS rise FROM spectrum) GROUP BY ALL
""")
query("f04_bass_ratio", lambda s, d: r(E.frame_features(audio(s, d), 16, 4, 4.0, 12.0).select("track_id", "frame_idx", "bass_ratio"), "bass_ratio", digits=5), f"""
WITH {DFT} SELECT track_id, frame_idx, {R4('sum(CASE WHEN freq BETWEEN 4 AND 12 THEN mag ELSE 0 END) / (sum(mag) + 1e-12)', 5)} AS bass_ratio FROM spectrum GROUP BY ALL
""")
query("f05_prefix_sums", lambda s, d: r(E.prefix_sums(A.frames(s, d)), "p_rms", "p_flux", "p_bass_ratio"), f"""
SELECT track_id, k, {R4('p_rms', 6)} AS p_rms, {R4('p_flux', 6)} AS p_flux, {R4('p_bass_ratio', 6)} AS p_bass_ratio FROM (
    SELECT track_id, frame_idx + 1 AS k, {PREFIX} FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)
    UNION ALL SELECT DISTINCT track_id, 0, 0, 0, 0 FROM frames)
""")
query("f06_window_mean", lambda s, d: r(wide(s, d).select("track_id", E.window_mean("p_rms", F.lit(3), F.lit(11)).alias("mean")), "mean"), f"SELECT track_id, {R4('avg(rms)', 6)} AS mean FROM frames WHERE frame_idx BETWEEN 3 AND 10 AND track_id IN (SELECT id FROM raw_tracks) GROUP BY track_id")
query("f07_autocorrelation", lambda s, d: r(E.autocorrelation(A.frames(s, d), 8), "ac"), f"""
SELECT track_id, lag, {R4('CASE WHEN z > 0 THEN s / z ELSE s END', 6)} AS ac FROM (
    SELECT a.track_id, CAST(l AS INTEGER) AS lag, sum(a.x * b.x) AS s, first_value(sum(a.x * b.x)) OVER (PARTITION BY a.track_id ORDER BY l) AS z
    FROM (SELECT track_id, frame_idx, flux - avg(flux) OVER (PARTITION BY track_id) AS x FROM frames) a, range(9) t(l)
    JOIN (SELECT track_id, frame_idx, flux - avg(flux) OVER (PARTITION BY track_id) AS x FROM frames) b ON b.track_id = a.track_id AND b.frame_idx = a.frame_idx + l GROUP BY a.track_id, l)
""")
query("f07_tempo", lambda s, d: r(E.estimate_tempo(A.frames(s, d), 0.02), "bpm", digits=3), f"""
WITH x AS (SELECT track_id, frame_idx, flux - avg(flux) OVER (PARTITION BY track_id) AS x, count(*) OVER (PARTITION BY track_id) AS n FROM frames),
sums AS (SELECT a.track_id, a.n, b.frame_idx - a.frame_idx AS l, sum(a.x * b.x) AS s FROM x a JOIN x b ON b.track_id = a.track_id AND b.frame_idx >= a.frame_idx GROUP BY ALL),
ac AS (SELECT track_id, n, list(CASE WHEN z > 0 THEN s / z ELSE s END ORDER BY l) AS ac FROM (SELECT *, first_value(s) OVER (PARTITION BY track_id ORDER BY l) AS z FROM sums) GROUP BY track_id, n),
peak AS (SELECT *, least(43, n - 1) AS top, list_position(ac[18:least(43, n - 1) + 1], list_max(ac[18:least(43, n - 1) + 1])) - 1 + 17 AS lag0 FROM ac),
tried AS (SELECT track_id, n, ac, i, c, 60.0::DOUBLE / (c * 0.02::DOUBLE) AS b FROM (SELECT *, lag0 * m AS c FROM peak, (VALUES (1, 0.5::DOUBLE), (2, 2.0::DOUBLE / 3.0::DOUBLE), (3, 1.0::DOUBLE), (4, 1.5::DOUBLE), (5, 2.0::DOUBLE), (6, 3.0::DOUBLE)) t(i, m))),
scored AS (
    SELECT track_id, i, c, ({' + '.join(f"CASE WHEN round_even(c * {k}, 0) < n THEN coalesce(ac[CAST(round_even(c * {k}, 0) AS INTEGER) + 1], 0) / {k} ELSE 0 END" for k in (1, 2, 3, 4))}) * (0.6 + 0.4 * exp(-0.5 * pow(log2(b / 115.0) / 0.6, 2))) AS s
    FROM tried WHERE b >= 69 AND b <= 181 AND c < n / 2.0::DOUBLE),
chosen AS (SELECT p.*, CAST(round_even(coalesce(c, lag0), 0) AS INTEGER) AS lag FROM peak p LEFT JOIN (SELECT track_id, arg_max(c, (s, -i)) AS c FROM scored GROUP BY track_id) USING (track_id))
SELECT track_id, {R4('CASE WHEN top <= 17 THEN 120.0 ELSE 60.0::DOUBLE / ((CASE WHEN lag >= 1 AND lag < n - 1 AND abs(ac[lag] - 2 * ac[lag + 1] + ac[lag + 2]) > 1e-12 THEN lag + 0.5::DOUBLE * (ac[lag] - ac[lag + 2]) / (ac[lag] - 2 * ac[lag + 1] + ac[lag + 2]) ELSE lag END) * 0.02::DOUBLE) END', 3)} AS bpm FROM chosen
""")
query("f08_beat_grid", lambda s, d: E.beat_grid(A.frames(s, d), A.raw_tracks(s, d).select(F.col("id").alias("track_id"), F.col("native_bpm").alias("bpm")), 0.02).select("track_id", X.round_up_half(F.col("offset"), 6).alias("offset"), F.size("beats").alias("n_beats")), f"""
SELECT track_id, {R4('p * phase / 24.0::DOUBLE', 6)} AS "offset", CAST(ceil((n - p * phase / 24.0::DOUBLE) / p) AS INTEGER) AS n_beats FROM (
    SELECT track_id, p, n, arg_max(phase, (s, -phase)) AS phase FROM (
        SELECT c.track_id, p, n, phase, sum(flux) AS s FROM (
            SELECT track_id, p, n, phase, CAST(floor(p * phase / 24.0::DOUBLE + k * p) AS INTEGER) AS f FROM (
                SELECT *, unnest(range(0, greatest(1, CAST(ceil((n - p * phase / 24.0::DOUBLE) / p) AS INTEGER)))) AS k FROM (
                    SELECT track_id, 60.0::DOUBLE / native_bpm / 0.02::DOUBLE AS p, n, unnest(range(0, 24)) AS phase FROM (SELECT track_id, count(*) AS n FROM frames GROUP BY track_id) JOIN raw_tracks ON id = track_id))) c
        JOIN frames x ON x.track_id = c.track_id AND x.frame_idx = c.f GROUP BY ALL) GROUP BY ALL)
""")
CHROMA = f"""
WITH {DFT}, folded AS (SELECT track_id, CAST(round_even(69 + 12 * log2(freq * 40 / 440.0::DOUBLE), 0) AS INTEGER) % 12 AS pc, sum(mag) AS m FROM spectrum WHERE freq * 40 > 80 AND freq * 40 < 2500 GROUP BY ALL),
twelve AS (SELECT t.track_id, CAST(p AS INTEGER) AS pc, ln(1 + coalesce(m, 0)) AS e FROM (SELECT DISTINCT track_id FROM folded) t CROSS JOIN range(12) x(p) LEFT JOIN folded f ON f.track_id = t.track_id AND f.pc = p),
chroma AS (SELECT track_id, pc, {R4('CASE WHEN sum(e) OVER w > 0 THEN e / sum(e) OVER w ELSE 0 END', 5)} AS energy FROM twelve WINDOW w AS (PARTITION BY track_id))
"""
_profiles = ", ".join(f"({s}, '{m}', {(k + s) % 12}, {p[k]}, '{t}', '{c[s]}')" for s, t in enumerate(D.TONICS) for m, p, c in (("major", D.MAJOR, D.CAMELOT_MAJOR), ("minor", D.MINOR, D.CAMELOT_MINOR)) for k in range(12))
query("f09_chroma", lambda s, d: r(pitch_classes(s, d).select("track_id", F.posexplode(E.chroma_of("pitch")).alias("pc", "energy")), "energy", digits=5), CHROMA + "SELECT * FROM chroma")
query("f09_key", lambda s, d: pitch_classes(s, d).withColumn("e", F.transform(E.chroma_of("pitch"), lambda x: X.round_up_half(x, 5))).select("track_id", E.key_of("e").alias("k")).select("track_id", "k.*"), CHROMA + f"""
SELECT track_id, tonic, mode, camelot, {R4('r')} AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY r DESC, shift, mode) AS n FROM (
        SELECT track_id, shift, mode, tonic, camelot, {R4('coalesce(corr(energy, weight), -2.0)', 9)} AS r FROM chroma JOIN (VALUES {_profiles}) p(shift, mode, pc, weight, tonic, camelot) USING (pc) GROUP BY ALL)) WHERE n = 1
""")
query("f10_normalize_tonic", lambda s, d: E.normalize_tonic(_tonics(s, d))[0], f"""
SELECT id, coalesce(m.sharp, t) AS tonic, mode, CASE mode WHEN 'major' THEN ({D.CAMELOT_MAJOR})[list_position({D.TONICS}, coalesce(m.sharp, t))] ELSE ({D.CAMELOT_MINOR})[list_position({D.TONICS}, coalesce(m.sharp, t))] END AS camelot
FROM (SELECT id, (['Db', 'C', 'Eb', 'F#', 'H', 'Bb', 'A'])[CAST(id AS BIGINT) % 7 + 1] AS t, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'major' ELSE 'minor' END AS mode FROM raw_tracks)
LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in D.FLATS.items())}) m(flat, sharp) ON flat = t WHERE t <> 'H'
""")
query("f11_rescale", lambda s, d: E.rescale(wide(s, d), F.lit(1.05)).select("track_id", "bpm", "duration_s", "hop_dur", F.size("beat_grid").alias("n"), F.element_at("beat_grid", 2).alias("beat")), f"""
SELECT track_id, {R4('native_bpm * 1.05::DOUBLE', 2)} AS bpm, n * 0.25::DOUBLE / 1.05::DOUBLE AS duration_s, 0.25::DOUBLE / 1.05::DOUBLE AS hop_dur, CAST(ceil(n * 0.25::DOUBLE * native_bpm / 60.0::DOUBLE) AS INTEGER) AS n, {R4('60.0::DOUBLE / native_bpm / 1.05::DOUBLE', 5)} AS beat
FROM (SELECT track_id, count(*) AS n FROM frames GROUP BY track_id) JOIN raw_tracks ON id = track_id
""")
query("f12_envelope", lambda s, d: E.envelope(wide(s, d), 24).select("track_id", "points", F.posexplode("env").alias("k", "v")).withColumn("v", X.round_up_half(F.col("v"), 3)), f"""
SELECT track_id, 24 AS points, k, {R4(R4('rms / CASE WHEN top = 0 THEN 1 ELSE top END'), 3)} AS v FROM (
    SELECT c.track_id, CAST(k AS INTEGER) AS k, rms, max(rms) OVER (PARTITION BY c.track_id) AS top FROM (
        SELECT track_id, k, CASE WHEN k = 23 THEN n - 1 ELSE CAST(floor(k * ((n - 1.0::DOUBLE) / 23.0::DOUBLE)) AS INTEGER) END AS i FROM (SELECT track_id, count(*) AS n FROM frames WHERE track_id IN (SELECT id FROM raw_tracks) GROUP BY track_id), range(24) t(k)) c
    JOIN frames f ON f.track_id = c.track_id AND f.frame_idx = c.i)
""")
query("f13_native_envelopes", lambda s, d: E.native_envelopes(wide(s, d), _deck(s, d)).groupBy("points").agg(F.count("*").alias("n"), F.sum(F.size("env")).alias("values")), "SELECT CAST(p AS INTEGER) AS points, count(*) AS n, CAST(sum(p) AS BIGINT) AS \"values\" FROM (SELECT DISTINCT track_id FROM frames), (VALUES (120), (480)) t(p) WHERE track_id IN (SELECT id FROM tracks WHERE mixable AND status = 'ready') GROUP BY p")
query("f14_analysis_audit", lambda s, d: E.analysis_audit(wide(s, d), segments(s, d)), """
SELECT l.track_id, coalesce(k >= 2, false) AS beats_fit_tempo, k > 10 AS enough_beats, contiguous, first_label IN ('intro', 'full') AS starts_with_intro, last_label IN ('outro', 'full', 'intro') AS ends_with_outro
FROM (SELECT track_id, CAST(ceil(n * 0.25::DOUBLE * native_bpm / 60.0::DOUBLE) AS INTEGER) AS k FROM lengths JOIN raw_tracks ON id = track_id) l
LEFT JOIN (SELECT track_id, bool_and(start_frame = p) AS contiguous, arg_min(label, seg_idx) AS first_label, arg_max(label, seg_idx) AS last_label FROM (SELECT *, coalesce(lag(end_frame) OVER (PARTITION BY track_id ORDER BY seg_idx), 0) AS p FROM segs) GROUP BY track_id) s ON s.track_id = l.track_id
""")


def _deck(s, d):
    from ..operators.catalog import usable

    return A.tracks(s, d).filter(usable()).select("id")


def _tonics(s, d):
    k = F.col("id").cast("long")
    return A.raw_tracks(s, d).select("id", F.element_at(F.array(*map(F.lit, ["Db", "C", "Eb", "F#", "H", "Bb", "A"])), (k % 7 + 1).cast("int")).alias("tonic"), F.when(k % 2 == 0, "major").otherwise("minor").alias("mode"))


# whole analyses

ANALYSIS = f"""
sig AS (SELECT CAST(g AS VARCHAR) AS track_id, ({RATES})[g % 3 + 1] AS sr, x FROM (SELECT vec_id // 64 AS g, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY g)),
cut AS (SELECT track_id, sr, x[f * 32 + 1:f * 32 + 64] AS x, CAST(f AS INTEGER) AS frame_idx FROM (SELECT *, unnest(range(0, 1 + (len(x) - 64) // 32)) AS f FROM sig WHERE len(x) >= 64)),
heard AS (SELECT track_id, sr, frame_idx, k, (0.5 - 0.5 * cos(2 * pi() * (k - 1) / 64)) * CAST(x[k] AS DOUBLE) AS v FROM (SELECT *, CAST(unnest(range(1, 65)) AS INTEGER) AS k FROM cut)),
spec AS (
    SELECT track_id, sr, frame_idx, CAST(b AS INTEGER) AS bin, sqrt(pow(sum(v * cos(2 * pi() * b * (k - 1) / 64)), 2) + pow(sum(v * sin(2 * pi() * b * (k - 1) / 64)), 2)) / 32.0::DOUBLE AS mag
    FROM heard, range(33) t(b) GROUP BY ALL),
onset AS (
    SELECT track_id, 32.0::DOUBLE / sr AS hop, frame_idx, sum(rise) AS flux
    FROM (SELECT *, coalesce(greatest(mag - lag(mag) OVER (PARTITION BY track_id, bin ORDER BY frame_idx), 0), 0) AS rise FROM spec) GROUP BY ALL),
free AS (SELECT *, flux - avg(flux) OVER (PARTITION BY track_id) AS x, count(*) OVER (PARTITION BY track_id) AS n FROM onset),
products AS (SELECT a.track_id, a.hop, a.n, b.frame_idx - a.frame_idx AS l, sum(a.x * b.x) AS s FROM free a JOIN free b ON b.track_id = a.track_id AND b.frame_idx >= a.frame_idx GROUP BY ALL),
acs AS (SELECT track_id, hop, n, list(CASE WHEN z > 0 THEN s / z ELSE s END ORDER BY l) AS ac FROM (SELECT *, first_value(s) OVER (PARTITION BY track_id ORDER BY l) AS z FROM products) GROUP BY ALL),
ranged AS (SELECT *, greatest(1, CAST(round_even(60.0::DOUBLE / 180 / hop, 0) AS INTEGER)) AS lo, least(CAST(round_even(60.0::DOUBLE / 70 / hop, 0) AS INTEGER), n - 1) AS top FROM acs),
peak AS (SELECT *, list_position(ac[lo + 1:top + 1], list_max(ac[lo + 1:top + 1])) - 1 + lo AS lag0 FROM ranged),
tried AS (SELECT *, 60.0::DOUBLE / (c * hop) AS b FROM (SELECT *, lag0 * m AS c FROM peak, (VALUES (1, 0.5::DOUBLE), (2, 2.0::DOUBLE / 3.0::DOUBLE), (3, 1.0::DOUBLE), (4, 1.5::DOUBLE), (5, 2.0::DOUBLE), (6, 3.0::DOUBLE)) t(i, m))),
scored AS (
    SELECT track_id, i, c, ({' + '.join(f"CASE WHEN round_even(c * {k}, 0) < n THEN coalesce(ac[CAST(round_even(c * {k}, 0) AS INTEGER) + 1], 0) / {k} ELSE 0 END" for k in (1, 2, 3, 4))}) * (0.6 + 0.4 * exp(-0.5 * pow(log2(b / 115.0) / 0.6, 2))) AS s
    FROM tried WHERE b >= 69 AND b <= 181 AND c < n / 2.0::DOUBLE),
chosen AS (SELECT p.*, CAST(round_even(coalesce(c, lag0), 0) AS INTEGER) AS lag FROM peak p LEFT JOIN (SELECT track_id, arg_max(c, (s, -i)) AS c FROM scored GROUP BY track_id) USING (track_id)),
timed AS (
    SELECT track_id, hop, n, 60.0::DOUBLE / bpm / hop AS p, bpm FROM (
        SELECT *, CASE WHEN top <= lo THEN 120.0 ELSE 60.0::DOUBLE / ((CASE WHEN lag >= 1 AND lag < n - 1 AND abs(ac[lag] - 2 * ac[lag + 1] + ac[lag + 2]) > 1e-12 THEN lag + 0.5::DOUBLE * (ac[lag] - ac[lag + 2]) / (ac[lag] - 2 * ac[lag + 1] + ac[lag + 2]) ELSE lag END) * hop) END AS bpm FROM chosen)),
combs AS (SELECT track_id, phase, CAST(floor(p * phase / 24.0::DOUBLE + k * p) AS INTEGER) AS frame_idx FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((n - p * phase / 24.0::DOUBLE) / p) AS INTEGER)))) AS k FROM (SELECT *, unnest(range(0, 24)) AS phase FROM timed))),
phased AS (SELECT track_id, arg_max(phase, (s, -phase)) AS phase FROM (SELECT track_id, phase, sum(flux) AS s FROM combs JOIN onset USING (track_id, frame_idx) GROUP BY ALL) GROUP BY track_id),
folded AS (SELECT track_id, CAST(round_even(69 + 12 * log2(bin * sr / 64.0::DOUBLE / 440.0::DOUBLE), 0) AS INTEGER) % 12 AS pc, sum(mag) AS m FROM spec WHERE bin * sr / 64.0::DOUBLE > 80 AND bin * sr / 64.0::DOUBLE < 2500 GROUP BY ALL),
twelve AS (SELECT t.track_id, CAST(q AS INTEGER) AS pc, ln(1 + coalesce(m, 0)) AS energy FROM timed t CROSS JOIN range(12) x(q) LEFT JOIN folded f ON f.track_id = t.track_id AND f.pc = q),
keyed AS (
    SELECT track_id, tonic, mode, camelot, {R4('r')} AS confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY r DESC, shift, mode) AS k FROM (
            SELECT track_id, shift, mode, tonic, camelot, {R4('coalesce(corr(energy, weight), -2.0)', 9)} AS r FROM twelve JOIN (VALUES {_profiles}) p(shift, mode, pc, weight, tonic, camelot) USING (pc) GROUP BY ALL)) WHERE k = 1),
analysed AS (
    SELECT track_id, sr, CAST(n AS INTEGER) AS n, len(x) / CAST(sr AS DOUBLE) AS duration_s, {R4('bpm', 2)} AS bpm, CAST(greatest(1, ceil((n - p * phase / 24.0::DOUBLE) / p)) AS INTEGER) AS n_beats, {R4('p * phase / 24.0::DOUBLE * hop', 5)} AS first_beat, tonic, mode, camelot, confidence
    FROM sig JOIN timed USING (track_id) JOIN phased USING (track_id) JOIN keyed USING (track_id))
"""
query("i12_analyse", lambda s, d: E.analyse(E.track_series(signals(s, d), 64, 32)).select("track_id", "sr", "n", "duration_s", "bpm", F.size("beat_grid").alias("n_beats"), F.element_at("beat_grid", 1).alias("first_beat"), "tonic", "mode", "camelot", "confidence"), f"WITH {ANALYSIS} SELECT * FROM analysed")
query("i12_publish", lambda s, d: _published(s, d), f"""
WITH {ANALYSIS}, ready AS (SELECT t.id, t.license, coalesce(own.band, derived.band, '') AS genre, a.bpm AS native_bpm, a.camelot, a.duration_s FROM tracks t JOIN analysed a ON a.track_id = t.id LEFT JOIN bands own ON own.band = t.genre LEFT JOIN bands derived ON a.bpm >= derived.lo - 0.5 AND a.bpm < derived.hi + 0.5 WHERE t.mixable)
SELECT id, license, genre, native_bpm, camelot, duration_s, 'ready' AS status, (SELECT count(*) FROM points g WHERE g.band = r.genre AND abs(g.g / r.native_bpm - 1) <= {D.MOST_STRETCH}) AS n_variants FROM ready r
""")


def _published(s, d):
    """The tables that one batch run makes of all tracks and the signals there are."""
    from ..operators import ingest, merge

    path = f"{shared_dir(s)}/publish-{uuid.uuid4().hex}"
    seed = A.raw_tracks(s, d).select("id", "name", "artist", "genre", "license")
    ingest.publish(s, seed, signals(s, d).withColumn("error", F.lit(None).cast("string")), path, frame=64, hop=32)
    tracks, variants = merge.read_published(s, f"{path}/catalog")
    n = variants.groupBy(F.col("track_id").alias("id")).agg(F.count("*").alias("n_variants"))
    return tracks.join(n, "id", "left").select("id", "license", "genre", "native_bpm", "camelot", "duration_s", "status", F.coalesce("n_variants", F.lit(0)).cast("long").alias("n_variants"))


# segmentation

query("n01_moving_average", lambda s, d: r(A.frames(s, d).select("track_id", "frame_idx", N.moving_average("rms", 5).alias("mean")), "mean"), f"SELECT track_id, frame_idx, {R4('sum(rms) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5', 6)} AS mean FROM frames")
query("n02_blended_feature", lambda s, d: r(N.blended_feature(A.frames(s, d), 2).select("track_id", "frame_idx", "feature"), "feature"), f"SELECT track_id, frame_idx, {R4('feature', 6)} AS feature FROM blended")
query("n03_novelty", lambda s, d: r(N.novelty(N.blended_feature(A.frames(s, d), 2), 2).select("track_id", "frame_idx", "novelty"), "novelty"), f"SELECT track_id, frame_idx, {R4('novelty', 6)} AS novelty FROM novel")
query("n04_local_maxima", lambda s, d: N.peaks_of(A.frames(s, d), H).select("track_id", "frame_idx"), "SELECT track_id, frame_idx FROM peaks")
query("n05_suppress_close", lambda s, d: N.suppress_close(N.peaks_of(A.frames(s, d), H), 12).select("track_id", "frame_idx"), "SELECT track_id, unnest(arg_max(kept, k)) AS frame_idx FROM walk GROUP BY track_id", True)
query("n06_strongest_peaks", lambda s, d: N.strongest_peaks(N.peaks_of(A.frames(s, d), H), 7).select("track_id", "frame_idx"), "SELECT track_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY height DESC, frame_idx DESC) AS k FROM peaks) WHERE k <= 7")
query("n07_boundaries", lambda s, d: N.boundaries_to_segments(N.peaks_of(A.frames(s, d), H), A.frames(s, d).groupBy("track_id").agg(F.count("*").alias("n_frames"))), """
SELECT track_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg_idx, b AS start_frame, e AS end_frame FROM (
    SELECT track_id, b, lead(b) OVER (PARTITION BY track_id ORDER BY b) AS e FROM (
        SELECT track_id, 0 AS b FROM frames UNION SELECT track_id, CAST(count(*) AS INTEGER) FROM frames GROUP BY track_id
        UNION SELECT p.track_id, p.frame_idx FROM peaks p JOIN (SELECT track_id, count(*) AS n FROM frames GROUP BY track_id) c USING (track_id) WHERE p.frame_idx > 0 AND p.frame_idx < n - 1)
) WHERE e IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY b)
""")


def one_series(s, d):
    """All events, in their order, as one long series."""
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.lit("all").alias("track_id"), F.col("event_id").cast("int").alias("frame_idx"), F.floor(F.col("value")).alias("rms"), F.floor(F.pmod("value", F.lit(7.0))).alias("flux"), F.lit(0.5).alias("bass_ratio"))


#: The segmentation's steps over that series; whole numbers, so that runs of equal novelty occur.
ONE = """
WITH one AS (SELECT 'all' AS track_id, CAST(event_id AS INTEGER) AS frame_idx, floor(value) AS rms, floor(value - 7 * floor(value / 7)) AS flux FROM events),
blend AS (SELECT *, sum(rms / (m + 1e-12)) OVER w / 2 + 0.5 * (sum(flux / (g + 1e-12)) OVER w / 2) AS feature FROM (SELECT *, max(rms) OVER () AS m, max(flux) OVER () AS g FROM one) WINDOW w AS (ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
slope AS (SELECT *, abs(CASE WHEN lag(feature) OVER w IS NULL THEN lead(feature) OVER w - feature WHEN lead(feature) OVER w IS NULL THEN feature - lag(feature) OVER w ELSE (lead(feature) OVER w - lag(feature) OVER w) / 2 END) AS slope FROM blend WINDOW w AS (ORDER BY frame_idx)),
found AS (SELECT *, floor(sum(slope) OVER (ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 * 1e9 + 0.5) / 1e9 AS novelty FROM slope),
flagged AS (SELECT *, sum(c) OVER (ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(CAST(novelty <> lag(novelty) OVER (ORDER BY frame_idx) AS INTEGER), 0) AS c FROM found)),
level AS (SELECT run, min(frame_idx) AS a, max(frame_idx) AS b, any_value(novelty) AS height FROM flagged GROUP BY run)
"""
query("f05_long_prefix_sums", lambda s, d: E.prefix_sums(one_series(s, d), ("rms", "flux"), block=700), ONE + "SELECT track_id, frame_idx + 1 AS k, sum(rms) OVER w AS p_rms, sum(flux) OVER w AS p_flux FROM one WINDOW w AS (ORDER BY frame_idx) UNION ALL SELECT 'all', 0, 0, 0")
query("f06_long_window_means", lambda s, d: r(E.window_means(one_series(s, d).select("track_id", F.col("frame_idx").alias("start"), (F.col("frame_idx") + F.pmod("frame_idx", F.lit(90))).alias("stop")), one_series(s, d), block=700), "mean"), ONE + f"""
SELECT track_id, frame_idx AS start, frame_idx + frame_idx % 90 AS stop, CASE WHEN greatest(frame_idx + frame_idx % 90, frame_idx + 1) <= n THEN {R4('(coalesce(list_sum(a[frame_idx + 1:greatest(frame_idx + frame_idx % 90, frame_idx + 1)]), 0)) / greatest(frame_idx % 90, 1)', 6)} END AS mean
FROM one, (SELECT list(rms ORDER BY frame_idx) AS a, count(*) AS n FROM one)
""")
query("n03_long_novelty", lambda s, d: r(N.novelty(N.blended_feature(one_series(s, d), 2, block=700), 2, block=700).select("track_id", "frame_idx", "novelty"), "novelty"), ONE + f"SELECT track_id, frame_idx, {R4('novelty', 6)} AS novelty FROM found")
query("n04_long_maxima", lambda s, d: N.peaks_of(one_series(s, d), H, block=700).select("track_id", "frame_idx"), ONE + "SELECT 'all' AS track_id, CAST((a + b) // 2 AS INTEGER) AS frame_idx FROM (SELECT *, lag(height) OVER (ORDER BY run) AS p, lead(height) OVER (ORDER BY run) AS q FROM level) WHERE p < height AND q < height")
SLICES = "SELECT track_id, seg_idx, label, start_frame, end_frame FROM segs"
ENERGY = f"SELECT s.track_id, seg_idx, label, start_frame, end_frame, {R4('avg(rms)', 9)} AS energy FROM ({SLICES}) s JOIN frames f ON f.track_id = s.track_id AND f.frame_idx >= start_frame AND f.frame_idx < end_frame GROUP BY ALL"
query("n08_segment_energy", lambda s, d: r(N.segment_energy(slices(s, d).drop("label"), A.frames(s, d)), "energy", "lo", "hi"), f"""
SELECT track_id, seg_idx, start_frame, end_frame, {R4('energy', 6)} AS energy, {R4('quantile_cont(energy, 0.33) OVER (PARTITION BY track_id)', 6)} AS lo, {R4('quantile_cont(energy, 0.66) OVER (PARTITION BY track_id)', 6)} AS hi FROM ({ENERGY})
""")
query("n09_label_segments", lambda s, d: N.label_segments(N.segment_energy(slices(s, d).drop("label"), A.frames(s, d)), H).select("track_id", "seg_idx", "label", "start_frame", "end_frame", "start_s", "end_s"), f"""
SELECT track_id, seg_idx, CASE WHEN max(end_frame) OVER p < 16 THEN 'full' WHEN seg_idx = 0 THEN 'intro' WHEN seg_idx = count(*) OVER p - 1 THEN 'outro' WHEN energy <= quantile_cont(energy, 0.33) OVER p THEN 'breakdown' WHEN energy >= quantile_cont(energy, 0.66) OVER p THEN 'drop' ELSE 'verse' END AS label,
    start_frame, end_frame, start_frame * 0.25::DOUBLE AS start_s, end_frame * 0.25::DOUBLE AS end_s FROM ({ENERGY}) WINDOW p AS (PARTITION BY track_id)
""")
query("n10_role_weights", lambda s, d: slices(s, d).select("track_id", "seg_idx", X.role_weight("label", "exit").alias("leave"), X.role_weight("label", "entry").alias("enter")), f"SELECT track_id, seg_idx, CAST(x.w AS DOUBLE) AS leave, CAST(e.w AS DOUBLE) AS enter FROM ({SLICES}) s JOIN exits x USING (label) JOIN entries_roles e USING (label)")
query("n00_segments", segments, f"""
SELECT track_id, seg_idx, CASE WHEN max(end_frame) OVER p < 16 THEN 'full' WHEN seg_idx = 0 THEN 'intro' WHEN seg_idx = count(*) OVER p - 1 THEN 'outro' WHEN e <= quantile_cont(e, 0.33) OVER p THEN 'breakdown' WHEN e >= quantile_cont(e, 0.66) OVER p THEN 'drop' ELSE 'verse' END AS label,
    start_frame, end_frame, start_frame * 0.25::DOUBLE AS start_s, end_frame * 0.25::DOUBLE AS end_s, {R4('e', 6)} AS energy
FROM (SELECT c.track_id, seg_idx, start_frame, end_frame, {R4('avg(rms)', 9)} AS e FROM cuts c JOIN frames f ON f.track_id = c.track_id AND f.frame_idx >= start_frame AND f.frame_idx < end_frame GROUP BY ALL) WINDOW p AS (PARTITION BY track_id)
""", True)

query("q06_track_segments", lambda s, d: _segments_of(s, d), f"SELECT * FROM ({SLICES}) WHERE track_id = '5'")
query("q06_track_analysis", lambda s, d: _analysis_of(s, d), "SELECT '5' AS track_id, native_bpm AS bpm, n AS n_frames, n * 0.25::DOUBLE AS duration_s FROM lengths JOIN raw_tracks ON id = track_id WHERE track_id = '5'")
query("q13_track_detail", lambda s, d: _detail(s, d), f"""
SELECT t.id, name, status, coalesce(k, 0) AS n_segments, coalesce(CAST(ceil(n * 0.25::DOUBLE * native_bpm / 60.0::DOUBLE) AS INTEGER), 0) AS n_beats
FROM tracks t LEFT JOIN (SELECT track_id, CAST(count(*) AS INTEGER) AS k FROM ({SLICES}) GROUP BY track_id) s ON s.track_id = t.id LEFT JOIN lengths l ON l.track_id = t.id
""")


def _segments_of(s, d):
    from ..operators.catalog import track_segments

    return track_segments(slices(s, d), "5")


def _analysis_of(s, d):
    from ..operators.catalog import track_analysis

    return track_analysis(wide(s, d), "5").select("track_id", "bpm", "n_frames", "duration_s")


def _detail(s, d):
    from ..operators.catalog import track_detail

    return track_detail(A.tracks(s, d), wide(s, d), slices(s, d)).select("id", "name", "status", F.size("segments").alias("n_segments"), F.size("beat_grid").alias("n_beats"))


# matching


@made_once
def ordered(s, d):
    """Nodes of the saved mixes in order; the queries of chains start from them."""
    return C.order_chains(A.mixes(s, d), A.mix_tracks(s, d))[0]


@made_once
def scalars(s, d):
    """One narrow row per mixable track."""
    energies = R.track_energies(segments(s, d), A.frames(s, d)).withColumnRenamed("track_id", "owner")
    own = A.series_owners(s, d).join(energies, "owner").select(F.col("id").alias("track_id"), "intro_rms", "outro_rms")
    return R.track_scalars(A.tracks(s, d), A.variants(s, d), own)


@made_once
def recommended(s, d):
    """The ranked matches of every track; shorter lists are their beginnings."""
    return R.recommend(scalars(s, d))


SCALARS = """
SELECT t.id, b.band, t.native_bpm AS bpm, t.camelot, g.grid, e.intro_rms, e.outro_rms
FROM tracks t JOIN banded b USING (id) JOIN grids g USING (id) JOIN owned o ON o.track_id = t.id
JOIN (SELECT track_id, arg_min(energy, seg_idx) AS intro_rms, arg_max(energy, seg_idx) AS outro_rms FROM segs GROUP BY track_id) e ON e.track_id = o.owner WHERE t.mixable
"""
SEGMENTS = "SELECT o.track_id, seg_idx, label, start_frame, end_frame FROM segs g JOIN owned o ON o.owner = g.track_id"
CAMELOT = """
CASE WHEN right({a}, 1) = right({b}, 1) THEN CASE {d} WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.4 ELSE greatest(0.0, 0.25 - 0.05 * ({d} - 3)) END ELSE CASE {d} WHEN 0 THEN 0.8 WHEN 1 THEN 0.35 ELSE 0.1 END END::DOUBLE
"""
DIST = "least(abs(CAST(left({a}, -1) AS INTEGER) - CAST(left({b}, -1) AS INTEGER)), 12 - abs(CAST(left({a}, -1) AS INTEGER) - CAST(left({b}, -1) AS INTEGER)))"
KEY = CAMELOT.format(a="a.camelot", b="b.camelot", d="(" + DIST.format(a="a.camelot", b="b.camelot") + ")")
PAIRS = f"""
SELECT a.id AS a_id, b.id AS b_id, list_sort(list_intersect(a.grid, b.grid)) AS shared_grid, {KEY} AS k,
    1.0 - least(1.0, abs(a.outro_rms - b.intro_rms) / greatest(a.outro_rms, b.intro_rms, 1e-9)) AS e,
    list_max(list_transform(list_intersect(a.grid, b.grid), lambda g: struct_pack(s := 1.0::DOUBLE - 0.35::DOUBLE * (0.5::DOUBLE * (least(1.0::DOUBLE, abs(g / a.bpm - 1) / 0.10::DOUBLE) + least(1.0::DOUBLE, abs(g / b.bpm - 1) / 0.10::DOUBLE))), g := -g))) AS m
FROM ({SCALARS}) a JOIN ({SCALARS}) b ON a.band = b.band AND a.id <> b.id AND list_has_any(a.grid, b.grid)
"""
MATCHED = f"SELECT a_id, b_id, {R4('0.45::DOUBLE * m.s + 0.35::DOUBLE * k + 0.20::DOUBLE * e')} AS score, {R4('m.s')} AS bpm, {R4('k')} AS key, {R4('e')} AS energy, shared_grid, CAST(-m.g AS INTEGER) AS best_grid_bpm FROM ({PAIRS})"
RECOMMEND = f"SELECT *, CAST(row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS INTEGER) AS rank FROM ({MATCHED}) WHERE score >= 0.40"

query("r01_camelot", lambda s, d: _keys(s, d).select("a", "b", X.round_up_half(X.camelot_score("a", "b"), 4).alias("score")), f"""
SELECT a, b, {R4(CAMELOT.format(a='a', b='b', d='(' + DIST.format(a='a', b='b') + ')'))} AS score FROM (SELECT DISTINCT x.camelot AS a, y.camelot AS b FROM (SELECT DISTINCT camelot FROM raw_tracks) x, (SELECT DISTINCT camelot FROM raw_tracks) y)
""")
query("r02_bpm_score", lambda s, d: r(R.tempo_scores(every_pair(s, d)), "score"), f"SELECT a_id, b_id, CAST(-m.g AS INTEGER) AS grid, {R4('m.s', 6)} AS score FROM ({PAIRS})")
query("r03_energy_continuity", lambda s, d: every_pair(s, d).select("a_id", "b_id", X.round_up_half(X.energy_continuity("a_outro_rms", "b_intro_rms"), 6).alias("energy")), f"SELECT a_id, b_id, {R4('e', 6)} AS energy FROM ({PAIRS})")
query("r04_match_pairs", lambda s, d: R.match_pairs(every_pair(s, d)), MATCHED, lists=("shared_grid",))
query("recommend_all", recommended, f"SELECT * FROM ({RECOMMEND}) WHERE rank <= 20", lists=("shared_grid",))
query("r05_recommend_some", lambda s, d: R.recommend(scalars(s, d), A.raw_tracks(s, d).filter("id IN ('4', '16', '40')").select("id"), 0), f"SELECT * FROM ({RECOMMEND}) WHERE a_id IN ('4', '16', '40')", lists=("shared_grid",))
query("r06_recommend_enriched", lambda s, d: _enriched(s, d), f"SELECT x.a_id, x.b_id, x.rank, t.name, t.artist, '“' || t.name || '” by ' || t.artist || ' — ' || t.license AS attribution, CASE WHEN t.id IS NULL THEN 120 ELSE 120 END AS n_points FROM ({RECOMMEND}) x LEFT JOIN (SELECT * FROM tracks WHERE status = 'ready') t ON t.id = x.b_id WHERE rank <= 5")
query("r07_compatible_counts", lambda s, d: R.compatible_counts(A.tracks(s, d), A.variants(s, d)), "SELECT a.band, a.id, count(*) AS partners FROM banded a JOIN grids g ON g.id = a.id JOIN banded b ON b.band = a.band AND b.id <> a.id JOIN grids h ON h.id = b.id AND list_has_any(g.grid, h.grid) WHERE a.mixable AND b.mixable GROUP BY ALL")
query("r08_scale_scores", lambda s, d: R.scale_scores(recommended(s, d), ["a_id"]).select("a_id", "b_id", "percent", "scaled"), f"""
SELECT a_id, b_id, CAST(floor(score * 100 + 0.5) AS INTEGER) AS percent, {R4('CASE WHEN n < 2 THEN 10.0 + 16.0 * score WHEN hi - lo < 1e-9 THEN 18.0 ELSE 10.0 + 16.0 * ((score - lo) / (hi - lo)) END', 6)} AS scaled
FROM (SELECT a_id, b_id, score, count(*) OVER p AS n, min(score) OVER p AS lo, max(score) OVER p AS hi FROM ({RECOMMEND}) WHERE rank <= 20 WINDOW p AS (PARTITION BY a_id))
""")


def every_pair(s, d):
    """All ordered pairs of tracks that share a tempo."""
    return R.candidate_pairs(scalars(s, d))


def _keys(s, d):
    k = A.raw_tracks(s, d).select("camelot").distinct()
    return k.withColumnRenamed("camelot", "a").join(F.broadcast(k.withColumnRenamed("camelot", "b")))  # 24 x 24 keys


def _enriched(s, d):
    from ..operators.catalog import catalog_listing

    recs = recommended(s, d).filter("rank <= 5")
    out = R.recommend_enriched(recs, catalog_listing(A.tracks(s, d), A.variants(s, d)), E.envelope(all_wide(s, d), 120))
    return out.select("a_id", "b_id", "rank", "name", "artist", "attribution", F.size("env").alias("n_points"))


# transitions

FEATURES = """
SELECT f.track_id, native_bpm AS bpm, 0.25::DOUBLE AS hop, n, [k * 60.0::DOUBLE / native_bpm FOR k IN range(0, CAST(ceil(n * 0.25::DOUBLE * native_bpm / 60.0::DOUBLE) AS INTEGER))] AS beats
FROM (SELECT track_id, CAST(count(*) AS INTEGER) AS n FROM frames GROUP BY track_id) f JOIN raw_tracks t ON t.id = f.track_id
"""


def native(s, d):
    """Features of every track at its own tempo."""
    return T.at_tempo(all_wide(s, d), all_wide(s, d).select("track_id", F.lit(None).cast("int").alias("tempo")))


NATIVE = "SELECT track_id, CAST(NULL AS INTEGER) AS tempo FROM owned"


ALL_FEATURES = """
SELECT o.track_id, native_bpm AS bpm, 0.25::DOUBLE AS hop, n, [k * 60.0::DOUBLE / native_bpm FOR k IN range(0, CAST(ceil(n * 0.25::DOUBLE * native_bpm / 60.0::DOUBLE) AS INTEGER))] AS beats
FROM owned o JOIN lengths f ON f.track_id = o.owner JOIN raw_tracks t ON t.id = o.track_id
"""


def side_sql(name: str, side: str, wanted: str, features: str = FEATURES, segments: str = SLICES, owner: str = "SELECT DISTINCT track_id, track_id AS owner FROM frames") -> str:
    """CTEs ``{name}_starts`` and ``{name}_sides``: the windows of one side for tracks at the tempos of ``wanted (track_id, tempo)``; a null tempo is the native one."""
    roles = "exits" if side == "exit" else "entries_roles"
    place = "start / greatest(1, n)" if side == "exit" else "1.0 - start / greatest(1, n)"
    return f"""
{name}_f AS (
    SELECT w.track_id, w.tempo, n, floor(bpm * q * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS bpm, 0.25::DOUBLE / q AS hop, [floor(b / q * 100000.0::DOUBLE + 0.5) / 100000.0::DOUBLE FOR b, i IN beats IF (i - 1) % 4 = 0] AS bars
    FROM (SELECT x.track_id, tempo, n, bpm, beats, coalesce(tempo / bpm, 1.0::DOUBLE) AS q FROM ({features}) x JOIN (SELECT DISTINCT * FROM ({wanted})) v ON v.track_id = x.track_id) w),
{name}_w AS (SELECT *, CAST(floor(32 * (60.0::DOUBLE / bpm / hop)) AS INTEGER) AS win FROM {name}_f),
{name}_starts AS (
    SELECT DISTINCT track_id, tempo, CAST(round_even(f, 0) AS INTEGER) AS start FROM (
        SELECT track_id, tempo, unnest(CASE WHEN len(inside) = 0 THEN inside ELSE list_reduce([[f] FOR f IN inside], lambda kept, f: CASE WHEN f[1] - kept[-1] >= step THEN list_concat(kept, f) ELSE kept END) END) AS f
        FROM (SELECT track_id, tempo, step, [f FOR f IN fs IF f >= lo AND f <= hi] AS inside FROM (
            SELECT w.track_id, w.tempo, [b / hop FOR b IN bars] AS fs, greatest(1, CAST(floor(4 * (60.0::DOUBLE / bpm / hop)) AS INTEGER)) AS step, greatest(0, start_frame - win // 2) AS lo, least(n - win // 2, end_frame) AS hi
            FROM {name}_w w JOIN (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY track_id ORDER BY coalesce(w, 0) DESC, seg_idx) AS k FROM ({segments}) s LEFT JOIN {roles} USING (label)) WHERE k <= 3) g ON g.track_id = w.track_id)))),
{name}_sides AS (
    SELECT s.track_id, s.tempo, s.start, {R4('s.start * any_value(hop)')} AS start_s, {R4('avg(rms)', 9)} AS energy, {R4('avg(bass_ratio)', 9)} AS bass,
        greatest(0.0, 1.0 - list_min([abs(s.start * any_value(hop) - b) FOR b IN any_value(bars)]) / (240.0::DOUBLE / any_value(bpm)) * 2.0) AS phase, 0.6::DOUBLE * any_value(coalesce(CAST(r.w AS DOUBLE), 0.4::DOUBLE)) + 0.4::DOUBLE * any_value({place}) AS fit
    FROM {name}_starts s JOIN {name}_w w ON w.track_id = s.track_id AND w.tempo IS NOT DISTINCT FROM s.tempo JOIN ({segments}) g ON g.track_id = s.track_id AND s.start >= start_frame AND s.start < end_frame LEFT JOIN {roles} r USING (label)
    JOIN ({owner}) own ON own.track_id = s.track_id JOIN frames f ON f.track_id = own.owner AND f.frame_idx >= s.start AND f.frame_idx < greatest(s.start + 1, least(s.start + win, n)) GROUP BY s.track_id, s.tempo, s.start)"""


REAL = {"features": ALL_FEATURES, "segments": SEGMENTS, "owner": "SELECT track_id, owner FROM owned"}


def curves_sql(chosen: str) -> str:
    """CTE ``curves`` for the pairs of ``chosen (a_id, b_id, tempo)``."""
    return f"""
WITH chosen AS ({chosen}), {side_sql('x', 'exit', 'SELECT a_id AS track_id, tempo FROM chosen', **REAL)}, {side_sql('y', 'entry', 'SELECT b_id AS track_id, tempo FROM chosen', **REAL)},
parts AS (
    SELECT a_id, b_id, a.start_s AS a_start_s, b.start_s AS b_start_s, 1.0 - least(1.0, abs(a.energy - b.energy) / greatest(a.energy, b.energy, 1e-9)) AS e, 0.5 * (a.phase + b.phase) AS p, 1.0 - least(1.0, a.bass + b.bass) AS s, 0.5 * (a.fit + b.fit) AS o
    FROM chosen c JOIN x_sides a ON a.track_id = a_id AND a.tempo = c.tempo JOIN y_sides b ON b.track_id = b_id AND b.tempo = c.tempo),
curves AS (SELECT a_id, b_id, a_start_s, b_start_s, {R4('0.35::DOUBLE * e + 0.30::DOUBLE * p + 0.20::DOUBLE * s + 0.15::DOUBLE * o')} AS score, {R4('e')} AS energy, {R4('p')} AS phase, {R4('s')} AS spectral, {R4('o')} AS role FROM parts)
"""


CURVES = curves_sql(f"SELECT a_id, b_id, best_grid_bpm AS tempo FROM ({RECOMMEND}) WHERE rank <= 3")
RANKED = """
SELECT * EXCLUDE (place, k, rank), CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY score DESC, a_start_s, b_start_s) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY a_id, b_id, place ORDER BY score DESC, a_start_s, b_start_s) AS k FROM (SELECT *, round_even(a_start_s * 10, 0) AS place FROM curves)) WHERE k = 1) WHERE rank <= 5
"""

#: Neighbours in the saved mixes.
JUNCTIONS = "SELECT m.mix_id, CAST(m.pos AS INTEGER) AS pos, m.track_id AS a_id, n.track_id AS b_id FROM mix_tracks m JOIN mix_tracks n ON n.mix_id = m.mix_id AND n.pos = m.pos + 1 WHERE m.track_id <> n.track_id"

VIEWS["markers"] = CURVES + RANKED

query("t01_candidate_regions", lambda s, d: T.candidate_regions(all_segments(s, d), "entry").select("track_id", "seg_idx"), f"SELECT track_id, seg_idx FROM (SELECT s.*, row_number() OVER (PARTITION BY track_id ORDER BY coalesce(w, 0) DESC, seg_idx) AS k FROM ({SEGMENTS}) s LEFT JOIN entries_roles USING (label)) WHERE k <= 3")
query("t02_window_starts", lambda s, d: exits(s, d).select("track_id", "start"), f"WITH {side_sql('x', 'exit', NATIVE, **REAL)} SELECT track_id, start FROM x_starts")
query("t03_phase_alignment", lambda s, d: r(native(s, d).join(exits(s, d).select("track_id", "start"), "track_id").select("track_id", "start", T.phase_alignment(F.col("start")).alias("phase")), "phase"), f"""
WITH {side_sql('x', 'exit', NATIVE, **REAL)} SELECT track_id, s.start, {R4("greatest(0.0, 1.0 - list_min([abs(s.start * hop - b) FOR b IN bars]) / (240.0::DOUBLE / bpm) * 2.0)", 6)} AS phase FROM x_starts s JOIN x_w USING (track_id)
""")
query("t04_roles", lambda s, d: T.roles_of(exits(s, d).select("track_id", F.col("start").alias("frame")), all_segments(s, d), "exit"), f"""
WITH {side_sql('x', 'exit', NATIVE, **REAL)} SELECT track_id, s.start AS frame, CAST(coalesce(r.w, 0.4) AS DOUBLE) AS role FROM x_starts s JOIN ({SEGMENTS}) g USING (track_id) LEFT JOIN exits r USING (label) WHERE s.start >= start_frame AND s.start < end_frame
""")
query("t05_sides", lambda s, d: r(_sides(s, d), "energy", "bass", "phase", "fit"), f"WITH {side_sql('x', 'entry', NATIVE, **REAL)} SELECT track_id, start, start_s, {R4('energy', 6)} AS energy, {R4('bass', 6)} AS bass, {R4('phase', 6)} AS phase, {R4('fit', 6)} AS fit FROM x_sides")
query("t06_curves", lambda s, d: curves(s, d), CURVES + "SELECT * FROM curves")
query("t07_markers", markers, "SELECT * FROM markers")
query("t08_windows", lambda s, d: _windows(s, d), f"SELECT a_id, b_id, best_grid_bpm, 8 AS window_bars, {R4('1920.0::DOUBLE / best_grid_bpm')} AS window_s FROM ({RECOMMEND}) WHERE rank <= 3")
query("t09_mix_junctions", lambda s, d: T.mix_junctions(ordered(s, d), scalars(s, d), all_wide(s, d), all_segments(s, d)), curves_sql(f"""
SELECT DISTINCT m.a_id, m.b_id, best_grid_bpm AS tempo FROM ({MATCHED}) m JOIN ({JUNCTIONS}) j ON j.a_id = m.a_id AND j.b_id = m.b_id
""") + f"SELECT mix_id, pos, j.a_id, j.b_id, tempo AS best_grid_bpm, rank, a_start_s, b_start_s, score FROM ({JUNCTIONS}) j JOIN chosen c ON c.a_id = j.a_id AND c.b_id = j.b_id JOIN ({RANKED}) r ON r.a_id = j.a_id AND r.b_id = j.b_id")


@made_once
def junction_markers(s, d):
    """Markers of all neighbours in the saved mixes."""
    found = T.mix_junctions(ordered(s, d), scalars(s, d), all_wide(s, d), all_segments(s, d))
    return found.select("a_id", "b_id", "rank", "a_start_s", "b_start_s", "score").distinct()


def _sides(s, d):
    f, seg = native(s, d), all_segments(s, d)
    return T.score_sides(f, seg, T.window_starts(f, T.candidate_regions(seg, "entry")), "entry").drop("tempo")


def exits(s, d):
    """Starts of windows in which a track can be left, at its own tempo."""
    return T.window_starts(native(s, d), T.candidate_regions(all_segments(s, d), "exit"))


def three_best(s, d):
    return recommended(s, d).filter("rank <= 3").select("a_id", "b_id", "best_grid_bpm")


def curves(s, d):
    """Curves of the three best recommendations of every track."""
    return T.transition_curves(three_best(s, d), all_wide(s, d), all_segments(s, d))


def _windows(s, d):
    return recommended(s, d).filter("rank <= 3").select("a_id", "b_id", "best_grid_bpm", F.lit(D.WINDOW_BARS).alias("window_bars"), T.window_seconds(F.col("best_grid_bpm")).alias("window_s"))
