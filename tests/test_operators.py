"""Exact small cases, brute force on random input, plans, readers and streams."""

import json
import math
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadenza import functions as X
from cadenza import streaming as ST
from cadenza.functions import dimensions as D
from cadenza.functions import sqlfuncs
from cadenza.operators import catalog, chains, features, ingest, joins, licensing, matching, merge, segments, tempo
from cadenza.sources import adapters as A
from cadenza.sources import buckets
from cadenza.sources import files as FS
from cadenza.sources import readers as S
from cadenza.sources import snapshots
from cadenza.sources.staging import stage

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# functions


def test_camelot(spark):
    score = lambda a, b: one(spark, X.camelot_score(F.lit(a), F.lit(b)))[0]
    assert [score("8A", b) for b in ("8A", "9A", "8B")] == [1.0, 0.8, 0.8]
    assert score("8A", "2A") < score("8A", "9A") and score("8A", "3B") < 0.4 and score("12A", "1A") == 0.8
    assert score("3B", "11A") == score("11A", "3B")


def test_bpm_score(spark):
    s = lambda a, b, g: one(spark, X.bpm_score(F.lit(a), F.lit(b), F.lit(g).cast("array<int>")))[0]
    assert s(124.0, 124.0, [124])["score"] > s(120.0, 128.0, [124])["score"]
    assert tuple(one(spark, X.bpm_score(F.lit(1.0), F.lit(1.0), F.array().cast("array<int>")))[0]) == (0.0, None)
    assert s(122.5, 122.5, [120, 125])["grid"] == 120


@pytest.mark.parametrize("bpm", [90, 120, 124, 128])
def test_beats_and_seconds(spark, bpm):
    for beats in (0, 1, 16, 96, 512):
        assert one(spark, X.seconds_to_beats(X.beats_to_seconds(F.lit(beats), F.lit(bpm)), F.lit(bpm)))[0] == beats
    assert one(spark, X.beats_to_seconds(F.lit(4), F.lit(0)), X.seconds_to_beats(F.lit(4.0), F.lit(0)))[:] == (0.0, 0)


def test_bands_have_no_gap(spark):
    assert spark.range(6950, 18250).filter(X.band_of(F.col("id") / 100).isNull()).count() == 0
    assert one(spark, X.band_of(F.lit(119.96)), X.band_of(F.lit(60.0)))[:] == ("house", None)
    assert tempo.band_gaps(spark).count() == 0
    with pytest.raises(PySparkException):
        one(spark, X.grid_points(F.lit(120.0), F.lit("nowhere")))


def test_grid_coverage_loses_what_is_published(spark):
    lost = {r["band"]: r["lost_percent"] for r in tempo.grid_coverage(spark).collect()}
    assert lost["house"] == lost["uptempo"] == lost["fast"] == lost["downtempo"] == 0 and 2 < lost["slow"] < 4 and 2 < lost["midtempo"] < 4


def test_licences(spark):
    for variant in D.VARIANTS:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for tail in ("", " UK"):
                name = f"CC {variant} {version}{tail}"
                got = one(spark, X.license_from_url(X.license_url(F.lit(name))), X.licence_flag("nd", F.lit(name)))
                assert got[:] == (name, "ND" in variant)
    bad = spark.createDataFrame([("CC0",), ("",), (None,), ("CC BY 9.0",), ("cc by 3.0",)], "license string")
    known, quarantined = licensing.split_licenses(bad)
    assert known.count() == 0 and quarantined.count() == 5
    with pytest.raises(PySparkException):
        licensing.split_licenses(bad, strict=True)[0].collect()
    assert one(spark, X.license_from_url(F.lit("http://CREATIVECOMMONS.org/licenses/by-nc/3.0/de/x")))[0] == "CC BY-NC 3.0 DE"
    assert one(spark, X.license_from_url(F.lit("http://creativecommons.org/licenses/by/3.0")))[0] is None


def test_time_labels(spark):
    assert [one(spark, X.time_label(F.lit(float(s))))[0] for s in (0, 59.9, 61, 3600, 36061, -5, math.nan)] == ["0:00", "0:59", "1:01", "1:00:00", "10:01:01", "0:00", "0:00"]


def test_gain_power(spark):
    t = spark.range(0, 101).withColumn("t", F.col("id") / 10)
    zone = (F.lit(2.0), F.lit(8.0))
    none = F.lit(None).cast("double")
    rows = t.select(X.gain_at(F.col("t"), *zone, none, none).alias("i"), X.gain_at(F.col("t"), none, none, *zone).alias("o"), X.gain_at(F.col("t"), F.lit(3.0), F.lit(3.0), none, none).alias("d")).collect()
    assert all(abs(r["i"] ** 2 + r["o"] ** 2 - 1) < 1e-9 and r["d"] == 1 for r in rows)


# chains


def chain(spark, rows, head):
    nodes = spark.createDataFrame([(i, "m", t, n, 0, 120) for i, n, t in rows], "id string, mix_id string, track_id string, next_id string, delta_beats int, grid_bpm int")
    mixes = spark.createDataFrame([("m", "mix", head, 0.0, 0.0)], "id string, name string, head_id string, created_at double, updated_at double")
    ordered, problems = chains.order_chains(mixes, nodes)
    return [r["id"] for r in ordered.orderBy("pos").collect()], [r["problem"] for r in problems.collect()]


def test_chain_walk(spark):
    assert chain(spark, [("b", "c", "t"), ("c", None, "t"), ("a", "b", "t")], "a") == (["a", "b", "c"], [])
    assert chain(spark, [("a", "b", "t"), ("b", "a", "t")], "a") == ([], ["cycle"])
    assert chain(spark, [("a", None, "t"), ("stranded", None, "t")], "a") == ([], ["unreachable"])
    assert chain(spark, [("a", "ghost", "t")], "a") == ([], ["dangling"])
    assert chain(spark, [], None) == ([], [])


def entries(spark, starts, duration=60.0, bpm=120):
    rows = [("m", i, f"n{i}", f"t{i}", 0, float(s - (starts[i - 1] if i else 0)), float(s), bpm, duration) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, "mix_id string, pos int, id string, track_id string, delta_beats int, delta_s double, offset_s double, grid_bpm int, duration_s double")


def test_long_chains_are_ranked_as_short_ones_are_followed(spark):
    rng = np.random.default_rng(6)
    nodes, mixes = [], []
    for m in range(40):
        n = int(rng.integers(0, 12))
        ids = [f"{m}-{i}" for i in rng.permutation(n)]
        following = dict(zip(ids, [*ids[1:], None]))
        for _ in range(int(rng.integers(0, 3))):
            if ids:
                following[str(rng.choice(ids))] = [None, "ghost", "", str(rng.choice(ids))][int(rng.integers(0, 4))]
        nodes += [(i, f"m{m}", "t", nxt, 0, 120) for i, nxt in following.items()]
        mixes.append((f"m{m}", "mix", [ids[0] if ids else None, ids[0] if ids else "", "nobody", ids[-1] if ids else None][int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))], 0.0, 0.0))
    tables = spark.createDataFrame(mixes, "id string, name string, head_id string, created_at double, updated_at double"), spark.createDataFrame(nodes, "id string, mix_id string, track_id string, next_id string, delta_beats int, grid_bpm int")
    rows = lambda long: [sorted(tuple(r) for r in df.collect()) for df in chains.order_chains(*tables, long=long)]
    followed = rows(100)
    assert rows(5) == followed == rows(0)
    assert {p for _, p in followed[1]} == {"cycle", "dangling", "unreachable"} and followed[0]


@pytest.mark.parametrize("rest", [0, 6])
def test_contracted_links_are_ranked_as_walks_are(spark, monkeypatch, rest):
    monkeypatch.setattr(chains, "REST", rest)
    rng = np.random.default_rng(16)
    to = [None if rng.random() < 0.1 else int(rng.integers(0, 60)) for _ in range(60)] + [None if i == 99 else i + 1 for i in range(60, 100)] + [100, 102, 103, 101]
    own = [int(x) for x in rng.integers(0, 5, len(to))]
    links = spark.createDataFrame([(i, t, own[i], "end" if t is None else None) for i, t in enumerate(to)], "at long, to long, rank long, ends string")

    def walk(i):
        seen, total = set(), 0
        while i is not None and i not in seen:
            seen.add(i)
            total, i = total + own[i], to[i]
        return ("end", total) if i is None else ("cycle", None)

    got = {r["at"]: (r["ends"], r["rank"] if r["ends"] == "end" else None) for r in chains._ranks(links).collect()}
    assert got == {i: walk(i) for i in range(len(to))}


@pytest.mark.parametrize("in_order, most", [(True, 4), (False, 10)])
def test_long_chains_write_as_many_rows_a_node_at_any_length(spark, monkeypatch, in_order, most):
    monkeypatch.setattr(chains, "REST", 64)
    written = []
    monkeypatch.setattr(chains, "stage", lambda df, name: (found := stage(df, name), written.append(found.count()))[0])

    def rows_a_node(n):
        written.clear()
        name = (lambda k: F.lpad(k.cast("string"), 9, "0")) if in_order else (lambda k: F.md5(k.cast("string")))
        k = F.col("id")
        nodes = spark.range(n).select(name(k).alias("id"), F.lit("m").alias("mix_id"), F.lit("t").alias("track_id"), F.when(k < n - 1, name(k + 1)).alias("next_id"), k.cast("int").alias("delta_beats"), F.lit(120).alias("grid_bpm"))
        ordered, problems = chains.order_chains(spark.range(1).select(F.lit("m").alias("id"), name(F.col("id")).alias("head_id")), nodes)
        assert problems.isEmpty() and ordered.filter("pos = delta_beats").count() == n
        return sum(written) / n

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "500")
    try:
        few, many = rows_a_node(4000), rows_a_node(32000)
    finally:
        spark.conf.set(rows, before)
    assert max(few, many) < most and many < 1.2 * few


def test_pairs_are_spread_over_tasks_and_scored_by_their_best_tempo(spark):
    rng = np.random.default_rng(18)
    grid = [101, 106, 111]
    rows = [(str(i), "midtempo", float(rng.uniform(96, 118)), "8A", sorted(rng.choice(grid, int(rng.integers(1, 4)), replace=False).tolist()), 0.5, 0.5) for i in range(600)]
    scalars = spark.createDataFrame(rows, "id string, band string, bpm double, camelot string, grid array<int>, intro_rms double, outro_rms double")
    pairs = matching.candidate_pairs(scalars)
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    met = [(a, b) for a in rows for b in rows if a[0] != b[0] and set(a[4]) & set(b[4])]
    assert sum(shares) == len(met) and len(shares) == 4 and max(shares) < 0.5 * len(met)
    best = pairs.withColumn("s", X.bpm_score("a_bpm", "b_bpm", X.shared_grid("a_grid", "b_grid"))).select("a_id", "b_id", "s.grid", "s.score")
    assert best.exceptAll(matching.tempo_scores(pairs)).isEmpty() and matching.tempo_scores(pairs).count() == len(met)


def test_interval_and_nearest_joins(spark):
    rng = np.random.default_rng(9)
    spans = lambda n, name: [(f"{name}{i}", str(rng.integers(0, 3)), a := float(rng.integers(-50, 400)), a + float(rng.choice([0, 1, 7, 300]))) for i in range(n)]
    left, right = spans(60, "l") + [("l-null", "0", None, 3.0), ("l-back", "0", 9.0, 3.0)], spans(80, "r")
    a, b = spark.createDataFrame(left, "l string, k string, a double, b double"), spark.createDataFrame(right, "r string, k string, c double, d double")
    got = joins.overlapping(a, b, ["k"], ("a", "b"), ("c", "d"), 20.0)
    assert sorted((x["l"], x["r"]) for x in got.collect()) == sorted((x[0], y[0]) for x in left[:-2] for y in right if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        joins.overlapping(a, a, ["k"], ("a", "b"), ("a", "b"), 20.0)
    points = [(i, k, t) for i, (k, t) in enumerate([(str(rng.integers(0, 4)), float(rng.integers(-40, 900)) / 2) for _ in range(300)] + [("0", None), (None, 3.0)])]
    values = [(str(rng.integers(0, 3)), float(v)) for v in rng.integers(0, 800, 90)] + [("0", None), ("0", 5.0), ("0", 5.0)]
    for span in (16.0, 10_000.0):
        found = joins.nearest(spark.createDataFrame(points, "i int, k string, t double"), spark.createDataFrame(values, "k string, v double"), "k", "t", "v", span)
        best = {i: min((v for key, v in values if key == k and v is not None and t is not None), key=lambda v: (abs(t - v), v), default=None) for i, k, t in points}
        assert {r["i"]: r["nearest"] for r in found.filter("t IS NOT NULL").collect()} == {i: v for i, v in best.items() if points[i][2] is not None}
        assert found.count() == len(points)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_split_series_equal_whole_ones(spark, block):
    rng = np.random.default_rng(3)
    rows = [(t, i, float(v), float(w), 0.5) for t, n in (("a", 500), ("b", 1), ("c", 14), ("d", 7)) for i, (v, w) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 3, n)))]
    rows += [("flat", i, 1.0, 0.0, 0.5) for i in range(40)] + [("step", i, float(i // 25), 0.0, 0.5) for i in range(100)]
    frames = spark.createDataFrame(rows, "track_id string, frame_idx int, rms double, flux double, bass_ratio double")
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(features.prefix_sums(frames, block=block)) == as_rows(features.prefix_sums(frames))
    for k in (1, 2, 5):
        whole = segments.novelty(segments.blended_feature(frames, k), k)
        split = segments.novelty(segments.blended_feature(frames, k, block), k, block)
        assert as_rows(split.select("track_id", "frame_idx", "novelty")) == as_rows(whole.select("track_id", "frame_idx", "novelty"))
        assert as_rows(segments.local_maxima(split, block=block)) == as_rows(segments.local_maxima(whole))
    assert as_rows(segments.local_maxima(frames, "rms", block)) == as_rows(segments.local_maxima(frames, "rms"))
    with pytest.raises(ValueError):
        segments.blended_feature(frames, 40, 7).collect()


def test_snap_takes_markers_then_beats_then_the_tempo(spark):
    p = spark.createDataFrame([("x", "a", "b", 10.0, 120), ("y", "a", "c", 10.25, 120), ("z", "q", "b", 10.3, 120), ("w", "q", "b", -4.0, 0)], "key string, a_id string, b_id string, t double, bpm int")
    markers = spark.createDataFrame([("a", "b", 2, 12.0, 1.0), ("a", "b", 1, 11.0, 2.0), ("a", "c", 1, 50.0, 0.0)], "a_id string, b_id string, rank int, a_start_s double, b_start_s double")
    beats = spark.createDataFrame([("a", 10.0), ("a", 10.5)], "a_id string, beat double")
    assert {r["key"]: r["snapped"] for r in chains.snap(p, markers, beats).collect()} == {"x": 9.0, "y": 10.0, "z": 10.5, "w": 0.0}


def test_active_nodes_of_probes(spark):
    e = entries(spark, [0, 45, 90])
    probes = spark.createDataFrame([(1, "m", 0.0, 1.0), (2, "m", 45.0, 200.0), (3, "nobody", 0.0, 500.0), (4, "m", 5000.0, 5001.0)], "probe int, mix_id string, t0 double, t1 double")
    for width in (5.0, 1000.0):
        got = sorted((r["probe"], r["pos"]) for r in chains.active_nodes(e, probes, width).collect())
        whole = [(r["pos"], r["offset_s"], r["offset_s"] + r["duration_s"]) for r in e.collect()]
        assert got == sorted((p, n) for p, m, t0, t1 in ((1, "m", 0.0, 1.0), (2, "m", 45.0, 200.0), (4, "m", 5000.0, 5001.0)) for n, a, b in whole if a <= t1 and b > t0)


def test_overlaps(spark):
    bad = lambda starts: chains.overlap_violations(entries(spark, starts)).count()
    assert [bad(s) for s in ([0, 45, 90], [0, 20, 40], [0, 30, 60], [0, 60, 120, 150, 170], [0], [0, 5])] == [0, 1, 0, 1, 0, 0]
    floor = {r["id"]: r["min_delta_beats"] for r in chains.min_delta_beats(entries(spark, [0, 45, 90])).collect()}
    assert floor["n0"] == 0 and floor["n2"] == 30
    assert chains.max_concurrency(entries(spark, [0, 30, 60])).first()["most"] == 2


def test_floor_keeps_the_overlap_rule(spark):
    rng = np.random.default_rng(1)
    for _ in range(4):
        starts = np.cumsum(rng.integers(31, 60, 8)) - 31
        e = entries(spark, starts.tolist())
        floors = {r["pos"]: r["min_delta_beats"] for r in chains.min_delta_beats(e).collect()}
        k = int(rng.integers(1, 8))
        edits = spark.createDataFrame([(f"n{k}", floors[k])], "id string, delta_beats int")
        exact = e.withColumn("delta_beats", X.seconds_to_beats("delta_s", "grid_bpm"))
        accepted, rejected = chains.apply_gap_edits(exact, edits)
        assert rejected.count() == 0 and accepted.count() == 8


def test_edits_ripple(spark):
    c = entries(spark, [0, 45, 90, 130]).select("mix_id", "pos", "id", "track_id", "delta_s", "duration_s")
    gaps = lambda df: [(r["id"], r["delta_s"]) for r in df.orderBy("pos").collect()]
    new = spark.createDataFrame([("m", 99, "x", "t", -3.0, 10.0)], "mix_id string, at int, id string, track_id string, delta_s double, duration_s double")
    assert gaps(chains.insert_nodes(c, new)) == [("n0", 0.0), ("n1", 45.0), ("n2", 45.0), ("n3", 40.0), ("x", 0.0)]
    gone = spark.createDataFrame([("n0",)], "id string")
    assert gaps(chains.remove_nodes(c, gone)) == [("n1", 0.0), ("n2", 45.0), ("n3", 40.0)]
    start = spark.createDataFrame([("n2", 70.0)], "id string, start_s double")
    assert gaps(chains.set_start(c, start))[2] == ("n2", 25.0)
    none = spark.createDataFrame([], "a_id string, b_id string, rank int, a_start_s double, b_start_s double, score double")
    healed = chains.delete_and_heal(c, spark.createDataFrame([("n1",)], "id string"), none)
    assert gaps(healed) == [("n0", 0.0), ("n2", 44.0), ("n3", 40.0)]


# features


def test_window_means_equal_brute_force(spark):
    frames = A.frames(spark, SF)
    wide = features.wide_features(frames, A.raw_tracks(spark, SF), A.HOP)
    rms = {r["track_id"]: [x[1] for x in sorted(r["l"])] for r in frames.groupBy("track_id").agg(F.collect_list(F.struct("frame_idx", "rms")).alias("l")).collect()}
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = sorted(rng.integers(0, 40, 2).tolist())
        for r in wide.select("track_id", features.window_mean("p_rms", F.lit(a), F.lit(b)).alias("m")).collect():
            assert r["m"] == pytest.approx(np.mean(rms[r["track_id"]][a : max(b, a + 1)]), abs=1e-9)


def click_frames(spark, bpm, hop, n=1500):
    period = 60 / bpm / hop
    rows = [("t", i, 1.0, 1.0 if (i % period) < 1 else 0.01, 0.1) for i in range(n)]
    return spark.createDataFrame(rows, "track_id string, frame_idx int, rms double, flux double, bass_ratio double")


@pytest.mark.parametrize("bpm", [100, 120, 125])
def test_tempo_of_clicks(spark, bpm):
    hop = 512 / 22050
    frames = click_frames(spark, bpm, hop)
    got = features.estimate_tempo(frames, hop)
    assert got.first()["bpm"] == pytest.approx(bpm, abs=2.0)
    beats = features.beat_grid(frames, got, hop).first()["beats"]
    assert np.median(np.diff(beats)) == pytest.approx(60 / bpm, abs=0.02)


def test_spectrum_key_and_segments_of_sound(spark):
    sr, t = 22_050, np.arange(22_050 * 2) / 22_050
    chord = sum(np.sin(2 * np.pi * f * t) for f in (261.63, 329.63, 392.0)) / 3
    audio = spark.createDataFrame([("c", sr, chord.tolist()), ("short", sr, [0.0] * 100)], "track_id string, sr int, samples array<double>")
    spectrum = features.spectra(audio)
    assert spectrum.select("frame_idx").distinct().count() == 1 + (len(t) - 2048) // 512 and spectrum.filter("track_id = 'short'").count() == 0
    key = features.estimate_key(features.chroma(spectrum)).first()
    assert (key["tonic"], key["mode"], key["camelot"]) == ("C", "major", "8B")
    rms = [r["rms"] for r in features.frame_rms(audio).orderBy("frame_idx").collect()]
    assert rms[3] == pytest.approx(np.sqrt(np.mean(chord[1536 : 1536 + 2048] ** 2)), abs=1e-9)


def test_one_pass_of_features(spark, tmp_path):
    rng = np.random.default_rng(3)
    sound = {"a": rng.normal(0, 0.3, 30_000), "b": np.sin(np.arange(70_000) / 40), "short": np.zeros(50)}
    audio = spark.createDataFrame([(k, 22_050, v.tolist(), None) for k, v in sound.items()] + [("bad", None, None, "junk")], "track_id string, sr int, samples array<double>, error string")
    got = {(r["track_id"], r["frame_idx"]): r for r in features.frame_features(audio, 256, 64).collect()}
    spectrum = features.spectra(audio, 256, 64)
    # the long forms of the same features
    for column, table in (("flux", features.onset_strength(spectrum)), ("bass_ratio", features.bass_ratio(spectrum))):
        rows = {(r["track_id"], r["frame_idx"]): r[column] for r in table.collect()}
        assert rows.keys() == got.keys() and all(got[k][column] == pytest.approx(v, abs=1e-9) for k, v in rows.items())
    for k, x in sound.items():
        for i in range(0, max(0, 1 + (len(x) - 256) // 64), 7):
            assert got[k, i]["rms"] == pytest.approx(np.sqrt(np.mean(x[i * 64 : i * 64 + 256] ** 2)), abs=1e-9)
    kept = features.frame_features(audio, 256, 64, keep_errors=True).filter("error IS NOT NULL").collect()
    assert [(r["track_id"], r["frame_idx"], r["error"]) for r in kept] == [("bad", None, "junk")]


def test_features_of_long_audio(spark, tmp_path):
    n = 22_050 * 240
    write_wav(tmp_path / "long.wav", np.sin(np.arange(n) / 30) * 0.5)
    got = features.frame_features(S.read_wav(spark, str(tmp_path / "*.wav")))
    row = got.agg(F.count("*").alias("n"), F.max("frame_idx").alias("last"), F.min("rms").alias("a"), F.max("rms").alias("b")).first()
    assert row["n"] == row["last"] + 1 == 1 + (n - 2048) // 512 and 0.34 < row["a"] <= row["b"] < 0.37


def test_segments_are_whole(spark):
    seg = segments.segment(A.frames(spark, SF), A.HOP)
    lengths = {r["track_id"]: r["count"] for r in A.frames(spark, SF).groupBy("track_id").count().collect()}
    by = {}
    for r in seg.orderBy("track_id", "seg_idx").collect():
        by.setdefault(r["track_id"], []).append(r)
    for track, rows in by.items():
        assert rows[0]["start_frame"] == 0 and rows[-1]["end_frame"] == lengths[track]
        assert all(a["end_frame"] == b["start_frame"] for a, b in zip(rows, rows[1:], strict=False))
        assert rows[0]["label"] == "intro" and (len(rows) == 1 or rows[-1]["label"] == "outro")


def test_short_tracks_are_one_segment(spark):
    rows = [("s", i, float(i), 0.0, 0.0) for i in range(10)]
    got = segments.segment(spark.createDataFrame(rows, "track_id string, frame_idx int, rms double, flux double, bass_ratio double"), A.HOP).collect()
    assert [(r["label"], r["start_frame"], r["end_frame"]) for r in got] == [("full", 0, 10)]


# matching


def five(spark):
    rows = [("1001", 124.0, "8A", True, [120, 125]), ("1002", 126.0, "7A", True, [120, 125]), ("1003", 122.0, "8B", True, [120, 125]), ("2001", 90.0, "4A", True, [85, 90, 95])]
    t = spark.createDataFrame(rows, "id string, bpm double, camelot string, mixable boolean, grid array<int>")
    return t.withColumn("band", X.band_of("bpm")).withColumn("intro_rms", F.lit(0.2)).withColumn("outro_rms", F.lit(0.2)).drop("mixable")


def test_recommendations_of_the_fixture(spark):
    recs = matching.recommend(five(spark)).collect()
    assert {r["b_id"] for r in recs if r["a_id"] == "1001"} == {"1002", "1003"} and not [r for r in recs if r["a_id"] == "2001"]
    first = matching.recommend(five(spark), k=1).collect()
    assert {(r["a_id"], r["b_id"]) for r in first} == {(r["a_id"], r["b_id"]) for r in recs if r["rank"] == 1}


def random_scalars(spark, n, hot=0):
    """Tracks of all bands; ``hot`` of them are alike but for their ids."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        band = str(rng.choice(list(D.BANDS)))
        low, high = D.BANDS[band]
        bpm = float(rng.integers(low * 10, high * 10)) / 10 if i >= hot else 124.0
        band = band if i >= hot else "house"
        grid = [g for g in D.grid_of(*D.BANDS[band]) if abs(g / bpm - 1) <= D.MOST_STRETCH and rng.random() < 0.9] or [D.grid_of(*D.BANDS[band])[0]]
        key = str(rng.choice(D.CAMELOT_MAJOR + D.CAMELOT_MINOR)) if i >= hot else "8A"
        rows.append((f"t{i}", band, bpm, key if i % 50 else None, grid, float(rng.integers(-2, 40)) / 10 if i >= hot else 1.5, float(rng.integers(-2, 40)) / 10 if i >= hot else 1.5))
    return spark.createDataFrame(rows, "id string, band string, bpm double, camelot string, grid array<int>, intro_rms double, outro_rms double")


@pytest.mark.parametrize(("n", "hot", "k"), [(500, 0, 20), (400, 150, 5), (1, 0, 3), (0, 0, 3)])
def test_search_finds_what_scoring_every_pair_finds(spark, monkeypatch, n, hot, k):
    monkeypatch.setattr(matching, "MOST_ROWS", 20)
    scalars = random_scalars(spark, n, hot)
    rows = lambda df: sorted((r["a_id"], r["rank"], r["b_id"], r["score"], r["best_grid_bpm"]) for r in df.collect())
    every = [r for r in rows(matching.recommend(scalars, k=0)) if r[1] <= k]
    assert rows(matching.recommend(scalars, k=k)) == every
    some = spark.createDataFrame([("t1",), ("t7",), ("nobody",)], "id string")
    assert rows(matching.recommend(scalars, some, k=k)) == [r for r in every if r[0] in ("t1", "t7")]


def test_search_scores_a_part_of_the_pairs(spark):
    scalars, seen = random_scalars(spark, 6000), []
    matching.recommend(scalars, seen=seen).write.format("noop").mode("overwrite").save()
    assert 0 < sum(o.get["n"] for o in seen) < 0.2 * matching.candidate_pairs(scalars).count()


def test_dealt_sides_are_never_broadcast(spark, tmp_path):
    spark.range(60_000).selectExpr("cast(id AS string) AS id", "'house' AS band", "124.0D AS bpm", "'8A' AS camelot", "array(120, 125) AS grid", "1.0D AS intro_rms", "1.0D AS outro_rms").write.parquet(str(tmp_path / "s"))
    plan = matching.candidate_pairs(spark.read.parquet(str(tmp_path / "s")))._jdf.queryExecution().executedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Join" in line and "a_mask" in line]
    assert pairs and all("SortMergeJoin" in line for line in pairs)


def test_rows_are_copied_to_few_blocks(spark):
    """A row is copied once per block: 1.1 million rows of a band are a few blocks, which a task can hold."""
    for n in (1000, 20_000, 184_425, 1_106_550):
        blocks = one(spark, matching._blocks(F.lit(n)).alias("n"))["n"]
        assert min(12, n / 100) <= blocks <= 17 and n / blocks <= 1 << 16


def test_plan_of_recommendations(spark):
    plan = matching.recommend(five(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and "WindowGroupLimit" in plan


def test_deck(spark):
    rows = [(str(i), "house", True, None, float(i)) for i in range(12)] + [(f"d{i}", "", True, "ready", None) for i in range(3)] + [("nd", "house", False, None, 99.0), ("wip", "house", True, "fetched", 98.0)]
    t = spark.createDataFrame(rows, "id string, genre string, mixable boolean, status string, popularity double")
    deck = [r.asDict() for r in catalog.genre_deck(t, 5).orderBy(F.desc("total"), "genre", "rank").collect()]
    assert [r["id"] for r in deck[:3]] == ["11", "10", "9"] and deck[0]["total"] == 12 and deck[0]["showing"] == 5
    assert {r["genre"] for r in deck} == {"house", "other"} and not deck[-1]["has_popularity"]
    assert sorted(map(tuple, catalog.genre_deck(t.orderBy(F.desc("id")), 5).collect())) == sorted(map(tuple, catalog.genre_deck(t, 5).collect()))
    assert catalog.genre_deck(t.select("id", "genre")).count() > 0


# tables, readers, publishing


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert merge.check_schema(df, ["x", "y"]) is df
    with pytest.raises(ValueError):
        merge.check_schema(df, ["y", "x"])
    from pyspark.sql import types as T

    more = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("z", T.DoubleType()), T.StructField("w", T.IntegerType(), False)])
    assert merge.add_missing_columns(df, more, {"w": 3}).first().asDict() == {"x": 1, "y": "a", "z": None, "w": 3}
    with pytest.raises(ValueError):
        merge.add_missing_columns(df, more)
    assert merge.add_missing_columns(df.limit(0), more).columns == ["x", "y", "z", "w"]


def write_wav(path, samples, sr=22_050, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())


def test_readers(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps({"mode": "x", "tracks": [{"id": 7, "name": "n", "bpm": 120, "license": "CC BY 4.0"}]}, indent=1))
    assert S.read_catalog_seed(spark, str(tmp_path / "seed.json")).first()["id"] == "7"
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "1.json").write_text('{"name": "a"}')
    (meta / "2.json").write_text("{broken")
    assert [r["id"] for r in S.read_sidecars(spark, str(meta)).collect()] == ["1"]
    audio = tmp_path / "blobs" / "audio"
    audio.mkdir(parents=True)
    sine = np.sin(2 * np.pi * 440 * np.arange(22_050) / 22_050) * 0.5
    write_wav(audio / "m.wav", sine)
    write_wav(audio / "s.wav", np.repeat(sine, 2), channels=2)
    (audio / "bad.wav").write_bytes(b"nothing")
    got = {r["track_id"]: r for r in S.read_wav(spark, str(audio / "*.wav")).collect()}
    assert got["m"]["duration_s"] == got["s"]["duration_s"] == 1.0 and got["bad"]["error"] and got["bad"]["samples"] is None
    assert np.abs(np.array(got["m"]["samples"]) - np.array(got["s"]["samples"])).max() < 1e-9
    keys = [r["key"] for r in S.blob_inventory(spark, str(tmp_path / "blobs"), "audio/").collect()]
    assert keys == ["audio/bad.wav", "audio/m.wav", "audio/s.wav"]
    with pytest.raises(ValueError):
        S.with_object_keys(spark.createDataFrame([("1",)], "id string"), "flac")


def test_sound_in_ranges_and_headers(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.uniform(-0.9, 0.9, 2500)
    write_wav(tmp_path / "a.wav", np.repeat(x, 2), channels=2)
    FS.write_blobs(spark.createDataFrame([("b", 8000, x.tolist()), ("none", 8000, [])], "id string, sr int, x array<double>").select(F.concat("id", F.lit(".wav")).alias("name"), FS.wav_content("x", "sr").alias("content")), str(tmp_path))
    FS.write_blobs(spark.createDataFrame([("deep/er/bad.wav", b"junk"), ("notes.txt", None)], "name string, content binary"), str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_writing")] and (tmp_path / "notes.txt").read_bytes() == b""
    rows = FS.read_wav_ranges(spark, str(tmp_path), 1000).collect()
    for name in "ab":
        own = sorted((r["first"], r["samples"]) for r in rows if r["track_id"] == name)
        assert [f for f, _ in own] == [0, 1000, 2000] and np.abs(np.concatenate([s for _, s in own]) - x).max() < 1e-4
    assert [(r["samples"], r["error"] is None) for r in rows if r["track_id"] == "none"] == [([], True)]
    assert [(r["samples"], r["error"] is None) for r in rows if r["track_id"] == "bad"] == [(None, False)]
    heads = {r["track_id"]: r for r in FS.read_wav_headers(spark, str(tmp_path)).collect()}
    assert (heads["a"]["sr"], heads["a"]["channels"], heads["a"]["n_samples"], heads["b"]["duration_s"]) == (22_050, 2, 2500, 2500 / 8000) and heads["bad"]["error"]
    some = FS.read_wav_ranges(spark, str(tmp_path), 1000).filter("track_id = 'b'")
    assert some.count() == 3 and some.rdd.getNumPartitions() < 9


def clicks(bpm, sr, seconds, tonic=880.0):
    """A pulse at a tempo over a chord: what an analysis should hear."""
    t = np.arange(int(sr * seconds)) / sr
    chord = sum(np.sin(2 * np.pi * tonic * 2 ** (k / 12) * t) for k in (0, 4, 7)) / 3
    return chord * (0.1 + 0.6 * np.exp(-((t * bpm / 60) % 1) * 12))


@pytest.mark.parametrize("sr", [22_050, 44_100, 48_000])
def test_analysis_hears_rate_tempo_key_and_beats(spark, tmp_path, sr):
    for bpm in (100, 124):
        write_wav(tmp_path / f"{bpm}.wav", clicks(bpm, sr, 12.0), sr)
    write_wav(tmp_path / "short.wav", np.zeros(100), sr)
    (tmp_path / "bad.wav").write_bytes(b"junk")
    got = {r["track_id"]: r for r in features.analyse(features.track_series(S.read_wav(spark, str(tmp_path / "*.wav")))).collect()}
    for bpm in (100, 124):
        row = got[str(bpm)]
        assert row["duration_s"] == 12.0 and row["hop_dur"] == 512 / sr and abs(row["bpm"] - bpm) < 1 and row["camelot"] in ("11B", "8A")
        assert row["n"] == 1 + (12 * sr - 2048) // 512 == len(row["rms"]) and np.abs(np.diff(row["beat_grid"]) - 60 / bpm).max() < 0.01
        late = (np.array(row["beat_grid"]) * bpm / 60 + 0.5) % 1 - 0.5  # in beats, from the pulse
        assert np.abs(late).max() < 0.25
    assert got["short"]["n"] == 0 and got["short"]["bpm"] == 120 and got["short"]["beat_grid"] == []
    assert got["bad"]["error"] and got["bad"]["bpm"] is None


def test_fused_series_equal_the_long_forms(spark):
    rng = np.random.default_rng(2)
    audio = spark.createDataFrame([("a", 2000, rng.normal(size=3000).tolist()), ("b", 4000, rng.normal(size=700).tolist())], "track_id string, sr int, samples array<double>")
    series = features.track_series(audio, 64, 16)
    order = lambda df: [tuple(r) for r in df.orderBy("track_id", "frame_idx").collect()]
    for x, y in zip(order(features.frames_of(series)), order(features.frame_features(audio, 64, 16)), strict=True):
        assert x[:2] == y[:2] and np.allclose(x[2:], y[2:])
    keys = lambda df: {r["track_id"]: (r["tonic"], r["mode"], round(r["confidence"], 3)) for r in df.collect()}
    assert keys(features.analyse(series)) == keys(features.estimate_key(features.chroma(features.spectra(audio, 64, 16))))
    for hop in {r["hop_dur"] for r in series.select("hop_dur").collect()}:
        own = series.filter(F.col("hop_dur") == hop)
        tempo_ = features.estimate_tempo(features.frames_of(own), hop)
        assert tempo_.first()["bpm"] == pytest.approx(features.analyse(own).first()["bpm"], abs=0.006)
        beats = features.beat_grid(features.frames_of(own), tempo_, hop).first()["beats"]
        assert np.allclose(beats, features.analyse(own).first()["beat_grid"], atol=2e-5)


def test_publish(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("1", "2"):
        write_wav(tmp_path / "in" / f"{name}.wav", clicks(124, 22_050, 6.0))
    (tmp_path / "in" / "3.wav").write_bytes(b"junk")
    seed = spark.createDataFrame([("1", "house", "CC BY 3.0", 124.0), ("2", "auto", "CC BY-ND 3.0", 124.0), ("3", "house", "CC BY 3.0", 120.0), ("4", "house", "CC0", 120.0)], "id string, genre string, license string, bpm double")
    out = ingest.publish(spark, seed, S.read_wav(spark, str(tmp_path / "in" / "*.wav")), str(tmp_path / "out"))
    got = {r["id"]: r["outcome"].split(":")[0] for r in out.collect()}
    assert got == {"1": "ready", "2": "refused", "3": "failed", "4": "quarantined"}
    tracks, variants = merge.read_published(spark, str(tmp_path / "out" / "catalog"))
    (row,) = tracks.collect()
    assert row["id"] == "1" and row["duration_s"] == 6.0 and abs(row["native_bpm"] - 124) < 2 and row["camelot"] in ("11B", "8A")
    assert {r["grid_bpm"] for r in variants.collect()} == {g for g in D.grid_of(*D.BANDS["house"]) if abs(g / row["native_bpm"] - 1) <= D.MOST_STRETCH}
    # a second run adds what is new and leaves what is there
    more = seed.union(spark.createDataFrame([("5", "house", "CC BY 3.0", 120.0)], seed.schema))
    write_wav(tmp_path / "in" / "5.wav", clicks(122, 22_050, 6.0))
    again = {r["id"]: r["outcome"].split(":")[0] for r in ingest.publish(spark, more, S.read_wav(spark, str(tmp_path / "in" / "*.wav")), str(tmp_path / "out")).collect()}
    assert again == got | {"1": "skipped", "5": "ready"}
    tracks, variants = merge.read_published(spark, str(tmp_path / "out" / "catalog"))
    assert {r["id"] for r in tracks.collect()} == {"1", "5"} == {r["track_id"] for r in variants.collect()}
    with_gate = ingest.publish(spark, seed, S.read_wav(spark, str(tmp_path / "in" / "*.wav")), str(tmp_path / "out2"), gate=F.col("id") == "3")
    assert {r["id"] for r in with_gate.collect()} == {"2", "3", "4"}
    merge.publish_tracks(tracks, variants.limit(0), str(tmp_path / "out3"))  # a table without any variant can be read
    assert merge.read_published(spark, str(tmp_path / "out3"))[1].count() == 0


def test_snapshots_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert snapshots.read_snapshot(spark, path, ["a", "b"]) is None
    assert [snapshots.write_snapshot(spark, path, {"a": rows(n), "b": rows(n)}) for n in range(3)] == [0, 1, 2]
    rows(9).write.parquet(f"{path}/v=3/a")  # a run that died
    found = snapshots.read_snapshot(spark, path, ["a", "b"])
    assert found["a"].first()["id"] == found["b"].first()["id"] == 2
    assert snapshots.read_snapshot(spark, path, ["a", "b"], 1)["a"].first()["id"] == 1
    snapshots.drop_snapshots(spark, path, "b")
    assert snapshots.numbers(spark, path) == [1, 2, 3] and snapshots.numbers(spark, path, "b") == [1, 2]


def test_buckets_rewrite_what_is_touched(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = spark.range(20_000).selectExpr("cast(id AS string) AS id", "cast(id AS int) AS v")
    new = lambda **x: spark.createDataFrame(list(x.items()), "id string, v int")
    merge_ = lambda current, incoming: current.join(incoming, "id", "left_anti").unionByName(incoming)
    assert buckets.read_version(spark, path) is None
    assert buckets.upsert(table, path, ["id"], merge_, 256)[0] == 0
    version, rewritten = buckets.upsert(spark.range(0, 20_000, 1000).selectExpr("cast(id AS string) AS id", "-1 AS v"), path, ["id"], merge_)  # 0.1 % of the rows
    assert version == 1 and 0 < rewritten <= 20 < 0.1 * 256
    got = {r["id"]: r["v"] for r in buckets.read_version(spark, path).collect()}
    assert len(got) == 20_000 and got["3000"] == -1 and got["3001"] == 3001 and buckets.read_version(spark, path, 0).filter("v < 0").count() == 0
    # another writer is faster between reading the manifest and putting the new one
    put, races = buckets._put, []

    def late(s, p, n, content):
        if not races:
            races.append(n)
            buckets.upsert(new(**{"5": 100, "a": 1}), path, ["id"], merge_)
        return put(s, p, n, content)

    monkeypatch.setattr(buckets, "_put", late)
    assert buckets.upsert(new(**{"5": 200, "b": 2}), path, ["id"], merge_)[0] == 3 and races == [2]
    got = {r["id"]: r["v"] for r in buckets.read_version(spark, path).collect()}
    assert got["5"] == 200 and got["a"] == 1 and got["b"] == 2 and len(got) == 20_002
    monkeypatch.setattr(buckets, "_put", lambda *x: False)
    with pytest.raises(RuntimeError):
        buckets.upsert(new(c=1), path, ["id"], merge_)
    monkeypatch.undo()
    (tmp_path / "t" / "manifests" / "_writing-x").write_text("")  # of a writer that died
    buckets.drop_versions(spark, path, 1)
    assert buckets.versions(spark, path) == [3] and buckets.read_version(spark, path).count() == 20_002
    assert buckets._put(spark, path, 4, {}) and not buckets._put(spark, path, 4, {})
    assert buckets.upsert(table.limit(0), str(tmp_path / "e"), ["id"], merge_)[0] == 0 and buckets.read_version(spark, str(tmp_path / "e")).count() == 0


def test_latency_log(spark, tmp_path):
    rows = A.latency(spark, SF)
    for _ in range(2):
        merge.append_latency(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * rows.count()


# streams


def test_streams(spark, tmp_path):
    A.latency(spark, SF).write.parquet(str(tmp_path / "latency"))
    batch = spark.read.parquet(str(tmp_path / "latency"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "latency"))
    q = ST.latency_windows(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, ST.latency_windows(batch, "1 hour").collect()))
    events = batch.select(F.col("track_id").alias("id"), F.element_at(F.array(F.lit("fetched"), F.lit("ready"), F.lit("failed")), (F.floor("ms") % 3 + 1).cast("int")).alias("kind"))
    events.write.parquet(str(tmp_path / "events"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ST.status_high_water(source).writeStream.outputMode("complete").format("memory").queryName("high").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("high").collect())) == sorted(map(tuple, ST.status_high_water(events).collect()))


def test_gestures_of_a_stream(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i, b, f"2024-01-01 {t}", n) for i, b, t, n in x], "id string, delta_beats int, at string, seq int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1)
    parts = [rows(("a", 4, "10:00:00", 1), ("a", 8, "10:00:20", 2), ("b", 1, "10:00:05", 3)), rows(("a", 12, "10:00:45", 4), ("a", 2, "11:00:00", 5)), rows(("b", 9, "10:00:30", 6), ("c", 7, "11:30:00", 7))]
    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        ST.gestures(stream, "30 seconds", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["id"], r["first_beats"], r["last_beats"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # b's second edit came after the watermark (10:50) and is dropped; c's gesture may still go on
    assert got == [("a", 2, 2, 1), ("a", 4, 12, 3), ("b", 1, 1, 1)]
    everything = parts[0].union(parts[1]).union(parts[2])
    assert {(r["id"], r["n"]) for r in ST.gestures(everything, "30 seconds").collect()} == {("a", 3), ("a", 1), ("b", 2), ("c", 1)}


def test_stuck_tracks_are_told_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    days = lambda *x: spark.createDataFrame([(i, k, f"2024-01-{d:02d} 00:00:00") for i, k, d in x], "id string, kind string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1)
    parts = [
        days(("a", "pending", 1), ("b", "fetched", 1), ("b", "ready", 2), ("c", "pending", 3), ("x", "odd", 3)), days(("c", "fetched", 12), ("a", "pending", 12), ("d", "analyzed", 13)),
        days(("d", "ready", 14), ("e", "pending", 20)), days(("a", "fetched", 21), ("f", "pending", 24)), days(("g", "pending", 29)),
    ]
    told = []
    for part in parts:  # every run starts from the checkpoint of the one before
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        ST.watch_stuck_tracks(stream, 5.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        told.append(sorted((r["id"], r["status"], r["since"].day) for r in spark.read.schema(ST.STUCK).parquet(str(tmp_path / "out")).collect()))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.union(part)
    assert told[-1] == sorted((r["id"], r["status"], r["since"].day) for r in ST.stuck_tracks(everything, 5.0).collect()) == [("a", "fetched", 21), ("a", "pending", 1), ("c", "fetched", 12), ("c", "pending", 3), ("e", "pending", 20)]
    assert ("a", "pending", 1) in told[1] and all(set(x) <= set(y) for x, y in zip(told, told[1:]))


def test_incremental_ingest(spark, tmp_path):
    t = A.tracks(spark, SF)
    t.filter("cast(id AS int) < 50").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    run = lambda: ST.start_incremental_ingest(stream(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    t.filter("cast(id AS int) BETWEEN 40 AND 90").withColumn("name", F.lit("new")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r["id"]: r["name"] for r in ST.read_ingested(spark, str(tmp_path / "out")).collect()}
    assert len(got) == t.filter("cast(id AS int) <= 90").count() and got["45"] == "new" and got["10"] != "new"


def test_ingest_keeps_the_furthest_status_and_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT_EVERY", 2)
    schema = "id string, name string, status string, status_error string, native_bpm double"
    batches = [[("1", "b", "pending", None, 120.0), ("1", "a", "analyzed", None, None), ("2", "x", "ready", "e", 1.0), ("2", "x", "ready", None, 2.0)], [("1", "c", "ready", None, None)], [("3", "n", "odd", None, None), ("2", "y", "ready", None, None)]]
    table = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ST.start_incremental_ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        one = spark.createDataFrame({0: rows[1:2] + rows[3:], 1: rows, 2: rows}[i], schema)
        table = one if table is None else merge.upsert_tracks(table, one)
        assert sorted(map(tuple, ST.read_ingested(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, table.collect()))
    assert snapshots.numbers(spark, str(tmp_path / "out" / "whole")) == [1]
    assert ("1", "c", "ready", None, None) in set(map(tuple, table.collect()))


def test_ingest_of_seed_rows(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    for name in ("1", "2"):
        write_wav(tmp_path / "audio" / f"{name}.wav", np.sin(np.arange(40_000) / 20) * 0.4)
    schema = "id string, name string, genre string, license string, bpm double"
    handed = []

    def publish(seed):
        handed.append(sorted(r["id"] for r in seed.collect()))
        out = ingest.publish(spark, seed, S.read_wav(spark, str(tmp_path / "audio" / "*.wav")), str(tmp_path / "lib"))
        status = F.when(F.col("outcome").isin("ready", "skipped: published already", "refused: no derivatives"), "ready").otherwise("pending")
        return out.join(seed, "id").select("id", "name", status.alias("status"), F.when(status == "pending", F.col("outcome")).alias("status_error"))

    for rows in ([("1", "one", "house", "CC BY 3.0", 124.0), ("9", "gone", "house", "CC0", 124.0)], [("1", "one", "house", "CC BY 3.0", 124.0), ("2", "two", "house", "CC BY 3.0", 120.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ST.start_incremental_ingest(stream, str(tmp_path / "out"), str(tmp_path / "check"), publish).awaitTermination()
    got = {r["id"]: (r["status"], r["status_error"]) for r in ST.read_ingested(spark, str(tmp_path / "out")).collect()}
    assert handed == [["1", "9"], ["2"]]
    assert got == {"1": ("ready", None), "2": ("ready", None), "9": ("pending", "quarantined: unknown licence")}
    tracks, variants = merge.read_published(spark, str(tmp_path / "lib" / "catalog"))
    assert {r["id"] for r in tracks.collect()} == {"1", "2"} == {r["track_id"] for r in variants.collect()}


def test_views_and_functions(spark):
    sqlfuncs.register_functions(spark)
    sqlfuncs.register_views({"tracks": A.tracks(spark, SF), "variants": A.variants(spark, SF)})
    assert spark.sql("SELECT count(*) FROM tracks JOIN variants ON id = track_id WHERE band_of(native_bpm) = 'house'").first()[0] > 0


# findings of round 3


def test_beat_phases_add_in_frame_order(spark):
    rng = np.random.default_rng(8)
    tracks = {str(t): rng.choice([0.1, 0.2, 0.3, 0.7], 60).tolist() for t in range(300)}
    period = 60.0 / 128.0 / 0.02
    want = {}
    for t, flux in tracks.items():
        sums = []
        for p in range(24):
            hits = [int(period * p / 24 + k * period) for k in range(max(1, math.ceil((60 - period * p / 24) / period)))]
            s = 0.0
            for f in hits:
                s += flux[f] if f < 60 else 0.0
            sums.append(s)
        want[t] = period * sums.index(max(sums)) / 24
    rows = [(t, i, x) for t, flux in tracks.items() for i, x in enumerate(flux)]
    frames = spark.createDataFrame(rows, "track_id string, frame_idx int, flux double").repartition(7)
    tempo = spark.createDataFrame([(t, 128.0) for t in tracks], "track_id string, bpm double")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as on a cluster: a series in several tasks
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = {r["track_id"]: r["offset"] for r in features.beat_grid(frames, tempo, 0.02).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == want


def test_pairs_scored_do_not_grow_with_the_square(spark):
    """Four times the tracks, far less than four times the pairs of each anchor."""
    per_anchor = []
    for n in (3000, 12000):
        seen = []
        matching.recommend(random_scalars(spark, n), seen=seen).write.format("noop").mode("overwrite").save()
        per_anchor.append(sum(o.get["n"] for o in seen) / n)
    assert per_anchor[1] < 1.5 * per_anchor[0]


def test_of_tracks_alike_only_as_many_as_a_list_holds_are_scored(spark):
    seen = []
    recs = matching.recommend(random_scalars(spark, 900, hot=900), k=5, seen=seen).collect()
    assert len(recs) == 5 * 900
    assert sum(o.get["n"] for o in seen) < 20 * 900


def test_driver_sees_no_names_of_files(spark, tmp_path, monkeypatch):
    """Objects are moved, listed and read in tasks: neither the writer's messages nor Spark's file index hold them."""
    rows = spark.range(500).selectExpr("concat('meta/', id, '.json') AS name", "cast(concat('{\"name\": \"n', id, '\"}') AS binary) AS content")
    FS.write_blobs(rows, str(tmp_path))
    assert FS.Written.__dataclass_fields__ == {} and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    (tmp_path / "meta" / "list.json").write_text('[{"name": "a"}, {"name": "b"}]')
    (tmp_path / "meta" / "empty.json").write_text("")
    (tmp_path / "meta" / "wide.json").write_bytes('{"name": "ü"}'.encode("utf-16"))
    got = S.read_sidecars(spark, str(tmp_path / "meta"))
    assert "FileScan json" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["name"]) for r in got.collect()) == sorted([(str(i), f"n{i}") for i in range(500)] + [("list", "a"), ("list", "b"), ("wide", "ü")])
    assert S.blob_inventory(spark, str(tmp_path), "meta/1").count() == 111 and S.blob_inventory(spark, str(tmp_path), "none/").count() == 0
    assert S.blob_inventory(spark, str(tmp_path)).first()["key"] == "meta/0.json"


def test_nodes_are_shuffled_once_for_order_and_twice_for_times(spark):
    """Tables of a size that is not broadcast: no join brings the nodes back after the fold, one join finds how long they last."""
    from cadenza.operators import chains

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sf = "/root/testdata/sf0.001"
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        nodes = A.mix_tracks(spark, sf).localCheckpoint()
        ordered, _ = chains.order_chains(A.mixes(spark, sf).localCheckpoint(), nodes)
        assert plan(ordered).count("SortMergeJoin") == 1
        flat = chains.flatten_chains(ordered.localCheckpoint(), A.variants(spark, sf).localCheckpoint(), A.tracks(spark, sf).localCheckpoint())
        assert plan(flat).count("SortMergeJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def method_sizes(df):
    """Bytes of the longest method that Spark generates for each part of the plan."""
    import contextlib
    import io
    import re

    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]


def test_scoring_is_short_enough_to_be_compiled(spark, monkeypatch):
    """The JVM interprets methods of more than 8,000 bytes: scoring a pair takes several times as long."""
    sizes = []

    def noted(df, name):
        sizes.append((name, method_sizes(df)))
        return stage(df, name)

    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan is generated part by part as it runs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(matching, "stage", noted)
    try:
        sizes.append(("result", method_sizes(matching.recommend(random_scalars(spark, 300)))))
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    assert len(sizes) > 8 and all(s and max(s) < 8000 for _, s in sizes), sizes


def test_beats_of_a_mix_end_with_it(spark):
    """The rest of a mix is as many whole beats as fit; a beat that rounding makes a little less than whole adds none."""
    short = next(b / 10 for b in range(700, 1800) if (60.0 / (b / 10)) * (b / 10) / 60.0 < 1)
    entries = spark.createDataFrame([(m, 0, m, 1.0 if m == "a" else 0.0) for m in "abcd"], "mix_id string, pos int, track_id string, offset_s double")
    tracks = spark.createDataFrame([("a", 120.0, [0.0, 0.5]), ("b", short, []), ("c", 120.0, []), ("d", 120.0, None)], "track_id string, bpm double, beat_grid array<double>")
    totals = spark.createDataFrame([("a", 2.6), ("b", 60.0 / short), ("c", 0.4), ("d", 9.0)], "mix_id string, total_s double")
    assert sorted(tuple(r) for r in chains.mix_beat_grid(entries, tracks, totals).collect()) == [("a", 1.0), ("a", 1.5), ("a", 2.0), ("a", 2.5)]
