"""The adapters of ``sources.adapters`` as DuckDB SQL, for the checks of the queries."""

from __future__ import annotations

import re

from ..functions import dimensions as D

_bands = ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in D.BANDS.items())
_variants = ", ".join(f"('{k}', {bool(nd)}, {bool(sa)}, {bool(nc)})".lower().replace(f"'{k.lower()}'", f"'{k}'") for k, (nd, sa, nc) in D.VARIANTS.items())
_roles = lambda table: ", ".join(f"('{k}', {v})" for k, v in table.items())

R4 = lambda x, d=4: f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"

VIEWS = {
    "bands": f"SELECT * FROM (VALUES {_bands}) AS t(band, lo, hi)",
    "exits": f"SELECT * FROM (VALUES {_roles(D.EXIT_ROLES)}) AS t(label, w)",
    "entries_roles": f"SELECT * FROM (VALUES {_roles(D.ENTRY_ROLES)}) AS t(label, w)",
    "licence_flags": f"SELECT * FROM (VALUES {_variants}) AS t(variant, nd, sa, nc)",
    "raw_tracks": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS artist,
            CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN lower(p_type)
                ELSE (SELECT band FROM bands WHERE 66.0::DOUBLE + ((p_partkey * 37) % 1220) / 10.0::DOUBLE >= lo - 0.5 AND 66.0::DOUBLE + ((p_partkey * 37) % 1220) / 10.0::DOUBLE < hi + 0.5) END AS genre,
            (['CC BY 3.0', 'CC BY-SA 3.0', 'CC BY-NC 4.0', 'CC BY-ND 3.0', 'CC BY-NC-SA 2.5', 'CC BY-NC-ND 3.0', 'CC BY-SA 2.0 UK', 'CC0'])[p_partkey % 8 + 1] AS license,
            66.0::DOUBLE + ((p_partkey * 37) % 1220) / 10.0::DOUBLE AS native_bpm,
            CAST(p_partkey % 12 + 1 AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS camelot,
            30.0::DOUBLE + ((p_partkey * 17) % 2400) / 10.0::DOUBLE AS duration_s,
            CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS popularity,
            CASE p_partkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'fetched' WHEN 2 THEN 'analyzed' ELSE 'ready' END AS status,
            CASE WHEN p_partkey % 10 = 1 AND p_partkey % 3 = 0 THEN 'boom' END AS status_error
        FROM part""",
    "parsed": r"""
        SELECT r.*, nullif(regexp_extract(license, '^CC (BY(?:-NC)?(?:-SA|-ND)?) (1\.0|2\.0|2\.5|3\.0|4\.0)(?: ([A-Z]{2}))?$', 1), '') AS variant,
            nullif(regexp_extract(license, '^CC (BY(?:-NC)?(?:-SA|-ND)?) (1\.0|2\.0|2\.5|3\.0|4\.0)(?: ([A-Z]{2}))?$', 2), '') AS version,
            nullif(regexp_extract(license, '^CC (BY(?:-NC)?(?:-SA|-ND)?) (1\.0|2\.0|2\.5|3\.0|4\.0)(?: ([A-Z]{2}))?$', 3), '') AS jurisdiction
        FROM raw_tracks r""",
    "tracks": """
        SELECT p.id, name, artist, genre, license, native_bpm, camelot, duration_s, popularity, status, status_error,
            nd AS license_nd, sa AS license_sa, nc AS license_nc, NOT nd AS mixable, CASE WHEN NOT nd THEN 'audio/' || p.id || '.m4a' END AS audio_key
        FROM parsed p JOIN licence_flags USING (variant)""",
    "banded": """
        SELECT t.*, coalesce(own.band, derived.band) AS band
        FROM tracks t LEFT JOIN bands own ON own.band = genre LEFT JOIN bands derived ON native_bpm >= derived.lo - 0.5 AND native_bpm < derived.hi + 0.5""",
    "points": f"SELECT band, CAST(unnest(range(lo, hi + 1, {D.GRID_SPACING})) AS INTEGER) AS g FROM bands",
    "variant_plan": f"""
        SELECT id AS track_id, g AS grid_bpm, g / native_bpm AS ratio, 'variants/' || id || '_' || g || '.m4a' AS object_key, duration_s / (g / native_bpm) AS duration_s
        FROM banded JOIN points USING (band) WHERE mixable AND abs(g / native_bpm - 1) <= {D.MOST_STRETCH}""",
    "variants": "SELECT * FROM variant_plan WHERE (CAST(track_id AS BIGINT) + grid_bpm) % 17 <> 0",
    "grids": "SELECT track_id AS id, list(grid_bpm ORDER BY grid_bpm) AS grid FROM variants GROUP BY track_id",
    "frames": """
        SELECT CAST(user_id AS VARCHAR) AS track_id, CAST(row_number() OVER w - 1 AS INTEGER) AS frame_idx, value AS rms,
            coalesce(greatest(value - lag(value) OVER w, 0), 0) AS flux, CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS bass_ratio
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "lines": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem""",
    "mix_tracks": """
        SELECT l_orderkey || '-' || p AS id, CAST(l_orderkey AS VARCHAR) AS mix_id, CAST(l_partkey AS VARCHAR) AS track_id, CASE WHEN p < n THEN l_orderkey || '-' || (p + 1) END AS next_id,
            CASE WHEN p = 1 THEN 0 ELSE CAST(trunc(l_quantity) AS INTEGER) * 4 END AS delta_beats, CAST(120 + 5 * (l_orderkey % 2) AS INTEGER) AS grid_bpm, p - 1 AS pos, n FROM lines""",
    "mixes": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'mix ' || o_orderkey AS name, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN o_orderkey || '-1' END AS head_id,
            CAST(epoch(o_orderdate) AS DOUBLE) AS created_at, CAST(epoch(o_orderdate) AS DOUBLE) AS updated_at FROM orders""",
    "chains": """
        SELECT m.mix_id, CAST(m.pos AS INTEGER) AS pos, m.id, m.track_id, m.delta_beats, m.delta_beats * 60.0::DOUBLE / m.grid_bpm AS delta_s,
            sum(m.delta_beats * 60.0::DOUBLE / m.grid_bpm) OVER (PARTITION BY m.mix_id ORDER BY m.pos) AS offset_s, m.grid_bpm, coalesce(nullif(v.duration_s, 0), nullif(t.duration_s, 0), 0) AS duration_s
        FROM mix_tracks m JOIN mixes x ON x.id = m.mix_id LEFT JOIN variants v ON v.track_id = m.track_id AND v.grid_bpm = m.grid_bpm LEFT JOIN tracks t ON t.id = m.track_id""",
    "inventory": """
        SELECT audio_key AS key, CAST(floor(duration_s * 8000) AS BIGINT) AS size FROM tracks WHERE audio_key IS NOT NULL AND CAST(id AS BIGINT) % 13 <> 0
        UNION ALL SELECT object_key, CAST(floor(duration_s * 8000) AS BIGINT) FROM variants WHERE CAST(track_id AS BIGINT) % 13 <> 0
        UNION ALL SELECT 'stray/' || i, 1 FROM range(10) t(i)""",
    "seed": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS BIGINT) AS ordinal FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'seed-' || i, i + 1000000000 FROM range(1, 11) t(i)""",
    "latency": "SELECT event_type AS stage, CAST(user_id AS VARCHAR) AS track_id, value AS ms, ts AS at FROM events",
    # segmentation, step by step (smoothing width 2, least gap 12 frames at a hop of 0.25 s)
    "shares": "SELECT *, rms / (max(rms) OVER (PARTITION BY track_id) + 1e-12) AS r, flux / (max(flux) OVER (PARTITION BY track_id) + 1e-12) AS f FROM frames",
    "blended": """
        SELECT *, sum(r) OVER w / 2 + 0.5 * (sum(f) OVER w / 2) AS feature FROM shares WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
    "slopes": """
        SELECT *, abs(CASE WHEN lag(feature) OVER w IS NULL AND lead(feature) OVER w IS NULL THEN 0 WHEN lag(feature) OVER w IS NULL THEN lead(feature) OVER w - feature
            WHEN lead(feature) OVER w IS NULL THEN feature - lag(feature) OVER w ELSE (lead(feature) OVER w - lag(feature) OVER w) / 2 END) AS slope
        FROM blended WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)""",
    "novel": """
        SELECT *, floor(sum(slope) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 * 1e9 + 0.5) / 1e9 AS novelty FROM slopes""",
    "changes": "SELECT track_id, frame_idx, novelty, coalesce(CAST(novelty <> lag(novelty) OVER (PARTITION BY track_id ORDER BY frame_idx) AS INTEGER), 0) AS c FROM novel",
    "numbered": "SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM changes",
    "runs": "SELECT track_id, run, min(frame_idx) AS a, max(frame_idx) AS b, any_value(novelty) AS height FROM numbered GROUP BY track_id, run",
    "peaks": """
        SELECT track_id, CAST((a + b) // 2 AS INTEGER) AS frame_idx, height
        FROM (SELECT *, lag(height) OVER w AS p, lead(height) OVER w AS q FROM runs WINDOW w AS (PARTITION BY track_id ORDER BY run)) WHERE p < height AND q < height""",
    "ranked_peaks": "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY height DESC, frame_idx DESC) AS k FROM peaks",
    "walk": """
        SELECT track_id, k, frame_idx, [frame_idx] AS kept, [height] AS heights FROM ranked_peaks WHERE k = 1
        UNION ALL SELECT p.track_id, p.k, p.frame_idx, CASE WHEN len(list_filter(kept, lambda y: abs(y - p.frame_idx) < 12)) > 0 THEN kept ELSE list_append(kept, p.frame_idx) END, heights
        FROM walk w JOIN ranked_peaks p ON p.track_id = w.track_id AND p.k = w.k + 1""",
    "lengths": "SELECT track_id, CAST(count(*) AS INTEGER) AS n FROM frames GROUP BY track_id",
    "bounds": """
        SELECT track_id, 0 AS b FROM lengths UNION SELECT track_id, n FROM lengths
        UNION SELECT track_id, f FROM (SELECT track_id, unnest(arg_max(kept, k)[1:7]) AS f FROM walk GROUP BY track_id) JOIN lengths USING (track_id) WHERE n >= 16 AND f > 0 AND f < n - 1""",
    "cuts": """
        SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY b) - 1 AS INTEGER) AS seg_idx, b AS start_frame, e AS end_frame
        FROM (SELECT track_id, b, lead(b) OVER (PARTITION BY track_id ORDER BY b) AS e FROM bounds) WHERE e IS NOT NULL""",
    "segs": f"""
        SELECT track_id, seg_idx, CASE WHEN max(end_frame) OVER p < 16 THEN 'full' WHEN seg_idx = 0 THEN 'intro' WHEN seg_idx = count(*) OVER p - 1 THEN 'outro' WHEN e <= quantile_cont(e, 0.33) OVER p THEN 'breakdown' WHEN e >= quantile_cont(e, 0.66) OVER p THEN 'drop' ELSE 'verse' END AS label,
            start_frame, end_frame, e AS energy
        FROM (SELECT c.track_id, seg_idx, start_frame, end_frame, {R4('avg(rms)', 9)} AS e FROM cuts c JOIN frames f ON f.track_id = c.track_id AND f.frame_idx >= start_frame AND f.frame_idx < end_frame GROUP BY ALL) WINDOW p AS (PARTITION BY track_id)""",
    # whose series stand for those of a track
    "owned": "SELECT id AS track_id, CAST(CAST(id AS BIGINT) % (SELECT count(DISTINCT user_id) FROM events) AS VARCHAR) AS owner FROM raw_tracks",
}


def sql(body: str, recursive: bool = False) -> str:
    """``body`` after the views that it and they need, in order."""
    needed: list[str] = []
    begun: set[str] = set()  # a view may name itself

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) and name not in begun:
                begun.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    start = "WITH RECURSIVE" if recursive or "walk" in needed else "WITH"
    body = body.lstrip()
    if body.startswith("WITH"):
        return f"{start} {views}, {body[4:]}" if views else body
    return f"{start} {views}\n{body}" if views else body

