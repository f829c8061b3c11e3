"""Column expressions; each works on whole tables inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dimensions as D


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def choose(key: Column, table: dict, default=None) -> Column:
    """The value that a small fixed table has for ``key``."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def round_up_half(x: Column, digits: int) -> Column:
    """Halves up on the binary value, so that every engine agrees."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


# licences


def licence_variant(licence: str | Column = "license") -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(licence), F.lit("")), D.LICENCE, 1), F.lit(""))


def licence_version(licence: str | Column = "license") -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(licence), F.lit("")), D.LICENCE, 2), F.lit(""))


def licence_jurisdiction(licence: str | Column = "license") -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(licence), F.lit("")), D.LICENCE, 3), F.lit(""))


def licence_flag(flag: str, licence: str | Column = "license") -> Column:
    """``nd``, ``sa`` or ``nc``; null for what is no known licence."""
    at = ("nd", "sa", "nc").index(flag)
    return choose(licence_variant(licence), {k: bool(v[at]) for k, v in D.VARIANTS.items()}).cast("boolean")


def license_url(licence: str | Column = "license") -> Column:
    """Canonical address of a licence; null for an unknown one."""
    parts = F.concat_ws("/", licence_variant(licence), licence_version(licence), licence_jurisdiction(licence))
    return F.when(licence_variant(licence).isNotNull(), F.concat(F.lit("https://creativecommons.org/licenses/"), F.lower(parts), F.lit("/")))


def license_from_url(url: str | Column) -> Column:
    """Licence name for an address that holds a known licence path; null if none."""
    url = F.coalesce(col(url), F.lit(""))
    part = lambda i: F.nullif(F.upper(F.regexp_extract(url, D.LICENCE_URL, i)), F.lit(""))
    return F.when(part(1).isNotNull(), F.concat_ws(" ", F.lit("CC"), part(1), part(2), part(3)))


# tempo


def band_of(bpm: str | Column) -> Column:
    """Band of a tempo, each half-open half a beat around its whole numbers; null outside."""
    out = F.lit(None).cast("string")
    for name, (low, high) in D.BANDS.items():
        out = F.when((col(bpm) >= low - 0.5) & (col(bpm) < high + 0.5), name).otherwise(out)
    return out


def resolve_band(genre: str | Column, bpm: str | Column) -> Column:
    """A label that names a band stays; anything else (``auto``, unknown, null) is derived."""
    return F.when(col(genre).isin(*D.BANDS), col(genre)).otherwise(band_of(bpm))


def grid_points(bpm: str | Column, band: str | Column) -> Column:
    """Grid tempos of the band within the stretch limit; empty without a band, an error for an unknown one."""
    all_points = F.array().cast("array<int>")
    for name, extent in D.BANDS.items():
        all_points = F.when(col(band) == name, F.array(*(F.lit(g) for g in D.grid_of(*extent)))).otherwise(all_points)
    known = col(band).isNull() | col(band).isin(*D.BANDS)
    points = F.filter(all_points, lambda g: F.abs(g / col(bpm) - 1) <= D.MOST_STRETCH)
    return F.when(known, points).otherwise(F.raise_error(F.concat(F.lit("unknown tempo band: "), col(band))).cast("array<int>"))


def shared_grid(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.array_intersect(col(a), col(b)))


def stretch_penalty(bpm: str | Column, grid: str | Column) -> Column:
    return F.least(F.lit(1.0), F.abs(col(grid) / col(bpm) - 1) / D.MOST_STRETCH)


# keys


def camelot_number(code: str | Column) -> Column:
    """Place of a key on the wheel of twelve."""
    return F.regexp_extract(col(code), r"^(\d+)", 1).cast("int")


def camelot_mode(code: str | Column) -> Column:
    return F.right(col(code), F.lit(1))


def camelot_score(a: str | Column, b: str | Column) -> Column:
    """Compatibility of two keys on the wheel of twelve."""
    return wheel_score(camelot_number(a), camelot_mode(a), camelot_number(b), camelot_mode(b))


def wheel_score(a_number: Column, a_mode: Column, b_number: Column, b_mode: Column) -> Column:
    """:func:`camelot_score` of keys taken apart already."""
    return score_apart(wheel_distance(a_number, b_number), a_mode == b_mode)


def wheel_distance(a_number: Column, b_number: Column) -> Column:
    """Steps between two places on the wheel, the shorter way round."""
    gap = F.abs(a_number - b_number)
    return F.least(gap, 12 - gap)


def score_apart(d: Column, same: Column) -> Column:
    """:func:`camelot_score` of keys ``d`` steps apart, of the ``same`` mode or not."""
    same_mode = F.when(d == 0, 1.0).when(d == 1, 0.8).when(d == 2, 0.4).otherwise(F.greatest(F.lit(0.0), 0.25 - 0.05 * (d - 3)))
    cross = F.when(d == 0, 0.8).when(d == 1, 0.35).otherwise(0.1)
    return F.when(same, same_mode).otherwise(cross)


def bpm_score(bpm_a: str | Column, bpm_b: str | Column, shared: str | Column) -> Column:
    """``struct<score, grid>``: the best shared tempo, the lower one on ties; (0, null) without any."""
    each = F.transform(
        col(shared), lambda g: F.struct((1.0 - D.BPM_PENALTY * (0.5 * (stretch_penalty(bpm_a, g) + stretch_penalty(bpm_b, g)))).alias("score"), (-g).alias("low"))
    )
    best = F.array_max(each)
    return F.struct(F.coalesce(best["score"], F.lit(0.0)).alias("score"), (-best["low"]).cast("int").alias("grid"))


def energy_continuity(outro: str | Column, intro: str | Column) -> Column:
    a, b = col(outro), col(intro)
    return 1.0 - F.least(F.lit(1.0), F.abs(a - b) / F.greatest(a, b, F.lit(1e-9)))


def role_weight(label: str | Column, side: str) -> Column:
    return choose(col(label), D.EXIT_ROLES if side == "exit" else D.ENTRY_ROLES, 0.0)


# beats and time


def beats_to_seconds(beats: str | Column, bpm: str | Column) -> Column:
    return F.coalesce(col(beats) * 60.0 / F.nullif(col(bpm), F.lit(0)), F.lit(0.0))


def seconds_to_beats(seconds: str | Column, bpm: str | Column) -> Column:
    """To the nearest beat, halves to even."""
    return F.coalesce(F.rint(col(seconds) * F.nullif(col(bpm), F.lit(0)) / 60.0), F.lit(0.0)).cast("int")


def time_label(seconds: str | Column) -> Column:
    """``m:ss`` or ``h:mm:ss``; negative, null and NaN are 0."""
    s = F.floor(F.when(F.isnan(col(seconds)) | col(seconds).isNull(), 0.0).otherwise(F.greatest(col(seconds), F.lit(0.0)))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def gain_at(t: Column, in_start: Column, in_end: Column, out_start: Column, out_end: Column) -> Column:
    """Equal-power gain: rises through the incoming zone, falls through the outgoing one; null or empty zones do nothing."""

    def part(start: Column, end: Column) -> Column:
        return F.when(end > start, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - start) / (end - start))))

    quarter = F.lit(3.141592653589793 / 2)
    rise = F.coalesce(F.sin(part(in_start, in_end) * quarter), F.lit(1.0))
    fall = F.coalesce(F.cos(part(out_start, out_end) * quarter), F.lit(1.0))
    return rise * fall
