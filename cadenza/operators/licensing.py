"""Licence compliance over the catalogue (L-01 to L-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D


def parse_license(df: DataFrame, column: str = "license") -> DataFrame:
    """Adds ``variant, version, jurisdiction, license_nd, license_sa, license_nc``; null for an unknown licence."""
    return df.withColumns(
        {"variant": X.licence_variant(column), "version": X.licence_version(column), "jurisdiction": X.licence_jurisdiction(column)} | {f"license_{f}": X.licence_flag(f, column) for f in ("nd", "sa", "nc")}
    )


def split_licenses(df: DataFrame, column: str = "license", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(known, quarantined). Unknown, blank and null licences are never given a default; ``strict`` makes them an error."""
    known = F.coalesce(F.col(column).rlike(D.LICENCE), F.lit(False))
    if strict:
        checked = F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown licence: "), F.coalesce(F.col(column), F.lit("null")))))
        return df.withColumn(column, checked.cast("string")), df.limit(0)
    return df.filter(known), df.filter(~known)


def attribution(df: DataFrame) -> DataFrame:
    """Adds ``attribution``: text, title, artist, licence, address and the line that is shown."""
    text = F.concat(F.lit("“"), "name", F.lit("” by "), "artist")
    shown = F.concat(text, F.lit(" — "), "license")
    return df.withColumn("attribution", F.struct(text.alias("text"), F.col("name").alias("title"), "artist", "license", X.license_url("license").alias("url"), shown.alias("line")))


def license_badges(df: DataFrame) -> DataFrame:
    """Adds ``badges``: the restrictions in the order ND, SA, NC."""
    each = [F.when(F.col(f"license_{f}"), f.upper()) for f in ("nd", "sa", "nc")]
    return df.withColumn("badges", F.filter(F.array(*each), lambda b: b.isNotNull()))


def gate_mixable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mixable, refused): no-derivatives tracks stay listed as ready, but without master and variants."""
    nd = F.coalesce(X.licence_flag("nd"), F.lit(True))
    refused = df.filter(nd).withColumns({"mixable": F.lit(False), "audio_key": F.lit(None).cast("string"), "status": F.lit("ready")})
    return df.filter(~nd).withColumn("mixable", F.lit(True)), refused


def gate_download(df: DataFrame, flag: str = "audiodownload_allowed") -> tuple[DataFrame, DataFrame]:
    """(allowed, rejected with ``reason``); a missing flag means no."""
    allowed = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(allowed), df.filter(~allowed).withColumn("reason", F.lit("download not allowed"))


def accept(df: DataFrame, gate: Column) -> DataFrame:
    """Rows that a caller's condition admits, applied before any job that reads audio."""
    return df.filter(F.coalesce(gate, F.lit(False)))
