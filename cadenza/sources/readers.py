"""Sources and sinks (S-01 to S-07)."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import dimensions as D
from . import files as FS

SEED = "mode string, tracks array<struct<id:string,name:string,artist:string,genre:string,bpm:double,key:string,license:string,duration_s:double>>"
ENVELOPE = "headers struct<code:int,error_message:string>, results array<struct<id:string,name:string,artist_name:string,license_ccurl:string,audiodownload_allowed:boolean,audiodownload:string>>"


def read_catalog_seed(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of a JSON document with ``mode`` and ``tracks``."""
    return spark.read.option("multiLine", True).schema(SEED).json(path).select("mode", F.explode("tracks").alias("t")).select("mode", "t.*")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``id`` (from the file name) and the fields of each metadata file; unreadable files are left out."""
    listed = FS.list_files(spark, path, deep=False).filter(F.endswith("path", F.lit(".json"))).select("path")
    rows = FS.read_texts(spark, listed, path).withColumn("t", F.explode(F.from_json("text", "array<struct<name:string,artist:string,genre:string,license:string>>")))
    return rows.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("id"), "t.*")


def flatten_api_responses(df: DataFrame, json_col: str, asked: str | None = None) -> DataFrame:
    """Each response as rows: ``outcome`` is error (with ``error``), retry (fewer results than were ``asked`` for,
    or none) or ok with a track's fields. A short response is never proof that what it lacks is gone."""
    rows = df.withColumn("e", F.from_json(json_col, ENVELOPE)).withColumn("code", F.coalesce("e.headers.code", F.lit(0)))
    n = F.coalesce(F.when(F.size("e.results") > 0, F.size("e.results")), F.lit(0))
    least = F.lit(1) if asked is None else F.greatest(F.coalesce(F.col(asked), F.lit(1)), F.lit(1))
    outcome = F.when(F.col("code") != 0, "error").when(n < least, "retry").otherwise("ok")
    rows = rows.withColumn("outcome", outcome).withColumn("r", F.explode_outer(F.when(F.col("outcome") == "ok", F.col("e.results"))))
    return rows.select(
        *df.columns, "outcome", F.when(F.col("outcome") == "error", F.coalesce("e.headers.error_message", F.lit("no message"))).alias("error"), "r.id", "r.name", F.col("r.artist_name").alias("artist"),
        F.when(F.col("r.id").isNotNull(), X.license_from_url("r.license_ccurl")).alias("license"), F.when(F.col("r.id").isNotNull(), F.coalesce("r.audiodownload_allowed", F.lit(False))).alias("allowed"),
    )


def read_wav(spark: SparkSession, glob: str) -> DataFrame:
    """``track_id, sr, n_samples, duration_s, samples, error``: 16-bit files as mono numbers in [-1, 1]; one that can't be read has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                row = {"track_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "sr": None, "n_samples": None, "duration_s": None, "samples": None, "error": None}
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768.0
                        row |= {"sr": w.getframerate(), "n_samples": len(x), "duration_s": len(x) / w.getframerate(), "samples": x}
                except (wave.Error, EOFError, ValueError) as e:
                    row["error"] = str(e) or type(e).__name__
                yield pd.DataFrame([row]).astype({"sr": "Int32", "n_samples": "Int64", "duration_s": "Float64"})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "track_id string, sr int, n_samples long, duration_s double, samples array<double>, error string")


def blob_inventory(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``key, size`` of the objects below ``root`` that start with ``prefix``, in order; contents are not read."""
    folder = prefix.rpartition("/")[0]
    whole = root.rstrip("/")
    files = FS.list_files(spark, f"{whole}/{folder}" if folder and FS.exists(f"{whole}/{folder}") else whole)  # other folders are not listed
    key = F.expr(f"substring(path, {len(FS.place_of(whole)) + 2})")
    return files.select(key.alias("key"), "size").filter(F.startswith("key", F.lit(prefix))).orderBy("key")


def with_object_keys(df: DataFrame, codec: str) -> DataFrame:
    """Adds the keys of master, source and metadata of each ``id``, and the media type; an unknown codec is an error."""
    if codec not in D.CODECS:
        raise ValueError(f"codec must be one of {', '.join(sorted(D.CODECS))}, not {codec!r}")
    ext, mime = D.CODECS[codec]
    key = lambda a, z: F.concat(F.lit(a), "id", F.lit(z))
    return df.withColumns({"master_key": key("audio/", f".{ext}"), "source_key": key("audio/", ".wav"), "meta_key": key("meta/", ".json"), "mime": F.lit(mime)})


def variant_key(track_id: str, grid_bpm: str, codec: str):
    """Column with the key of a variant."""
    return F.concat(F.lit("variants/"), track_id, F.lit("_"), F.col(grid_bpm).cast("int").cast("string"), F.lit(f".{D.CODECS[codec][0]}"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A new snapshot in place of the old one; ``df`` must not read ``path``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
