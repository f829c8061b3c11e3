"""Table maintenance as new snapshots (M-01 to M-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dimensions as D
from ..sources import snapshots

ALWAYS = ["name", "artist", "genre", "license", "license_nd", "license_sa", "license_nc", "mixable", "status", "status_error"]


def _upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep_old_if_null: list[str], never: list[str] = ()) -> DataFrame:
    """Full outer join on ``keys``; incoming columns win, but for null ones of ``keep_old_if_null`` and all of ``never``."""
    a, b = current.withColumn("__old", F.lit(True)).alias("a"), incoming.withColumn("__new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    rows = a.join(b, on, "full_outer")
    new, old = F.col("b.__new").isNotNull(), F.col("a.__old").isNotNull()
    out = []
    for c in current.columns:
        if c in keys or c in keep_old_if_null:
            value = F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
        elif c in never:
            value = F.when(old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        else:
            value = F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        out.append(value.alias(c))
    return rows.select(out)


def upsert_tracks(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update by id: columns always supplied overwrite, others keep what they had where the new value is null."""
    return _upsert(current, incoming, ["id"], [c for c in current.columns if c not in (*ALWAYS, "id")])


def upsert_variants(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming row of a (track, tempo) wins."""
    both = current.withColumn("__age", F.lit(0)).unionByName(incoming.withColumn("__age", F.lit(1)))
    order = Window.partitionBy("track_id", "grid_bpm").orderBy(F.desc("__age"))
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__age", "__n")


def upsert_mixes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return _upsert(current, incoming, ["id"], [], ["created_at"])


def upsert_mix_tracks(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return _upsert(current, incoming, ["id"], [], ["mix_id"])


def apply_status_events(tracks: DataFrame, events: DataFrame) -> DataFrame:
    """``tracks`` after ``events (id, seq, kind, error, at)``, the fold of each track by ``seq``.

    ``kind``: a status (sets it, clears the error, stamps ``fetched_at``, ``analyzed_at`` or
    ``ready_at``), ``failed`` (sets the error, the status stays) or ``cleared`` (forgets the analysis).
    Later events win, so the last of each sort is all that counts.
    """
    status = F.col("kind").isin(*D.STATUSES)
    sets = F.when(status, F.struct("seq", "kind"))
    err = F.when(status | (F.col("kind") == "failed"), F.struct("seq", F.when(F.col("kind") == "failed", F.col("error")).alias("error")))
    at = lambda s: F.max_by("at", F.when(F.col("kind") == s, F.col("seq"))).alias(f"n_{s}")
    last = events.groupBy("id").agg(F.max(sets).alias("s"), F.max(err).alias("e"), F.count_if(F.col("kind") == "cleared").alias("cleared"), at("fetched"), at("analyzed"), at("ready"))
    rows = tracks.join(last, "id", "left")
    new = {"status": F.coalesce("s.kind", "status"), "status_error": F.when(F.col("e").isNotNull(), F.col("e.error")).otherwise(F.col("status_error"))}
    for s in ("fetched", "analyzed", "ready"):
        if f"{s}_at" in tracks.columns:
            new[f"{s}_at"] = F.coalesce(f"n_{s}", f"{s}_at")
    for c in ("native_bpm", "camelot"):
        new[c] = F.when(F.coalesce("cleared", F.lit(0)) == 0, F.col(c))
    return rows.withColumns(new).select(tracks.columns)


def apply_mix_edits(mixes: DataFrame, mix_tracks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mixes, mix_tracks) after ``edits (target, id, field, value, at)``: names, heads, gaps and links; a mix that
    was edited has its ``updated_at`` set. Of several edits of one field the latest counts."""
    last = edits.groupBy("target", "id", "field").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    m = last.filter("target = 'mix'").groupBy("id").agg(*(F.max(F.when(F.col("field") == f, F.struct(F.lit(1).alias("set"), F.col("value").alias("v")))).alias(f"e_{f}") for f in ("name", "head_id")), F.max("at").alias("e_at"))
    n = last.filter("target = 'node'").groupBy("id").agg(*(F.max(F.when(F.col("field") == f, F.struct(F.lit(1).alias("set"), F.col("value").alias("v")))).alias(f"e_{f}") for f in ("delta_beats", "next_id")))
    pick = lambda f, kind="string": F.when(F.col(f"e_{f}").isNotNull(), F.col(f"e_{f}.v").cast(kind)).otherwise(F.col(f))
    new_mixes = mixes.join(m, "id", "left").withColumns({"name": pick("name"), "head_id": pick("head_id"), "updated_at": F.coalesce("e_at", "updated_at")}).select(mixes.columns)
    new_nodes = mix_tracks.join(n, "id", "left").withColumns({"delta_beats": pick("delta_beats", "int"), "next_id": pick("next_id")}).select(mix_tracks.columns)
    return new_mixes, new_nodes


def delete_tracks(tracks: DataFrame, variants: DataFrame, mix_tracks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the tracks in ``ids (id)`` and what hangs on them."""
    gone = ids.select(F.col("id").alias("track_id")).distinct()
    return tracks.join(ids.select("id"), "id", "left_anti"), variants.join(gone, "track_id", "left_anti"), mix_tracks.join(gone, "track_id", "left_anti")


def delete_mixes(mixes: DataFrame, mix_tracks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return mixes.join(ids.select("id"), "id", "left_anti"), mix_tracks.join(ids.select(F.col("id").alias("mix_id")), "mix_id", "left_anti")


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose ``key`` is not among ``ids (id)``: nodes by id, nodes of mixes, variants of tracks."""
    return df.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def replace_chains(mixes: DataFrame, mix_tracks: DataFrame, new: DataFrame, variants: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mixes, mix_tracks, refused ``mix_id``) with the chains ``new (mix_id, pos, id, track_id, delta_beats, grid_bpm)``.

    Links and heads follow the positions. A chain in which a node reaches its second next one is refused."""
    from .chains import flatten_chains, overlap_violations

    bad = overlap_violations(flatten_chains(new, variants, tracks)).select("mix_id").distinct()
    good = new.join(bad, "mix_id", "left_anti")
    nodes = good.withColumn("next_id", F.lead("id").over(Window.partitionBy("mix_id").orderBy("pos")))
    heads = good.groupBy("mix_id").agg(F.min_by("id", "pos").alias("head"))
    kept = mix_tracks.join(heads.select("mix_id"), "mix_id", "left_anti").unionByName(nodes.select(mix_tracks.columns))
    rows = mixes.join(heads.withColumnRenamed("mix_id", "id"), "id", "left").withColumn("head_id", F.coalesce("head", "head_id")).select(mixes.columns)
    return rows, kept, bad


#: Columns of published variants; there may be none.
VARIANTS = "track_id string, ratio double, object_key string, duration_s double, grid_bpm int"


def publish_tracks(tracks: DataFrame, variants: DataFrame, path: str) -> int:
    """A new snapshot of both tables: variants first, and it counts once the tracks are whole.

    A reader has the old tables or the new ones, never a track without its variants; ``tracks``
    and ``variants`` may be made of the old ones. Returns the number of the snapshot."""
    return snapshots.write_snapshot(tracks.sparkSession, path, {"variants": variants, "tracks": tracks}, {"variants": ["grid_bpm"]})


def read_published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(tracks, variants) as last published, or None."""
    found = snapshots.read_snapshot(spark, path, ["variants", "tracks"], schemas={"variants": VARIANTS})
    return None if found is None else (found["tracks"], found["variants"])


def check_schema(df: DataFrame, expected: T.StructType | list[str]) -> DataFrame:
    """``df`` itself, or an error if its ordered column names differ."""
    names = expected.names if isinstance(expected, T.StructType) else list(expected)
    if df.columns != names:
        raise ValueError(f"columns are {df.columns}, the model has {names}")
    return df


def add_missing_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, null or by default; a column that may not be null needs a
    default unless the table is empty."""
    defaults = defaults or {}
    for field in schema.fields:
        if field.name not in df.columns:
            if not field.nullable and field.name not in defaults and not df.isEmpty():
                raise ValueError(f"{field.name} may not be null and has no default")
            df = df.withColumn(field.name, F.lit(defaults.get(field.name)).cast(field.dataType))
    return df


def append_latency(df: DataFrame, path: str) -> None:
    df.select("stage", "track_id", "ms", "at").write.mode("append").parquet(path)
