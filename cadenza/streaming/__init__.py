"""Structured Streaming jobs (ST-01 to ST-04); the aggregations work on batch tables too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import dimensions as D
from ..operators import merge
from ..sources import snapshots


#: A whole table is written after so many batches; between, only what arrives is.
COMPACT_EVERY = 16


def _progress(column: str = "status"):
    """How far a status is; unknown ones count as the first."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, D.STATUSES)), F.col(column)), F.lit(0).cast("long")), F.lit(1).cast("long"))


def read_ingested(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The track table that :func:`start_incremental_ingest` keeps below ``path``, after batch ``upto`` (default: the last).

    The newest whole table and the batches after it, folded by id in the way of
    :func:`merge.upsert_tracks`: one aggregation, however many batches there are."""
    whole = [n for n in snapshots.numbers(spark, f"{path}/whole", "tracks") if upto is None or n <= upto]
    later = [n for n in snapshots.numbers(spark, f"{path}/batches", "tracks") if (not whole or n > whole[-1]) and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{path}/whole/v={whole[-1]}/tracks").withColumn("__n", F.lit(-1))] if whole else []
    parts += [spark.read.parquet(f"{path}/batches/v={n}/tracks").withColumn("__n", F.lit(n)) for n in later]
    if not parts:
        return None
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    columns = [c for c in rows.columns if c not in ("id", "__n")]
    newest = lambda c: F.max_by(c, "__n") if c in merge.ALWAYS else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__n")))
    return rows.groupBy("id").agg(*(newest(c).alias(c) for c in columns)).select([c for c in parts[0].columns if c != "__n"])


def start_incremental_ingest(stream: DataFrame, path: str, checkpoint: str, publish: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge arriving track rows into the table below ``path``; a batch that is replayed changes nothing.

    ``publish`` turns the new seed rows of a batch into track rows, as :func:`ingest.publish`
    does (rows that are ready already are not handed to it); without it the stream has track
    rows. Of several rows of an id in a batch the one whose status is furthest counts, then
    that with an error less, then the name last in order. Each batch is written once under its number; every
    :data:`COMPACT_EVERY` batches the whole table is."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        if publish is not None:
            before = read_ingested(spark, path, n - 1)
            # of several seed rows of an id always the same one, so that a batch that is replayed publishes the same
            chosen = Window.partitionBy("id").orderBy(F.to_json(F.struct(*batch.columns)))
            new = batch.withColumn("__n", F.row_number().over(chosen)).filter("__n = 1").drop("__n")
            batch = publish(new if before is None else new.join(before.filter("status = 'ready'").select("id"), "id", "left_anti"))
        error = [F.col("status_error").isNotNull()] if "status_error" in batch.columns else []
        name = [F.desc("name")] if "name" in batch.columns else []
        order = Window.partitionBy("id").orderBy(F.desc(_progress()), *error, *name)
        last = batch.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
        snapshots.write_snapshot(spark, f"{path}/batches", {"tracks": last}, number=n)
        if (n + 1) % COMPACT_EVERY == 0:
            snapshots.write_snapshot(spark, f"{path}/whole", {"tracks": read_ingested(spark, path, n)}, number=n)
            # the whole table before this one stays, with the batches after it, for readers and for a batch that is replayed
            kept = snapshots.numbers(spark, f"{path}/whole", "tracks")[-2:]
            for folder in ("whole", "batches"):
                snapshots.drop_before(spark, f"{path}/{folder}", kept[0])

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """``stage, start, end, n, avg_ms, max_ms`` of ``events (stage, ms, at)`` per event-time window; rows later than ``lateness`` are dropped by a stream."""
    rows = events.withColumn("at", F.col("at").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", lateness)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    out = rows.groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))
    return out.select("stage", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "avg_ms", "max_ms")


def coalesce_edits(edits: DataFrame, size: str, lateness: str = "10 minutes") -> DataFrame:
    """``id, start, delta_beats``: the last value of each node in each window of ``edits (id, delta_beats, at, seq)``."""
    rows = edits.withColumn("at", F.col("at").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", lateness)
    out = rows.groupBy(F.window("at", size).alias("w"), "id").agg(F.max_by("delta_beats", F.struct("at", "seq")).alias("delta_beats"))
    return out.select("id", F.col("w.start").alias("start"), "delta_beats")


def gestures(edits: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """``id, start, end, first_beats, last_beats, n`` of each gesture in ``edits (id, delta_beats, at, seq)``: edits of a
    node less than ``gap`` apart. A stream returns a gesture once the watermark has passed its end; rows later than ``lateness`` are dropped."""
    rows = edits.withColumn("at", F.col("at").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", lateness)
    order = F.struct("at", "seq")
    out = rows.groupBy("id", F.session_window("at", gap).alias("w")).agg(F.min_by("delta_beats", order).alias("first_beats"), F.max_by("delta_beats", order).alias("last_beats"), F.count("*").alias("n"), F.max("at").alias("end"))
    return out.select("id", F.col("w.start").alias("start"), "end", "first_beats", "last_beats", "n")


def status_high_water(events: DataFrame) -> DataFrame:
    """``id, status, failed``: the furthest status of each track, whatever order ``events (id, kind)`` come in."""
    order = F.array_position(F.array(*map(F.lit, D.STATUSES)), F.col("kind"))
    out = events.groupBy("id").agg(F.max(order).alias("o"), F.max((F.col("kind") == "failed").cast("int")).alias("f"))
    return out.select("id", F.element_at(F.array(*map(F.lit, D.STATUSES)), F.greatest("o", F.lit(1)).cast("int")).alias("status"), (F.col("f") == 1).alias("failed"))


STUCK = "id string, status string, since timestamp"


def stuck_tracks(events: DataFrame, days: float, upto: datetime | None = None) -> DataFrame:
    """``id, status, since``: a row for each status short of ready that a track kept for more than ``days``.

    ``events (id, kind, at)`` in order of time; only those that take a track further count. What is
    still stuck is judged by ``upto``, by default the latest event of all."""
    order = F.array_position(F.array(*map(F.lit, D.STATUSES)), F.col("kind"))
    rows = events.withColumn("at", F.col("at").cast("timestamp")).withColumn("o", order).filter("o > 0")
    by_time = Window.partitionBy("id").orderBy("at", "o")
    reached = F.max("o").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.withColumn("before", reached).filter(F.col("before").isNull() | (F.col("o") > F.col("before")))
    now = F.lit(upto) if upto is not None else F.lit(events.agg(F.max(F.col("at").cast("timestamp"))).first()[0])
    until = F.coalesce(F.lead("at").over(by_time), now.cast("timestamp"))
    long = F.unix_micros(until) - F.unix_micros("at") > F.lit(int(days * 86_400_000_000))
    return steps.withColumn("long", long).filter(F.col("long") & (F.col("o") < len(D.STATUSES))).select("id", F.element_at(F.array(*map(F.lit, D.STATUSES)), F.col("o").cast("int")).alias("status"), F.col("at").alias("since"))


class Stuck(StatefulProcessor):
    """The furthest status of a track and when it was reached; a timer tells once that it lasts too long."""

    def __init__(self, days: float):
        self.limit = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getValueState("reached", "o int, since long, told boolean")

    def _row(self, key, o: int, since: int) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "status": [D.STATUSES[o - 1]], "since": [pd.Timestamp(since, unit="us")]})

    def _stop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        o, since, told = self.reached.get() if self.reached.exists() else (0, 0, False)
        steps = sorted((at, D.STATUSES.index(kind) + 1) for part in rows for at, kind in zip(part["us"], part["kind"], strict=True) if kind in D.STATUSES)
        for at, step in steps:
            if step > o:
                if o and not told and at - since > self.limit * 1000:  # it got on at last, before the watermark told
                    yield self._row(key, o, since)
                o, since, told = step, at, False
        self._stop()
        if o == len(D.STATUSES):
            self.reached.update((o, since, True))  # late rows of a finished track change nothing
        elif o:
            self.reached.update((int(o), int(since), bool(told)))
            if not told:
                self.handle.registerTimer(since // 1000 + self.limit + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.reached.exists():
            o, since, told = self.reached.get()
            if not told:
                self.reached.update((o, since, True))
                yield self._row(key, o, since)

    def close(self) -> None:
        pass


def watch_stuck_tracks(events: DataFrame, days: float, lateness: str = "1 hour") -> DataFrame:
    """:func:`stuck_tracks` of a stream of ``events (id, kind, at)``, each row as soon as the watermark tells.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = events.select("id", "kind", F.col("at").cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at")).withWatermark("at", lateness)
    return rows.groupBy("id").transformWithStateInPandas(Stuck(days), STUCK, "Append", "EventTime")
