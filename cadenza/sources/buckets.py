"""Tables in hash buckets with a manifest: an update rewrites the buckets it touches and no other.

``data/<run>/bucket=<k>`` holds a bucket as one run wrote it; ``manifests/<n>.json`` names the
folder of every bucket of version ``n``. A version counts once its manifest is there. A manifest
is created only if there is none of its number, so of two writers that start from one version
one wins; the other merges again with what the winner left. Readers keep to the manifest they
read, whose folders stay until :func:`drop_versions`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import _files

BUCKETS, ATTEMPTS = 256, 10


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, f"{path}/manifests")
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict | None:
    """The manifest of a version; None for one that is not whole."""
    files, at = _files(spark, f"{path}/manifests/{version}.json")
    stream = files.open(at)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text[:-1]) if text.endswith("\n") else None


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(number, manifest) of ``version`` or the newest; -1 and an empty one if there is none."""
    for n in reversed(versions(spark, path)):
        if (version is None or n <= version) and (found := _manifest(spark, path, n)):
            return n, found
    return -1, {}


def _put(spark: SparkSession, path: str, version: int, content: dict) -> bool:
    """Give ``version`` its manifest, written aside and then renamed where none is; False if another writer was first.

    On a store whose renames are atomic a manifest is whole or not there, and one writer wins."""
    files, at = _files(spark, f"{path}/manifests/{version}.json")
    _, aside = _files(spark, f"{path}/manifests/_writing-{uuid.uuid4().hex}")
    out = files.create(aside, False)
    try:
        out.write(bytearray((json.dumps(content) + "\n").encode()))
    finally:
        out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(aside, at, never_over)
    except Py4JJavaError:
        files.delete(aside, False)
        if files.exists(at):
            return False
        raise
    return True


def _write(df: DataFrame, path: str, keys: list[str], n: int, tasks: int) -> dict[str, str]:
    """Write the rows of ``df`` by bucket; returns the folder of each bucket that has rows."""
    spark, run = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    df.withColumn("bucket", bucket_of(keys, n)).repartition(tasks, "bucket").write.partitionBy("bucket").parquet(run)
    files, at = _files(spark, run)
    return {f.getPath().getName().split("=")[1]: f"{run}/{f.getPath().getName()}" for f in files.listStatus(at) if f.getPath().getName().startswith("bucket=")}


def read_version(spark: SparkSession, path: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The table as of ``version`` (default: the newest), or those of its ``buckets``; None if there is none."""
    n, found = manifest(spark, path, version)
    if n < 0:
        return None
    schema = T.StructType.fromJson(found["schema"])
    folders = [folder for k, folder in found["buckets"].items() if buckets is None or int(k) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(incoming: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], n_buckets: int = BUCKETS) -> tuple[int, int]:
    """Merge ``incoming`` into the table at ``path``; ``merge(current, incoming)`` gets the rows of the touched buckets and must
    keep every row in its bucket (that is, its ``keys``). Returns the new version and how many buckets were rewritten.

    The first upsert makes the table, with ``n_buckets``. Rows with null keys have a bucket like others. A writer
    that loses a race merges again; after :data:`ATTEMPTS` lost races in a row it gives up."""
    spark = incoming.sparkSession
    for _ in range(ATTEMPTS):
        version, found = manifest(spark, path)
        n = found.get("n", n_buckets)
        if version < 0:
            folders, touched = _write(incoming, path, keys, n, min(n, 64)), set()
            content = {"n": n, "schema": incoming.schema.jsonValue(), "buckets": folders}
            rewritten = len(folders)
        else:
            touched = {r[0] for r in incoming.select(bucket_of(keys, n)).distinct().collect()}  # no more than buckets
            merged = merge(read_version(spark, path, version, touched), incoming)
            folders = _write(merged, path, keys, n, max(1, min(len(touched), 64))) if touched else {}
            stay = {k: folder for k, folder in found["buckets"].items() if int(k) not in touched}
            content = found | {"buckets": stay | folders}
            rewritten = len(touched)
        if _put(spark, path, version + 1, content):
            return version + 1, rewritten
    raise RuntimeError(f"{ATTEMPTS} writers in a row were faster at {path}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and the folders of buckets that only older ones name.

    What a writer has written whose manifest isn't there yet is never touched: only what dropped versions named goes."""
    numbers = versions(spark, path)
    old, kept = numbers[:-keep], numbers[-keep:]
    named = lambda ns: {folder for n in ns if (m := _manifest(spark, path, n)) for folder in m["buckets"].values()}
    for folder in named(old) - named(kept):
        files, at = _files(spark, folder)
        files.delete(at, True)
    for n in old:
        files, at = _files(spark, f"{path}/manifests/{n}.json")
        files.delete(at, False)
