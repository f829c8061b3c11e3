"""Numbered snapshots of tables that belong together, in a folder of any file system Spark knows.

The tables of a snapshot are written one after another below ``v=<number>``; it counts once the
last of them is whole, which its success mark tells in one step. Readers take the newest
snapshot that counts, so they never see a part of one, and a run that dies leaves the one
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def numbers(spark: SparkSession, path: str, last: str | None = None) -> list[int]:
    """Numbers below ``path`` in order; with ``last``, those whose table of this name is whole."""
    files, at = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [n for n in found if last is None or files.exists(_files(spark, f"{path}/v={n}/{last}/_SUCCESS")[1])]


def write_snapshot(spark: SparkSession, path: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, number: int | None = None) -> int:
    """Write ``tables`` in their order as the next snapshot (or as ``number``, again if it is there); returns its number.

    Tables may read the snapshot before. One writer at a time."""
    n = max(numbers(spark, path), default=-1) + 1 if number is None else number
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        columns = (partition_by or {}).get(name)
        (writer.partitionBy(*columns) if columns else writer).parquet(f"{path}/v={n}/{name}")
    return n


def read_snapshot(spark: SparkSession, path: str, names: list[str], number: int | None = None, schemas: dict[str, str] | None = None) -> dict[str, DataFrame] | None:
    """The tables of the newest snapshot whose last table is whole (up to ``number``), or None.

    Tables that may be empty and are partitioned need their schema: such a table has no file to tell it."""
    whole = [n for n in numbers(spark, path, names[-1]) if number is None or n <= number]
    reader = lambda name: spark.read.schema(schemas[name]) if schemas and name in schemas else spark.read
    return {name: reader(name).parquet(f"{path}/v={whole[-1]}/{name}") for name in names} if whole else None


def drop_snapshots(spark: SparkSession, path: str, last: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` snapshots that count, and what dead runs left before these."""
    whole = numbers(spark, path, last)[-keep:]
    for n in numbers(spark, path):
        if whole and n < whole[0]:
            files, at = _files(spark, f"{path}/v={n}")
            files.delete(at, True)


def drop_before(spark: SparkSession, path: str, number: int) -> None:
    """Delete the snapshots with a smaller number."""
    for n in numbers(spark, path):
        if n < number:
            files, at = _files(spark, f"{path}/v={n}")
            files.delete(at, True)
