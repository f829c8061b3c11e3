"""Tables that cut lineage: written once to the folder every executor shares, then read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_open: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    return _local[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _open.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_tables() -> Iterator[list[str]]:
    """The list that paths of tables staged inside the block go to, oldest first, for :func:`drop_staged`."""
    paths: list[str] = []
    token = _open.set(paths)
    try:
        yield paths
    finally:
        _open.reset(token)


def is_staged(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` is still there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_staged(spark: SparkSession, paths: list[str], keep: int = 0) -> None:
    """Delete all but the ``keep`` newest of the tables in ``paths``; call it once what reads them is written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while len(paths) > keep:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop(0))
        path.getFileSystem(hadoop).delete(path, True)
