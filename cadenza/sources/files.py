"""Files as a Python data source: sound in ranges of frames, headers alone, and a sink for whole objects.

Files are opened through ``pyarrow.fs``, so paths may be local or in any store it knows by URI.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import wave
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .staging import stage

#: Frames of a file that one task decodes.
RANGE = 1 << 20
HEADER = "track_id string, sr int, channels int, n_samples long, duration_s double, error string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    n: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.range, self.headers = options["path"], int(options.get("frames", RANGE)), options.get("headers", "false").lower() == "true"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Files of other tracks are not opened."""
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("track_id",):
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[Range]:
        files, root = _open(self.root)
        paths = sorted(f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.extension.lower() == "wav" and (self.wanted is None or _name(f.path) in self.wanted))
        if self.headers:
            return [Range(p, 0, 0) for p in paths]
        sizes = {f.path: f.size for f in files.get_file_info(paths)}
        # a frame has two bytes at least, so no range is missed; those past the end yield nothing
        return [Range(p, first, self.range) for p in paths for first in range(0, max(1, sizes[p] // 2), self.range)]

    def read(self, part: Range) -> Iterator[tuple]:
        files, _ = _open(self.root)
        try:
            with files.open_input_file(part.path) as raw, wave.open(raw) as w:
                n, sr, channels = w.getnframes(), w.getframerate(), w.getnchannels()
                head = (_name(part.path), sr, channels, n, n / sr)
                if self.headers:
                    yield (*head, None)
                elif part.first < n or part.first == 0:
                    if w.getsampwidth() != 2:
                        raise wave.Error(f"{8 * w.getsampwidth()} bits a sample, not 16")
                    w.setpos(part.first)
                    x = np.frombuffer(w.readframes(part.n), "<i2").reshape(-1, channels).mean(axis=1) / 32768.0
                    yield (*head, None, part.first, x.tolist())
        except (wave.Error, EOFError, ValueError) as e:
            if part.first == 0:
                yield (_name(part.path), None, None, None, None, str(e) or type(e).__name__, *(() if self.headers else (0, None)))


class WavSource(DataSource):
    """``wav``: 16-bit files below ``path`` as mono numbers in [-1, 1], a row per range of ``frames``; with ``headers`` a row per
    file, of which only the header is read. A file that can't be read has one row with its error."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADER if self.options.get("headers", "false").lower() == "true" else f"{HEADER}, first long, samples array<double>"

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(dict(self.options))


def _found(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """Path, size and whether it is a folder of what lies in ``folder``; one entry at a time where the store allows it."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for e in entries:
                yield e.path, 0 if e.is_dir() else e.stat().st_size, e.is_dir()
    else:
        for f in files.get_file_info(fs.FileSelector(folder)):
            yield f.path, f.size or 0, f.type == fs.FileType.Directory


def place_of(path: str) -> str:
    """``path`` as its store names it, and as :func:`list_files` begins paths."""
    return _open(path)[1].rstrip("/")


def exists(path: str) -> bool:
    files, place = _open(path)
    return files.get_file_info(place).type != fs.FileType.NotFound


def list_files(spark: SparkSession, root: str, deep: bool = True) -> DataFrame:
    """``path, size`` of the files in ``root`` and, if ``deep``, in the folders below it. Tasks list the folders, level by
    level; the driver sees neither names nor sizes. Names that begin with ``_`` or ``.`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                some: list[tuple[str, int, bool]] = []
                for path, size, is_folder in _found(files, folder):
                    if path.rsplit("/", 1)[-1][0] not in "_.":
                        some.append((path, size, is_folder))
                    if len(some) == 10_000:
                        yield _batch(some)
                        some = []
                yield _batch(some)

    def _batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["path", "size", "is_folder"])

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, found = spark.createDataFrame([(place_of(root),)], "path string"), None
    while True:
        level = stage(folders.mapInArrow(run, "path string, size long, is_folder boolean"), "listed")
        own = level.filter("NOT is_folder").select("path", "size")
        found = own if found is None else found.union(own)
        folders = level.filter("is_folder").select("path")
        if not deep or folders.isEmpty():
            return found
        folders = folders.repartition(spread, "path")


def read_texts(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """``path, text`` of the files of ``paths (path)``, read in tasks; null for one that can't be decoded. ``root`` tells the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(root)
        for batch in batches:
            names = batch.column("path").to_pylist()
            for at in range(0, len(names), 100):
                texts = []
                for name in names[at : at + 100]:
                    with files.open_input_file(name) as f:
                        content = f.read()
                    try:
                        texts.append(content.decode(json.detect_encoding(content)))
                    except UnicodeDecodeError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100], pa.string()), pa.array(texts, pa.string())], ["path", "text"])

    return paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "path string, text string")


@dataclass
class Written(WriterCommitMessage):
    """Nothing but that a task is done: names stay in the store."""


class BlobWriter(DataSourceArrowWriter):
    """Objects are written beside their place, in a folder of their task; a list of each task's names lies beside them.

    :func:`write_blobs` moves what complete tasks wrote to its place, in tasks too."""

    def __init__(self, options: dict[str, str]):
        self.root, self.run = options["path"], options["run"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.root)
        task = uuid.uuid4().hex
        aside, made = f"{_aside(root, self.run)}/{task}", set()
        listed = f"{_aside(root, self.run)}/{task}.names"
        files.create_dir(aside, recursive=True)
        with files.open_output_stream(f"{listed}-part") as names:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    path = f"{aside}/{name}"
                    if (folder := path.rsplit("/", 1)[0]) not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    with files.open_output_stream(path) as out:
                        out.write(content or b"")
                    names.write(json.dumps(name).encode() + b"\n")
        files.move(f"{listed}-part", listed)  # only whole tasks have a list
        return Written()

    def commit(self, messages: list[Written | None]) -> None:
        pass

    def abort(self, messages: list[Written | None]) -> None:
        _drop_aside(self.root, self.run)


def _aside(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/_writing-{run}"


def _drop_aside(path: str, run: str) -> None:
    files, root = _open(path)
    if files.get_file_info(_aside(root, run)).type != fs.FileType.NotFound:
        files.delete_dir(_aside(root, run))


class BlobSink(DataSource):
    """``blobs``: rows ``name, content`` become objects beside ``path``, from where :func:`write_blobs` moves them."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        return BlobWriter(dict(self.options))


def register_files(spark: SparkSession) -> None:
    """Make the formats ``wav`` and ``blobs`` known to a session, and let filters reach Python data sources, which ``wav`` needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
    spark.dataSource.register(BlobSink)


def read_wav_ranges(spark: SparkSession, path: str, frames: int = RANGE) -> DataFrame:
    """``track_id, sr, channels, n_samples, duration_s, error, first, samples``: a row per range of frames of each file."""
    register_files(spark)
    return spark.read.format("wav").option("frames", frames).load(path)


def read_wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """``track_id, sr, channels, n_samples, duration_s, error`` of each file, whose contents are not read."""
    register_files(spark)
    return spark.read.format("wav").option("headers", "true").load(path)


def write_blobs(df: DataFrame, path: str) -> None:
    """Write ``df (name, content)`` as objects below ``path``; other objects there stay. All are written before any is put in its place."""
    spark = df.sparkSession
    register_files(spark)
    run = uuid.uuid4().hex
    df.select("name", "content").write.format("blobs").option("run", run).mode("append").save(path)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        made: set[str] = set()
        for batch in batches:
            for listed in batch.column("path").to_pylist():
                with files.open_input_stream(listed) as names:
                    for line in io.TextIOWrapper(io.BufferedReader(names), "utf-8"):
                        name = json.loads(line)
                        source, place = f"{listed.removesuffix('.names')}/{name}", f"{root.rstrip('/')}/{name}"
                        if (folder := place.rsplit("/", 1)[0]) not in made:
                            files.create_dir(folder, recursive=True)
                            made.add(folder)
                        if files.get_file_info(source).type != fs.FileType.NotFound:  # else moved by an attempt before
                            files.move(source, place)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    aside = path.rstrip("/") + f"/_writing-{run}"
    if not exists(aside):  # there were no rows
        return
    lists = list_files(spark, aside, deep=False).filter(F.endswith("path", F.lit(".names"))).select("path")
    lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(move, "n long").write.format("noop").mode("overwrite").save()
    _drop_aside(path, run)


def wav_content(samples: str | Column, sr: str | Column) -> Column:
    """The 16-bit mono file of an array of numbers in [-1, 1]."""

    def content(x, rate) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(rate))
            w.writeframes(np.rint(np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    @F.pandas_udf("binary")
    def contents(x: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([content(*row) for row in zip(x, rate, strict=True)])

    return contents(samples, sr)
