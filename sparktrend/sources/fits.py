"""FITS binary tables as a Spark data source: ``spark.read.format("fits_table")``, and a sink of the same name.

Options of the source (all but the path may be left out):

- ``table``: EXTNAME or number (from 1) of the binary table in each file; the first.
- ``columns``: names, comma-separated, that the inferred schema keeps. A schema
  given by ``.schema(...)`` prunes as well: columns that it doesn't name aren't decoded.
- ``keywords``: header values, comma-separated, that every row of a file gets as
  text. A given schema may name them with any simple type.
- ``zero_as_null``: columns, comma-separated, whose zeros stand for missing values.
- ``split_bytes``: how many bytes of a file or of small files are a task (64 MB).

Columns ``_file`` and ``_row`` (from 0) may be named in ``columns`` or in a
schema. The driver lists files and reads one header; headers and rows are read
by tasks, in slabs of bounded size, whole rows of large files split among
several. A column that a file lacks is null there. Files end in .fits, .fit,
.fts, or those and .gz, which one task reads whole.
"""

from __future__ import annotations

import glob
import gzip
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from sparktrend.sources import fits_format as F

NAME = "fits_table"
SUFFIXES = (".fits", ".fit", ".fts")
SLAB, SPLIT, FILE_ROWS = 8 << 20, 64 << 20, 1_000_000


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below ``path``: a file, a folder, or a local pattern."""
    where, inner = _located(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) and not isinstance(where, fs.LocalFileSystem) else ""
    found = where.get_file_info(sorted(glob.glob(inner)) if isinstance(where, fs.LocalFileSystem) and glob.has_magic(inner) else [inner])
    files = []
    for info in found:
        if info.type == fs.FileType.Directory:
            files += [i for i in where.get_file_info(fs.FileSelector(info.path, recursive=True)) if i.type == fs.FileType.File]
        elif info.type == fs.FileType.File:
            files.append(info)
    ends = (*SUFFIXES, *(s + ".gz" for s in SUFFIXES))
    kept = [f for f in files if f.path.lower().endswith(ends) and not any(p.startswith(("_", ".")) for p in os.path.relpath(f.path, inner).split("/") if p not in (".", ".."))]
    return sorted((scheme + f.path, f.size) for f in kept)


@contextmanager
def opened(path: str):
    where, inner = _located(path)
    with where.open_input_file(inner) as file:
        yield gzip.GzipFile(fileobj=file) if inner.lower().endswith(".gz") else file


def _words(options: dict, name: str) -> list[str]:
    return [w.strip() for w in options.get(name, "").split(",") if w.strip()]


class FitsSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError(f"{NAME} needs a path")
        return path

    def schema(self) -> T.StructType:
        files = listed(self._path())
        if not files:
            raise F.FitsError(f"no FITS file below {self._path()}")
        with opened(files[0][0]) as file:
            table = F.find_table(file, self.options.get("table"))
        own = [T.StructField(c.name, c.spark()) for c in table.columns]
        lowered = [f.name.lower() for f in own]
        own = [f for i, f in enumerate(own) if f.name.lower() not in lowered[:i]]  # of equal names the first counts
        extra = [T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())]
        columns = _words(self.options, "columns")
        if missing := [c for c in columns if c.lower() not in {f.name.lower() for f in [*own, *extra]}]:
            raise F.FitsError(f"no column {missing[0]} in {files[0][0]}")
        shown = F.names_of(T.StructType([*own, *extra]), columns) if columns else T.StructType(own)
        return T.StructType([*shown, *(T.StructField(k, T.StringType()) for k in _words(self.options, "keywords"))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FitsReader(self._path(), dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FitsWriter(self._path(), dict(self.options), schema, overwrite)


@dataclass
class Slices(InputPartition):
    """(file, k, of): the k-th of so many equal parts of a file's rows."""

    parts: list[tuple[str, int, int]]


class FitsReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: T.StructType):
        self.path, self.options, self.schema = path, options, schema

    def partitions(self) -> list[Slices]:
        split, out, held, size = int(self.options.get("split_bytes", SPLIT)), [], [], 0
        for path, length in listed(self.path):
            n = 1 if path.lower().endswith(".gz") else max(1, -(-length // split))
            if n > 1:
                out += [Slices([(path, k, n)]) for k in range(n)]
                continue
            if held and size + length > split:
                out.append(Slices(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += length
        return [*out, Slices(held)] if held or not out else out

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for path, k, n in partition.parts:
            try:
                with opened(path) as file:
                    yield from self._rows(file, path, k, n)
            except (F.FitsError, KeyError, EOFError) as e:
                raise F.FitsError(f"{path}: {e}") from e

    def _rows(self, file, path: str, k: int, n: int) -> Iterator[pa.RecordBatch]:
        table = F.find_table(file, self.options.get("table"))
        kinds, zeros = to_arrow_schema(self.schema), {z.lower() for z in _words(self.options, "zero_as_null")}
        at, end = table.rows * k // n, table.rows * (k + 1) // n
        step = max(1, SLAB // max(1, table.row_bytes))
        while at < end:
            rows = min(step, end - at)
            file.seek(table.start + at * table.row_bytes)
            raw = file.read(rows * table.row_bytes)
            if len(raw) < rows * table.row_bytes:
                raise F.FitsError("the table ends early")
            raw = np.frombuffer(raw, np.uint8).reshape(rows, table.row_bytes)
            yield pa.RecordBatch.from_arrays([self._column(file, table, path, f.name, f.type, raw, at, zeros) for f in kinds], schema=kinds)
            at += rows

    @staticmethod
    def _column(file, table: F.Table, path: str, name: str, kind: pa.DataType, raw: np.ndarray, at: int, zeros: set[str]) -> pa.Array:
        n = len(raw)
        if column := table.column(name):
            return F.decode(file, table, column, raw, name.lower() in zeros).cast(kind, safe=False)
        if name == "_file":
            return pa.array([path] * n, kind)
        if name == "_row":
            return pa.array(np.arange(at, at + n)).cast(kind)
        value = table.keyword(name)
        if value is None:
            return pa.nulls(n, kind)
        text = {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)
        one = pa.array([text]) if pa.types.is_string(kind) or isinstance(value, str) else pa.array([value])
        return pa.repeat(one.cast(kind)[0], n)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FitsWriter(DataSourceArrowWriter):
    """Each task writes files of at most ``file_rows`` rows into a folder of the job; commit moves those of the tasks that succeeded."""

    def __init__(self, path: str, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.rows, self.table, self.job = int(options.get("file_rows", FILE_ROWS)), options.get("table", "DATA"), f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, inner = _located(self.path)
        where.create_dir(f"{inner}/{self.job}", recursive=True)
        held, count, files = [], 0, []

        def flush() -> None:
            nonlocal held, count
            name = f"part-{uuid.uuid4().hex}.fits"
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            with where.open_output_stream(f"{inner}/{self.job}/{name}") as out:
                out.write(F.file_bytes(batch, self.schema, self.table))
            files.append(name)
            held, count = [], 0

        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.rows - count)
                held.append(part)
                count, batch = count + part.num_rows, batch.slice(part.num_rows)
                if count == self.rows:
                    flush()
        if count:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, inner = _located(self.path)
        where.create_dir(inner, recursive=True)
        if self.overwrite:
            for info in where.get_file_info(fs.FileSelector(inner)):
                if info.type == fs.FileType.File and info.path.lower().endswith(SUFFIXES):
                    where.delete_file(info.path)
        for message in messages:
            for name in message.files if message else ():
                where.move(f"{inner}/{self.job}/{name}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, inner = _located(self.path)
        if where.get_file_info(f"{inner}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{inner}/{self.job}")


def read_fits(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """The rows of the binary tables below ``path``; ``options``: see the module."""
    spark.dataSource.register(FitsSource)
    reader = spark.read.format(NAME).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_fits(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """``df`` as files of one binary table each below ``path``. Columns: booleans, integers, floats, and strings as wide as a file's longest. ``table``: the EXTNAME; ``file_rows``: rows of a file."""
    df.sparkSession.dataSource.register(FitsSource)
    df.write.format(NAME).mode(mode).options(**options).save(path)
