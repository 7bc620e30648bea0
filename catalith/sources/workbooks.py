"""XLSX as a data source: ``spark.read.format("xlsx")`` and ``df.write.format("xlsx")`` after ``register(spark)``.

Reading: a partition for each file of a folder; rows are taken from the sheet as it is unpacked, so a task holds a batch
of rows and the file's shared texts. Writing: each task streams its rows into files below ``_temporary``, of a bounded
number of rows each; the driver moves what the successful tasks wrote into place when all have ended, and an aborted job
leaves nothing. Files are reached through pyarrow, so the path is one that pyarrow knows and all executors share; for stores
that only Spark reaches there are ``exports.workbooks`` and ``identifiers.read_xlsx``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .exports import SHEET_ROWS, Workbook
from .identifiers import xlsx_rows

BATCH_ROWS = 10_000
FILE_ROWS = 100_000
TEMPORARY = "_temporary"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class XlsxSource(DataSource):
    """Options: ``path``, and for writing ``rowsPerFile``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "file string, row long, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return XlsxWriter(self.options["path"], schema.names, min(SHEET_ROWS, int(self.options.get("rowsPerFile", FILE_ROWS))), overwrite)


@dataclass
class OneFile(InputPartition):
    path: str


class XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[OneFile]:
        files, at = _place(self.path)
        if files.get_file_info(at).type == fs.FileType.Directory:
            found = files.get_file_info(fs.FileSelector(at))
            return [OneFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name.endswith(".xlsx") and f.base_name[0] not in "_."]
        return [OneFile(at)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        files, _ = _place(self.path)
        with files.open_input_file(partition.path) as file:
            held: list[list[str]] = []
            first = 0
            for row in xlsx_rows(file):
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield self._batch(partition.path, first, held)
                    first, held = first + len(held), []
            yield self._batch(partition.path, first, held)

    @staticmethod
    def _batch(path: str, first: int, rows: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["file", "row", "cells"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class XlsxWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], rows_per_file: int, overwrite: bool):
        self.path, self.columns, self.most, self.overwrite = path, columns, rows_per_file, overwrite
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        files, at = _place(self.path)
        at = at.rstrip("/")
        return files, at, f"{at}/{TEMPORARY}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, temporary = self._folder()
        files.create_dir(temporary, recursive=True)
        part, attempt, names, book = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if book is None:
                    names.append(f"part-{part:05d}-{len(names):05d}-{attempt}.xlsx")
                    sink = files.open_output_stream(f"{temporary}/{names[-1]}")
                    book = Workbook(self.columns, sink)
                book.add(["" if v is None else str(v) for v in row])
                if book.rows > self.most:
                    book.close()
                    sink.close()
                    book = None
        if book is not None:
            book.close()
            sink.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, at, temporary = self._folder()
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.base_name.endswith(".xlsx"):
                    files.delete_file(f.path)
        for name in [n for m in messages if m for n in m.names]:
            files.move(f"{temporary}/{name}", f"{at}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, at, temporary = self._folder()
        for folder in (temporary, f"{at}/{TEMPORARY}"):
            if files.get_file_info(folder).type == fs.FileType.Directory and (folder == temporary or not files.get_file_info(fs.FileSelector(folder))):
                files.delete_dir(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def write_workbooks(df: DataFrame, path: str, rows_per_file: int = FILE_ROWS, mode: str = "append") -> None:
    """Any columns, as Spark shows them as text, in files of at most ``rows_per_file`` rows; no rows give no file."""
    register(df.sparkSession)
    text = df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.format("xlsx").option("rowsPerFile", rows_per_file).mode(mode).save(path)
