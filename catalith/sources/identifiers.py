"""Identifier lists from text, ragged CSV and spreadsheet files.

Files are read by Spark's own readers, so any store that Spark reaches will do. Text splits at every line, and so does CSV
(``ragged``); spreadsheets, an upload format of bounded size, are parsed a file at a time in the task that reads it.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import quality
from catalith.functions.scalars import strip

from .ragged import read_cells

#: Line ends beyond CR and LF (a fixed value).
LINE_ENDS = "[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+"
BATCH_CELLS = 100_000


def _identifiers(cells: DataFrame, cell: Column) -> DataFrame:
    """Valid identifiers among the cells, each once, with the position where it first stands."""
    named = cells.select("position", F.upper(strip(cell)).alias("asin")).where(quality.valid_identifier(F.col("asin")))
    return named.groupBy("asin").agg(F.min("position").alias("position"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(asin, position) of a text file or folder; the order of positions is the order of lines."""
    text = F.regexp_replace("value", "[\ufffd\ufeff]", "")  # bytes that are no UTF-8, and byte order marks
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split(text, LINE_ENDS)).alias("at", "cell"))
    return _identifiers(lines.select(F.struct("line", "at").alias("position"), "cell"), F.col("cell"))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_rows(file) -> Iterator[list[str]]:
    """The filled cells of each row of the active sheet, as it is unpacked; a broken file has none."""
    try:
        book = zipfile.ZipFile(file)
    except zipfile.BadZipFile:
        return
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if item.tag == f"{_MAIN}si":
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
                item.clear()
    row: list[str] = []
    for _, cell in ElementTree.iterparse(book.open(_active_sheet(book, names))):
        if cell.tag == f"{_MAIN}c":
            kind, value = cell.get("t"), cell.findtext(f"{_MAIN}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if kind == "inlineStr" else value
            if text:
                row.append(shared[int(text)] if kind == "s" else text)
        elif cell.tag == f"{_MAIN}row":
            yield row
            row = []
            cell.clear()


def xlsx_cells(content: bytes) -> Iterator[str]:
    """Every filled cell of the active sheet; a broken file has none."""
    return (c for row in xlsx_rows(io.BytesIO(content)) for c in row)


def _active_sheet(book: zipfile.ZipFile, names: set[str]) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    sheets = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    wanted = sheets[min(int(view.get("activeTab", 0)) if view is not None else 0, len(sheets) - 1)].get(_LINK)
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            target = link.get("Target", "").lstrip("/")
            return target if target in names else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def _read_files(spark: SparkSession, path: str, cells) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[str] = []
                first = 0
                for c in cells(content):
                    held.append(c)
                    if len(held) == BATCH_CELLS:
                        yield _batch(name, first, held)
                        first, held = first + len(held), []
                if held:
                    yield _batch(name, first, held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "path string, at long, cell string")
    return _identifiers(found.select(F.struct("path", "at").alias("position"), "cell"), F.col("cell"))


def _batch(name: str, first: int, cells: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(cells)), pa.array(range(first, first + len(cells)), pa.int64()), pa.array(cells)], names=["path", "at", "cell"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _identifiers(read_cells(spark, path).select(F.struct("path", "block", "at").alias("position"), "cell"), F.col("cell"))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    return _read_files(spark, path, xlsx_cells)


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """By the name's ending: xlsx, csv, and anything else as text."""
    low = path.lower()
    return read_xlsx(spark, path) if low.endswith(".xlsx") else read_csv(spark, path) if low.endswith(".csv") else read_text(spark, path)


def read_settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """``key=value`` lines over defaults: comments and blank lines are left out, the first of a key counts."""
    line = F.col("value")
    lines = spark.read.text(path).where(strip(line).rlike(r"^[^#=]+=")).select(F.monotonically_increasing_id().alias("n"), F.split(strip(line), "=", 2).alias("kv"))
    key, value = strip(F.col("kv")[0]), F.regexp_replace(strip(F.col("kv")[1]), "^[\"']|[\"']$", "")
    first = lines.groupBy(key.alias("key")).agg(F.min_by(value, "n").alias("value"))
    return defaults | {r.key: r.value for r in first.collect()}  # a settings file


def read_json_settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON settings document over defaults; keys that the defaults do not know are left out."""
    rows = spark.read.option("multiLine", True).json(path).limit(1).collect()
    known = {k: v for k, v in rows[0].asDict(recursive=True).items() if k in defaults and v is not None} if rows else {}
    return defaults | known


def write_json_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """A settings document as one file, in place of the one before; it is renamed over it when it is whole,
    so that at any time one of the two is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, new = hadoop.Path(path), hadoop.Path(f"{path}.new")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(new, True)
    out.write(bytearray(json.dumps(settings, indent=2, ensure_ascii=False).encode()))
    out.close()
    conf, gateway = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
    kinds = getattr(hadoop, "Options$Rename")
    replacing = gateway.new_array(kinds, 1)
    replacing[0] = kinds.OVERWRITE
    hadoop.FileContext.getFileContext(files.makeQualified(at).toUri(), conf).rename(files.makeQualified(new), files.makeQualified(at), replacing)


def pending_pages(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """Stored pages (path/<batch>/<asin>.html) that wait for work: names starting with _ and finished batches are out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("batch"), F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("asin"), F.decode("content", "UTF-8").alias("html"))
    open_ = named.where(~F.col("asin").startswith("_") & ~F.col("batch").startswith("_"))
    return open_ if done is None else open_.join(done.select("batch"), "batch", "left_anti")


def safe_archive_name(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_\-]", "_", name)
