"""Export sinks: CSV folders that spreadsheets open, and XLSX workbooks. Both are written by the tasks that hold the rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"
#: Rows that a sheet can hold below its header (a fixed value of the format).
SHEET_ROWS = 1_048_575


def write_csv(df: DataFrame, path: str, order: str | None = None, mode: str = "errorifexists") -> None:
    """CSV with CR LF rows in parts which, put together in order of their names, are one file: byte order mark and header
    stand in the first part only.

    ``order`` sorts by range over all parts, so the parts in order of their names are the sorted rows.
    """
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    cells = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.col(f"`{c}`") for c in df.columns)]
    line = F.concat_ws(",", *cells).alias("value")
    header = BOM + ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    rows.select(*text).select(line).mapInArrow(with_header, "value string").write.mode(mode).option("lineSep", "\r\n").text(path)


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_REL}"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


class Workbook:
    """One sheet, compressed row by row into a stream."""

    def __init__(self, columns: list[str], stream):
        self.stream = stream
        self.book = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        for name, text in _PARTS.items():
            self.book.writestr(name, _XML + text)
        self.sheet = self.book.open("xl/worksheets/sheet1.xml", "w")
        self.sheet.write((_XML + '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>').encode())
        self.names, self.rows = [_column(k) for k in range(len(columns))], 0
        self.add(columns)

    def add(self, cells: list[str]) -> None:
        self.rows += 1
        clean = ("".join(ch for ch in c if ch >= " " or ch in "\t\n\r") for c in cells)
        xml = "".join(f'<c r="{n}{self.rows}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for n, c in zip(self.names, clean, strict=True))
        self.sheet.write(f'<row r="{self.rows}">{xml}</row>'.encode())

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.book.close()


def workbooks(df: DataFrame, rows_per_file: int = 100_000) -> DataFrame:
    """(name, rows, content): XLSX workbooks of at most ``rows_per_file`` rows each; no rows give no workbook."""
    columns, most = df.columns, min(rows_per_file, SHEET_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, book = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            book.close()
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.xlsx"]), pa.array([book.rows - 1], pa.int64()), pa.array([book.stream.getvalue()], pa.binary())], names=["name", "rows", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                book = book or Workbook(columns, io.BytesIO())
                book.add(row)
                if book.rows > most:
                    yield done()
                    n, book = n + 1, None
        if book:
            yield done()

    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate(columns)]
    return df.select(*text).mapInArrow(run, "name string, rows long, content binary")
