"""Ragged CSV read in parallel: a file of any size, cut at any line, with quoted line ends.

Whether a line end stands inside quotes depends on all that comes before it. At the beginning of a line only two states
are possible: a record begins, or a quoted cell goes on. So every byte range is walked under both states at once and
becomes a map from state to state; these maps, one small row a range, are composed in order, and then each range is parsed
under the one state that holds. A record that runs over ranges is put together from its pieces, at most two a range.

What a quote means is asked of the ``csv`` module itself, a line at a time, so cells are the module's own. Lines without a
quote keep the state and are not asked about.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of whole records that are parsed at once.
CHUNK = 1 << 20


def _rows(text: str) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(io.StringIO(text, newline=""))


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes or not ends inside quotes."""
    if '"' not in line:
        return inside
    *_, last = _rows(('"' if inside else "") + line + "\nx")
    return last != ["x"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line): the lines of each byte range in order; ``block`` is where the range begins."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


class _Ranges:
    """Runs of lines of one (path, block), decoded as the whole file would be."""

    def __init__(self):
        self.now: tuple | None = None

    def split(self, batch: pa.RecordBatch) -> Iterator[tuple[bool, tuple, str]]:
        """(whether a range begins, its (path, block, ...), line) of each row; all columns but ``line`` name the range."""
        for *at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            begins = tuple(at) != self.now
            self.now = tuple(at)
            yield begins, self.now, line.decode("utf-8-sig" if begins and at[1] == 0 else "utf-8", "ignore")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: where either state leads."""
    ranges, at, states = _Ranges(), None, [False, True]

    def of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([states[0]]), pa.array([states[1]])], names=["path", "block", "from_start", "from_inside"])

    for batch in batches:
        for begins, now, line in ranges.split(batch):
            if begins:
                if at is not None:
                    yield of()
                at, states = now, [False, True]
            if '"' in line:
                first = inside_after(line, states[0])
                states = [first, first if states[0] == states[1] else inside_after(line, states[1])]
    if at is not None:
        yield of()


PIECES = "path string, block long, at long, kind string, cell string"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the records that lie in a range (kind ``cell``), and the raw pieces of those that do not: the ``head`` of a
    range ends a record, its ``tail`` begins one, a ``middle`` does neither."""
    ranges, at, n, whole, size, open_, began = _Ranges(), None, 0, [], 0, None, True

    def of(kind: str, values: list[str]) -> pa.RecordBatch:
        k = len(values)
        places = range(n, n + k)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * k, pa.string()), pa.array([at[1]] * k, pa.int64()), pa.array(places, pa.int64()), pa.array([kind] * k, pa.string()), pa.array(values, pa.string())], names=["path", "block", "at", "kind", "cell"])

    def parsed() -> list[str]:
        return [c for row in _rows("\n".join(whole) + "\n") for c in row] if whole else []

    def end() -> Iterator[pa.RecordBatch]:
        nonlocal n
        cells = parsed()
        yield of("cell", cells)
        n += len(cells)
        if open_ is not None:
            yield of("tail" if began else "middle", ["\n".join(open_)])

    for batch in batches:
        for begins, now, line in ranges.split(batch):
            if begins:
                if at is not None:
                    yield from end()
                at, n, whole, size = now, 0, [], 0
                open_, began = ([], False) if now[2] else (None, True)
            if open_ is None:
                if inside_after(line, False):
                    open_, began = [line], True
                else:
                    whole.append(line)
                    size += len(line)
            else:
                open_.append(line)
                if not inside_after(line, True):
                    if began:
                        whole.append("\n".join(open_))
                        size += len(whole[-1])
                    else:
                        yield of("head", ["\n".join(open_)])
                    open_ = None
            if size >= CHUNK:
                cells = parsed()
                yield of("cell", cells)
                n, whole, size = n + len(cells), [], 0
    if at is not None:
        yield from end()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, block, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells = [c for row in _rows(text) for c in row]
            k = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), pa.array([block] * k, pa.int64()), pa.array(range(at, at + k), pa.int64()), pa.array(cells, pa.string())], names=["path", "block", "at", "cell"])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, cell): every cell of every ragged row, quoted and multiline cells included, in that order.

    Undecodable bytes are dropped, and a byte order mark at the beginning of a file. A quote that never closes takes the rest
    of its file, without a last line end.
    """
    lines = _lines(spark, path)
    maps = lines.mapInArrow(_maps, "path string, block long, from_start boolean, from_inside boolean")
    step = lambda s, m: F.when(s["now"], m["from_inside"]).otherwise(m["from_start"])
    states = F.aggregate(
        F.array_sort(F.collect_list(F.struct("block", "from_start", "from_inside"))),  # one for each range of a file
        F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<block:bigint,inside:boolean>>").alias("seen")),
        lambda s, m: F.struct(step(s, m).alias("now"), F.concat(s["seen"], F.array(F.struct(m["block"].alias("block"), s["now"].alias("inside")))).alias("seen")),
    )
    starts = maps.groupBy("path").agg(states["seen"].alias("seen")).select("path", F.inline("seen"))
    known = lines.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "inside", "line")  # a row for each range
    pieces = known.mapInArrow(_cells, PIECES)
    # Pieces of records over ranges: each tail begins one, what follows belongs to it.
    order = Window.partitionBy("path").orderBy("block", F.when(F.col("kind") == "tail", 1).otherwise(0))
    cut = pieces.where("kind <> 'cell'").withColumn("owner", F.last(F.when(F.col("kind") == "tail", F.struct("block", "at")), ignorenulls=True).over(order))
    texts = cut.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("block", F.when(F.col("kind") == "tail", 1).otherwise(0).alias("k"), "cell"))).alias("parts"))
    whole = texts.select("path", F.col("owner.block").alias("block"), F.col("owner.at").alias("at"), F.array_join(F.transform("parts", lambda p: p["cell"]), "\n").alias("text"))
    return pieces.where("kind = 'cell'").select("path", "block", "at", "cell").unionAll(whole.mapInArrow(_joined, "path string, block long, at long, cell string"))
