"""Shared helpers: shared-folder tables, text normalisation, bounded slicing of Arrow batches, distributed offsets."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.sources.layout import spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_CHARS = 2_000_000
#: Bits that one aggregate of bitmap_construct_agg holds (fixed value).
BUCKET_BITS = 32_768
#: Bitmaps of 4 KB that are broadcast at once: 64 MB.
BITMAPS = 16_384
#: How to drop what operators keep in a Python worker from one of their tasks to the next.
KEPT: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts, spread over the cores where it is small."""
    return spread(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: ``spark.checkpoint.dir``.

    Where the setting is unset and the master is a single local process (tests), a temporary folder serves and is
    removed at exit; on a cluster an unset folder is an error, since a machine-local one would lose data.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    own = getattr(shared_dir, "own", None)
    if own is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = shared_dir.own = tempfile.mkdtemp(prefix="catalith-shared-")
        atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder as zstd Parquet and read it back.

    The files go when the driver's JVM ends in order, or before by ``discard``.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    path, files = _place(spark, at)
    files.deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(at)
    table.stored_at = at
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later step reads."""
    path, files = _place(table.sparkSession, table.stored_at)
    files.delete(path, True)


def _place(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Spark's translate makes a string of every character, some fifty times the text, so
    only texts with characters of several bytes go through it; in all others lower changes the same letters."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def drop_kept() -> None:
    """Free what other operators have kept in this Python worker. Spark gives a worker to one stage after another, and what an
    earlier one left would count for the executor in all that follow."""
    for drop in KEPT:
        drop()


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose texts total about ``chars`` bytes, so Python objects stay bounded."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    first = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= chars:
            yield batch.slice(first, i + 1 - first)
            first, total = i + 1, 0
    if first < len(sizes):
        yield batch.slice(first)
    pa.default_memory_pool().release_unused()


def running_offsets(counts: DataFrame, part: str, count: str, offset: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Exclusive running sum of ``count`` over ``part`` (one row per partition, so its size is bounded by the number of
    tasks and not by the data), separately for each value of ``within``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(offset, F.coalesce(F.sum(count).over(w), F.lit(0).cast("long")))


def row_key(doc_id: Column, digest: Column) -> Column:
    """One string per (id, digest of the text), for joins back to rows; null ids included. Ids of any numeric type are
    taken as the operators take them, as long integers."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("none")), digest)


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """The documents with ``row_key`` of their id and text in column ``name``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(name, row_key(F.col("doc_id"), F.md5(text.cast("binary"))))


# --- rows by their places in files ---------------------------------------------------------------------------------


def free_name(table: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    while name in table.columns:
        name = f"_{name}"
    return name


def with_places(table: DataFrame, name: str) -> DataFrame:
    """The rows with a struct of their file and their number in it. A table that is not read from Parquet files is written
    to the shared folder first."""
    try:
        meta = table.metadataColumn("_metadata")
        return table.withColumn(name, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")))
    except AnalysisException:
        return with_places(written(table, "rows"), name)


def bit_at(bits: Column, place: Column) -> Column:
    """Whether a bitmap of bitmap_construct_agg holds a place."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def at_places(placed: DataFrame, name: str, places: DataFrame) -> DataFrame:
    """The rows of ``placed`` (from ``with_places``) that stand at ``places`` (file, row), filtered where they lie: nothing
    but bitmaps moves. These are broadcast 64 MB at a time, each time to the files that they speak of."""
    bits, file, bucket = (free_name(placed, n) for n in ("bits", "bits_file", "bits_bucket"))
    numbered = F.floor(F.col("row") / BUCKET_BITS)
    bitmaps = written(places.groupBy(F.col("file").alias(file), numbered.alias(bucket)).agg(F.bitmap_construct_agg(F.col("row") % BUCKET_BITS).alias(bits)), "places")
    waves = max(1, -(-bitmaps.count() // BITMAPS))
    row = F.col(f"`{name}`.row")
    of_wave = lambda c, wave: F.pmod(F.xxhash64(c), F.lit(waves)) == wave
    on = (F.col(f"`{name}`.file") == F.col(file)) & (F.floor(row / BUCKET_BITS) == F.col(bucket))
    columns = [f"`{c}`" for c in placed.columns if c != name]
    parts = None
    for wave in range(waves):
        own, some = placed, bitmaps
        if waves > 1:
            own, some = placed.where(of_wave(F.col(f"`{name}`.file"), wave)), bitmaps.where(of_wave(F.col(file), wave))
        found = own.join(F.broadcast(some), on).where(bit_at(F.col(bits), row % BUCKET_BITS)).select(*columns)
        parts = found if parts is None else parts.unionAll(found)
    return parts
