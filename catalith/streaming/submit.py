"""Submitting a stream's rows to a service: in batches, with retries, halving down to the rows that cannot be taken.

A task submits its rows in batches. One that keeps failing after its retries is halved, and so on down to single rows, which
are retried again before they count as dead. Accepted and dead rows of a micro-batch are stored under its number, so a
micro-batch that is repeated after a failure either finds its outcome and submits nothing, or submits again under the same
keys, by which the service can tell repeats.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The model's sizes of submits.
SIZE, RETRIES, WAIT_S = 10, 3, 1.0

#: Takes rows as dictionaries, each with its ``submit_key``; raises where it does not take them all.
Submit = Callable[[list[dict]], None]


def deliver(rows: list[dict], submit: Submit, retries: int = RETRIES, wait_s: float = WAIT_S) -> list[str | None]:
    """Why each row was refused in the end, None for those taken."""
    tries = retries
    while True:
        error = None
        for attempt in range(tries):
            try:
                submit(rows)
                return [None] * len(rows)
            except Exception as e:  # whatever a service may raise
                error = f"{type(e).__name__}: {e}"[:500]
                if attempt < tries - 1:
                    time.sleep(wait_s * 2**attempt)
        if len(rows) == 1:
            return [error]
        half = len(rows) // 2
        return [x for some in (rows[:half], rows[half:]) for x in deliver(some, submit, retries if len(some) == 1 else 1, wait_s)]


def submitted(rows: DataFrame, submit: Submit, key: str, size: int = SIZE, retries: int = RETRIES, wait_s: float = WAIT_S) -> DataFrame:
    """The rows with ``error``: None where the service took them. ``key`` goes before a hash of the row in ``submit_key``;
    rows equal in all columns have equal keys, since to the service they are repeats."""
    keyed = rows.withColumn("submit_key", F.concat_ws("-", F.lit(key), F.hex(F.xxhash64(*rows.columns))))
    schema = T.StructType([*keyed.schema.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors: list[str | None] = []
            for at in range(0, batch.num_rows, size):
                errors += deliver(batch.slice(at, size).to_pylist(), submit, retries, wait_s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], names=schema.names)

    return keyed.mapInArrow(run, schema)


def _is_done(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def submit_into(folder: str, submit: Submit, size: int = SIZE, retries: int = RETRIES, wait_s: float = WAIT_S) -> Callable[[DataFrame, int], None]:
    """Sink for ``foreachBatch``: outcomes go to ``folder/batch=N``, parted by ``dead``."""

    def write(batch: DataFrame, number: int) -> None:
        at = f"{folder}/batch={number}"
        if not _is_done(batch.sparkSession, at):
            out = submitted(batch, submit, str(number), size, retries, wait_s)
            out.withColumn("dead", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("dead").parquet(at)

    return write


def outcomes(spark: SparkSession, folder: str, dead: bool) -> DataFrame:
    """Rows that the service took, or the dead ones with their errors."""
    found = spark.read.parquet(folder).where(F.col("dead") == dead)
    return found.drop("dead", "batch") if dead else found.drop("dead", "batch", "error")
