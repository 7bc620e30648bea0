"""How a table lies in its files, where that decides how many tasks can read it; tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of fewer bytes may lie in one or two row groups, each of which a single task reads.
SMALL_TABLE = 64 << 20


def spread(table: DataFrame) -> DataFrame:
    """A table just read, for steps that are costly per row and shuffle nothing: a small one in few files is dealt to all
    cores, any other stays as it lies. The rows are the same either way; columns not used are still not read.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    files = table.inputFiles()
    if len(files) >= 2 * cores or table.rdd.getNumPartitions() >= 2 * cores:
        return table
    listed = table.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0  # from the listing; no file is opened
    return table.repartition(cores) if (listed or 0) < SMALL_TABLE else table


def shared_folder(spark: SparkSession, kind: str = "stream") -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a single local process, as in tests, takes the
    warehouse; on a cluster it is an error, since a machine-local folder would lose state."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(table: DataFrame, kind: str) -> DataFrame:
    """Cut lineage: the table written once to the shared folder and read back; its files go when the driver ends in order."""
    spark = table.sparkSession
    at = shared_folder(spark, kind)
    table.write.option("compression", "zstd").parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(table.schema).parquet(at)
