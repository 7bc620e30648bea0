"""Pages at any depth from a layout by ranges: the files that a page touches are found from their bounds.

Entities are stored in files of disjoint ranges of the order, sorted inside; a small table holds each file's bounds and
number of rows. A page looks up the files next to its cursor, at most one for each of its rows and the one that the cursor
lies in, and reads these alone; with a condition it goes on file by file, twice as many each time, until the page is full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .results import MAX_PAGE

FILE_ROWS = 1 << 20
BOUNDS = "file string, least {0}, most {0}, n long"


def build(entities: DataFrame, folder: str, order: str = "id", file_rows: int = FILE_ROWS) -> RangeLayout:
    """Write the layout below ``folder``; rows without a value to order by are on no page and left out."""
    spark, known = entities.sparkSession, entities.where(F.col(order).isNotNull())
    files = max(1, -(-known.count() // file_rows))
    known.repartitionByRange(files, order).sortWithinPartitions(order).write.mode("overwrite").parquet(f"{folder}/rows")
    stored = spark.read.schema(known.schema).parquet(f"{folder}/rows")
    bounds = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(order).alias("least"), F.max(order).alias("most"), F.count("*").alias("n"))
    bounds.sort("least").write.mode("overwrite").parquet(f"{folder}/bounds")
    return RangeLayout(spark, folder, order, known.schema)


@dataclass(frozen=True)
class RangeLayout:
    spark: SparkSession
    folder: str
    order: str
    schema: StructType

    @property
    def bounds(self) -> DataFrame:
        kind = self.schema[self.order].dataType.simpleString()
        return self.spark.read.schema(BOUNDS.format(kind)).parquet(f"{self.folder}/bounds")

    def total(self) -> int:
        """Number of all rows, from the bounds."""
        return self.bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def page(self, cursor=None, size: int = 50, direction: str = "next", condition: Column | None = None) -> DataFrame:
        """One row more than the page has, if there are so many: ``next`` descends from below the cursor, ``prev`` ascends
        from above it. ``inputFiles`` of the result names the files that were read."""
        size = max(1, min(size, MAX_PAGE))
        down = direction == "next"
        near, far = ("most", "least") if down else ("least", "most")
        beyond = lambda c: F.lit(True) if cursor is None else c < F.lit(cursor) if down else c > F.lit(cursor)
        ordered = lambda c: F.desc(c) if down else F.asc(c)
        files = self.bounds.where(beyond(F.col(far))).orderBy(ordered(near))
        inside = beyond(F.col(self.order)) if condition is None else beyond(F.col(self.order)) & condition
        take, skip, read, found = size + 2, 0, [], 0
        while True:
            some = files.offset(skip).limit(take).collect()  # every file has a row, so these hold the page unless a condition thins it
            for f in some:
                if condition is None and found > size:
                    break
                read.append(f.file)
                if condition is None and (cursor is None or (f[near] < cursor if down else f[near] > cursor)):
                    found += f.n
            page = self._read(read).where(inside).orderBy(ordered(self.order)).limit(size + 1)
            if condition is None or len(some) < take or page.count() > size:
                return page
            skip, take = skip + take, take * 2
