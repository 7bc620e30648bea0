"""Substring search without a full scan: an index of grams, intersected, then verified.

Entities are dealt into blocks of a bounded number of rows, and a block's grams are made in one task, entity by entity, so only
its lists of keys are shuffled. The index holds, for every gram (one to three characters) and
block, the sorted keys of the block's entities that have it; it is stored by buckets of grams and sorted by gram, so a
search opens the buckets of its terms' grams and, in their files, the row groups that hold them. Keys that have all grams of a
term are candidates; their entities are read from the parts of the store that hold candidates, and matched exactly.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .results import matches, terms

GRAM = 3
BLOCK_ROWS = 4_096
#: Folders of the index and of the store.
BUCKETS, SPANS = 64, 64
#: Blocks of which a task writes a bucket.
BUCKET_BLOCKS = 64


def _listed(kind: pa.DataType) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, key and lower-case fields) of the entities of a block -> (gram, block, sorted keys) of it."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having: dict[str, set] = {}
        for batch in batches:
            for key, *fields in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                if key is not None:
                    for gram in {t[i : i + n] for t in fields if t for n in range(1, GRAM + 1) for i in range(len(t) - n + 1)}:
                        having.setdefault(gram, set()).add(key)
        lists = [sorted(having[g]) for g in having]
        ends = pa.array([0, *itertools.accumulate(map(len, lists))], pa.int32())
        keys = pa.ListArray.from_arrays(ends, pa.array(list(itertools.chain.from_iterable(lists)), kind))
        yield pa.RecordBatch.from_arrays([pa.array(list(having), pa.string()), pa.array([group[0].as_py()] * len(lists), pa.int64()), keys], names=["gram", "block", "keys"])

    return run


def build(entities: DataFrame, folder: str, key: str = "asin", columns: tuple[str, ...] = ("asin", "title", "brand"), block_rows: int = BLOCK_ROWS) -> SearchIndex:
    """Write index and store below ``folder``. Keys need not be unique: rows that share one are found together."""
    blocks = max(1, -(-entities.count() // block_rows))
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    rows = entities.withColumn("span", F.floor(block * SPANS / blocks).cast("int"))
    rows.repartitionByRange("span", key).write.mode("overwrite").partitionBy("span").parquet(f"{folder}/store")
    fields = [F.make_valid_utf8(F.lower(F.col(c).cast("string"))).alias(f"_{n}") for n, c in enumerate(columns)]
    placed = entities.select(block.cast("long").alias("block"), F.col(key).alias("key"), *fields)
    kind = placed.schema["key"].dataType
    made = T.StructType([T.StructField("gram", T.StringType()), T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind))])
    postings = placed.groupBy("block").applyInArrow(_listed(to_arrow_type(kind)), made)
    bucketed = postings.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
    # Dealt by hash, not by range: a range would be sampled, and so all grams made twice.
    dealt = bucketed.repartition("bucket", F.floor(F.col("block") / BUCKET_BLOCKS)).sortWithinPartitions("bucket", "gram", "block")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    return SearchIndex(entities.sparkSession, folder, key, tuple(columns), blocks, rows.schema, bucketed.schema)


@dataclass(frozen=True)
class SearchIndex:
    """A stored index; ``search`` gives the rows that ``ResultQuery.search`` gives of the same entities."""

    spark: SparkSession
    folder: str
    key: str
    columns: tuple[str, ...]
    blocks: int
    store_schema: T.StructType
    postings_schema: T.StructType

    def postings(self, words: list[str]) -> DataFrame:
        """(term, wanted, block, keys) of the terms' grams alone; ``wanted`` is the number of grams of the term."""
        asked = [(t, g, len(own)) for t, own in ((t, {t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))}) for t in dict.fromkeys(words)) for g in own]
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for _, g, _ in asked})
        stored = self.spark.read.schema(self.postings_schema).parquet(f"{self.folder}/postings")
        found = stored.where(F.col("bucket").isin(buckets) & F.col("gram").isin(sorted({g for _, g, _ in asked})))
        wanted = self.spark.createDataFrame(asked, "term string, gram string, wanted int")
        return found.join(F.broadcast(wanted), "gram").select("term", "wanted", "block", "keys")  # a row for each gram of the search

    def candidates(self, words: list[str]) -> DataFrame:
        """Distinct (block, key) that have all grams of a term."""
        lists = self.postings(words).groupBy("term", "wanted", "block").agg(F.collect_list("keys").alias("lists")).where(F.size("lists") == F.col("wanted"))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], F.array_intersect)
        return lists.select("block", F.explode(both).alias("key")).distinct()

    def search(self, text: str | None) -> DataFrame:
        """Entities with any term in any column; without terms all of them."""
        store = self.spark.read.schema(self.store_schema).parquet(f"{self.folder}/store")
        words = [t.lower() for t in terms(text)]
        if not words:
            return store.drop("span")
        found = self.candidates(words).select(F.floor(F.col("block") * SPANS / self.blocks).cast("int").alias("span"), F.col("key").alias(self.key)).persist()
        spans = [r.span for r in found.select("span").distinct().collect()]  # at most SPANS
        rows = store.where(F.col("span").isin(spans)).join(found.select(self.key), self.key, "left_semi")
        return rows.where(matches(list(self.columns), words)).drop("span")
