"""Operator 7: sharding by minimax contiguous partition.

Atomic groups are the classes of equal texts. They are ordered by a 64-bit hash of the text, so membership in a shard,
a contiguous range of hashes, is decided on a row by its own text and the few cut points. Texts that share a hash are
one group, which only makes the group coarser.

The smallest feasible capacity is found by binary search; a capacity is checked greedily: from each cut, go on to the
last group that still fits. A group above the capacity stands alone. Greedy filling needs the least number of shards,
so the search finds the minimal largest shard.

The groups stay distributed. The driver sees a summary of at most ``BUCKETS`` buckets of the running size, each with its
least and greatest running sum, which bound every greedy cut from both sides. Where the bounds leave a capacity open, the
buckets in which cuts may fall are summarised again, finer, in one pass; so the answer is exact after a few passes and
what reaches the driver does not grow with the data.

Defined results: a null text has size ``ROW_BYTES`` and the checksum of no bytes; all null and empty texts form a group;
rows with equal ids are separate; ids that are null get slots like others; with fewer groups than shards the last shards
stay empty; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets, written

SHARDS = 40
ROW_BYTES = 16
BUCKETS = 1 << 16


class Groups:
    """Ordered groups as a table of (hash, size, stop), with stop the running sum of sizes. ``ends`` holds what the driver
    knows of the stops: ascending buckets (least stop, greatest stop); a bucket of one stop is known exactly."""

    def __init__(self, table: DataFrame, buckets: int = BUCKETS):
        self.table, self.buckets = table, buckets
        self.total = int(table.agg(F.max("stop")).first()[0] or 0)
        self.ends: list[tuple[int, int]] = []
        if self.total:
            self.width = max(1, -(-self.total // buckets))
            self.ends = self._buckets([(1, self.total)])

    def _buckets(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Buckets of ``width`` over the stops in the spans, none across two spans."""
        width = self.width
        stop = F.col("stop")
        inside = reduce(lambda x, y: x | y, [stop.between(a, z) for a, z in spans])
        span = reduce(lambda x, y: x + y, [(stop > z).cast("int") for _, z in spans])
        buckets = self.table.where(inside).groupBy(span.alias("s"), F.floor((stop - 1) / width).alias("b"))
        return sorted((r.a, r.z) for r in buckets.agg(F.min("stop").alias("a"), F.max("stop").alias("z")).collect())

    def after(self, at: int, capacity: int) -> tuple[int, int]:
        """Bounds of the next shard end behind ``at``: the last stop within ``capacity``, or the end of the next group."""
        k = bisect.bisect_right(self.ends, (at + capacity, 1 << 63)) - 1
        a, z = self.ends[k] if k >= 0 else (0, 0)
        low, high = (z, z) if z <= at + capacity else (a, at + capacity)
        if low <= at:
            k = bisect.bisect_right(self.ends, (at, 1 << 63)) - 1
            k += k < 0 or self.ends[k][1] <= at
            a, z = self.ends[k]
            least, most = (a, a) if a > at else (at + 1, z)
            low, high = max(low, least), max(high if high > at else 0, most)
        return low, high

    def fill(self, capacity: int, most: int) -> list[tuple[int, int]]:
        """Bounds of the greedy shard ends, until the lower ones reach the last group or ``most`` shards are used."""
        low = high = 0
        out: list[tuple[int, int]] = []
        while low < self.total and len(out) < most:
            low = self.after(low, capacity)[0]
            high = self.after(high, capacity)[1] if high < self.total else high
            out.append((low, max(low, min(high, self.total))))
        return out

    def refine(self, regions: list[tuple[int, int]]) -> None:
        """Replace the buckets that the regions touch by finer ones in one pass. The width halves at least, so the new
        buckets are at most ``buckets`` or twice the touched ones, and all are exact after a few passes."""
        spans: list[list[int]] = []
        for low, high in sorted(regions):
            i = bisect.bisect_right(self.ends, (low, 1 << 63)) - 1
            i = max(i, 0)
            j = min(bisect.bisect_right(self.ends, (high, 1 << 63)), len(self.ends) - 1)
            if spans and i <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], j)
            else:
                spans.append([i, j])
        bounds = [(self.ends[i][0], self.ends[j][1]) for i, j in spans]
        self.width = max(1, min(self.width // 2, sum(z - a + 1 for a, z in bounds) // self.buckets))
        fine = self._buckets(bounds)
        for i, j in reversed(spans):
            del self.ends[i : j + 1]
        self.ends = sorted(self.ends + fine)


def minimax_cuts(groups: Groups, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the shard ends (running sums) under it."""
    if not groups.total:
        return 0, []

    def verdict(capacity: int) -> bool | None:
        ends = groups.fill(capacity, shards)
        if ends[-1][0] >= groups.total:
            return True
        return False if ends[-1][1] < groups.total else None

    lo, hi = 0, groups.total
    while hi - lo > 1:
        mid = (lo + hi) // 2
        fits = verdict(mid)
        if fits is None:  # look closer wherever a cut may fall under the capacities still in question
            low, high = groups.fill(lo + 1, shards), groups.fill(hi, shards)
            high += [(groups.total, groups.total)] * (len(low) - len(high))
            groups.refine([(a[0], z[1]) for a, z in zip(low, high, strict=False)])
        elif fits:
            hi = mid
        else:
            lo = mid
    while loose := [e for e in groups.fill(hi, shards) if e[0] != e[1]]:
        groups.refine(loose)
    return hi, [a for a, _ in groups.fill(hi, shards)]


def running_groups(sized: DataFrame) -> DataFrame:
    """Groups in hash order with their running sums: one range shuffle, sums per part, offsets from the part totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            size = b.column(1).to_numpy()
            stop = before + size.cumsum()
            before = int(stop[-1]) if len(stop) else before
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stop), pa.array([part] * len(size), pa.int32())], names=["hash", "size", "stop"] + ["part"])

    groups = sized.groupBy("hash").agg(F.sum("size").alias("size")).repartitionByRange("hash").sortWithinPartitions("hash")
    local = written(groups.mapInArrow(run, "hash long, size long, stop long, part int"), "groups")
    totals = local.groupBy("part").agg(F.max("stop").alias("n"))
    offsets = running_offsets(totals, "part", "n", "before").select("part", "before")
    return written(local.join(F.broadcast(offsets), "part").select("hash", "size", (F.col("stop") + F.col("before")).alias("stop")), "running-groups")


def number_slots(placed: DataFrame) -> DataFrame:
    """Gapless slots in each shard, in order of doc_id: numbers within a part and shard, and offsets from their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            local = []
            for s in b.column(b.schema.get_field_index("shard")).to_pylist():
                n = seen.get(s, 0)
                local.append(n)
                seen[s] = n + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64()), pa.array([part] * len(local), pa.int32())], names=[*b.schema.names, "local", "part"])

    schema = "doc_id long, size long, text_crc32 long, shard int, local long, part int"
    order = ["shard", "doc_id", "text_crc32", "size", "source_part"]  # rows equal otherwise are dealt by where they were read
    dealt = placed.withColumn("source_part", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("source_part")
    local = written(dealt.mapInArrow(run, schema), "slots")
    totals = local.groupBy("part", "shard").agg(F.count("*").alias("n"))  # at most tasks + shards rows
    offsets = running_offsets(totals, "part", "n", "before", within=("shard",)).select("part", "shard", "before")
    return local.join(F.broadcast(offsets), ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("local") + F.col("before")).alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document with its shard and slot, under the law of near-equal bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    ), "sizes")
    groups = Groups(running_groups(sized.select("hash", "size")))
    _, ends = minimax_cuts(groups, shards)
    firsts = [r[0] for r in groups.table.where(F.col("stop").isin(ends)).select("hash").orderBy("hash").collect()]  # a shard's last hash
    of = F.aggregate(F.array(*[F.lit(h) for h in firsts[:-1]]).cast("array<long>"), F.lit(0), lambda n, h: n + (F.col("hash") > h).cast("int"))
    numbered = number_slots(sized.select("doc_id", "size", "text_crc32", of.alias("shard")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
