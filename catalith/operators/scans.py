"""Segmented scans: what the earlier rows of a key showed, without a key in one task.

Rows are dealt by range over key and order, so a key of any size is spread over tasks. Each task walks its part in order, a
batch at a time by numpy, and attaches to each row what it knows. That settles all rows but those of the part's first key:
of them the results are stored, of the first key's rows and the part's last row the states. These ends of parts, at most two
rows each, are combined in order, and what comes in from earlier parts is joined to the rows that wait for it by broadcast,
at most one row a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.sources.layout import stored


def _changed(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before; nulls are equal to each other."""
    before, after = keys[:-1], keys[1:]
    unequal = pc.fill_null(pc.not_equal(before, after), False)
    return pc.or_(unequal, pc.xor(pc.is_null(before), pc.is_null(after))).to_numpy(zero_copy_only=False)


def _walk(values: list[int], first: int, names: list[str]):
    """Rows of one part in order (key, the ``when`` of each track, and all columns) -> the same with the value of column
    ``first`` at the key's first row; for each track, the value of its column at the last earlier row of the key where
    ``when`` holds; and marks of a key's first row here, of the part's first key, and of the part's first and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lead, held = TaskContext.get().partitionId(), True, None
        carry: list[pa.Array] | None = None  # key, first value, track values

        def of(columns: list, n: int, last: bool) -> pa.RecordBatch:
            tail = np.zeros(n, bool)
            tail[-1] = last
            return pa.RecordBatch.from_arrays([*columns, pa.array(tail)], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at, key, origin = np.arange(n), batch.column(0), batch.column(first)
            start = np.ones(n, bool)
            start[1:] = _changed(key)
            if carry is not None:
                start[0] = _changed(pa.concat_arrays([carry[0], key[:1]]))[0]
            begins = np.maximum.accumulate(np.where(start, at, -1))  # -1: goes on from the batch before
            here = begins >= 0
            leading = np.full(n, lead) if carry is not None else np.full(n, True)
            later = np.flatnonzero(start if carry is not None else np.concatenate([[False], start[1:]]))
            if len(later):
                leading[later[0] :] = False
            lead = bool(leading[-1])
            origins = pa.concat_arrays([carry[1] if carry else pa.nulls(1, origin.type), origin])
            first_of = origins.take(pa.array(np.where(here, begins + 1, 0)))
            tracks, after = [], []
            for t, column in enumerate(values):
                when, value = batch.column(1 + t), batch.column(column)
                set_at = np.maximum.accumulate(np.where(pc.fill_null(when, False).to_numpy(zero_copy_only=False), at, -1))
                before = np.concatenate([[-1], set_at[:-1]])
                pool = pa.concat_arrays([carry[2 + t] if carry else pa.nulls(1, value.type), value, pa.nulls(1, value.type)])
                tracks.append(pool.take(pa.array(np.where(before >= np.maximum(begins, 0), before + 1, np.where(here, n + 1, 0)))))
                now = set_at[-1] + 1 if set_at[-1] >= max(begins[-1], 0) else n + 1 if here[-1] else 0
                after.append(pool.take(pa.array([now])))
            carry = [key[-1:], first_of[-1:], *after]
            head = np.zeros(n, bool)
            head[0] = held is None
            columns = [*batch.columns, first_of, *tracks, pa.array(start), pa.array(leading), pa.array(np.full(n, part, np.int32)), pa.array(head)]
            if held is not None:
                yield of(*held, False)
            held = (columns, n)
        if held is not None:
            yield of(*held, True)

    return run


def with_earlier(rows: DataFrame, key: str, order: str, keep: list[str], states: dict[str, Column], tracks: dict[str, tuple[Column, str]], first: tuple[str, str], found: list[dict[str, Column]], passing: tuple[str, ...] = ()) -> DataFrame:
    """Each row's columns in ``keep`` and those of ``found``, dictionaries of columns of which later ones may name earlier
    ones, made of the row's columns in ``keep`` and of

    * ``states``, each a struct of the row that is not NULL;
    * for each track (when, state): that state at the key's last earlier row where ``when`` holds, NULL where there is none;
    * under ``first``'s name: its state at the key's first row;
    * ``first_seen``: whether the row is the key's first; and ``_key``, its key.

    Columns of ``found`` that are only ``passing``, named by later ones, are not among the results and not stored.

    States and conditions are computed after the rows are dealt, so they do not travel and are computed once; what is found
    is stored as it is, a row a row, and should be turned into more rows by the caller.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, key, order).sortWithinPartitions(key, order)
    walked = dealt.select(F.col(key).alias("_key"), *[when.alias(f"_when_{name}") for name, (when, _) in tracks.items()], *keep, *[c.alias(name) for name, c in states.items()])
    of, place = {f.name: f.dataType for f in walked.schema}, walked.columns.index
    fields = [*walked.schema.fields, T.StructField(first[0], of[first[1]]), *[T.StructField(name, of[state]) for name, (_, state) in tracks.items()]]
    fields += [T.StructField(n, T.BooleanType()) for n in ("first_seen", "_leading")] + [T.StructField("_part", T.IntegerType())] + [T.StructField(n, T.BooleanType()) for n in ("_head", "_tail")]
    names = [f.name for f in fields]
    walk = _walk([place(state) for _, state in tracks.values()], place(first[1]), names)
    seen = walked.mapInArrow(walk, T.StructType(fields))
    wanted = [*keep, *[n for step in found for n in step if n not in passing]]

    def described(df: DataFrame) -> DataFrame:
        for step in found:
            df = df.withColumns(step)
        return df

    settled = ~F.col("_leading")
    waits = F.col("_leading") | F.col("_tail")
    kept = described(seen).select(settled.alias("_settled"), *[F.when(settled, F.col(n)).alias(n) for n in wanted], F.when(waits, F.struct(*names)).alias("open"))
    scanned = stored(kept, "scanned")
    ends = scanned.where("open IS NOT NULL").select("open.*")

    # One row for the end of each part, and one without values for its beginning.
    after = [F.when(F.col(f"_when_{n}"), F.col(state)).otherwise(F.col(n)).alias(f"_in_{n}") for n, (_, state) in tracks.items()]
    tails = ends.where("_tail").select("_key", "_part", F.lit(1).alias("_kind"), F.col(first[0]).alias("_in_first"), *after)
    heads = ends.where("_head").select("_key", "_part", F.lit(0).alias("_kind"))
    earlier = Window.partitionBy("_key").orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    edges = tails.unionByName(heads, allowMissingColumns=True)
    come = [F.last(f"_in_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in tracks]
    incoming = edges.select("_part", "_kind", F.first("_in_first", ignorenulls=True).over(earlier).alias("_in_first"), *come)
    incoming = incoming.where("_kind = 0 AND _in_first IS NOT NULL").withColumn("_from", F.lit(True)).withColumnRenamed("_part", "_in_part")

    waiting = ends.where("_leading").join(F.broadcast(incoming), F.col("_part") == F.col("_in_part"), "left")  # a row a part at most
    late = waiting.withColumns({
        **{n: F.coalesce(n, f"_in_{n}") for n in tracks},
        first[0]: F.coalesce("_in_first", first[0]),
        "first_seen": F.col("first_seen") & F.col("_from").isNull(),
    })
    return scanned.where("_settled").select(*wanted).unionAll(described(late).select(*wanted))


def earlier_states(rows: DataFrame, key: str, order: str, keep: list[str], states: dict[str, Column], tracks: dict[str, tuple[Column, str]], first: tuple[str, str], result: Column) -> DataFrame:
    """The elements of ``result``, an array of structs for each row, made of what ``with_earlier`` has. The arrays are stored;
    where its structs repeat columns of the row, ``with_earlier`` stores less."""
    return with_earlier(rows, key, order, keep, states, tracks, first, [{"_result": result}]).select(F.inline("_result"))
