"""Operator 12: exact top-k search by distributed selection over histograms of scores.

Queries are taken in waves of bounded size, each against all vectors in blocks. A wave scores everything once for each
round of refinement: the first round counts, for every query, how many scores fall into each of ``BINS`` equal bins of the
range that the norms allow; the bin with the kth highest score becomes the next round's range, until bins are one integer
wide and the kth score is known. The last scoring keeps all higher scores and, among those equal to it, as many of the
smallest ids as are missing. Scores are computed anew rather than stored; what is shuffled is a few counts, then the results.

A task hands on only bins down to its own kth score, since the global one is no lower, and at most k rows a query.

Defined results: vectors that are null or hold null or non-finite components, or have no vec_id, take no part; shorter
vectors count as filled up with zeros; all rows of a query's vec_id are its own and are no candidates for it; repeated
rows are candidates, and queries, each (the results of repeated queries are repeated); fewer candidates than k give as many
rows; empty tables give no rows; further columns are ignored. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .vectors import SCALE, integer_rows, products

K = 20
EVERY = 20
BINS = 256
#: Queries of a wave: at most so many, and so many components in all (128 MB as 64-bit integers on the driver and in every task).
WAVE_ROWS = 16_384
WAVE_COMPONENTS = 1 << 24
#: Scores held at once are so many queries by so many vectors.
BLOCK_QUERIES, BLOCK_VECTORS = 1_024, 2_048

_LAST = np.iinfo(np.int64).max


def _blocks(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, kind: type) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries of the block, ids of its vectors in order, scores of queries by vectors, each query whose own rows are there and
    the first and the place behind the last of these)."""
    for batch in batches:
        at, rows = integer_rows(batch.column(1))
        if rows.shape[1] < queries.shape[1]:
            rows = np.pad(rows, ((0, 0), (0, queries.shape[1] - rows.shape[1])))
        rows = rows[:, : queries.shape[1]]  # beyond, all queries are zero
        named = batch.column(0).to_numpy(zero_copy_only=False)[at]
        for lo in range(0, len(at), BLOCK_VECTORS):
            own = named[lo : lo + BLOCK_VECTORS]
            order = np.argsort(own, kind="stable")
            own, some = own[order], rows[lo : lo + BLOCK_VECTORS][order]
            for q in range(0, len(ids), BLOCK_QUERIES):
                part = slice(q, min(q + BLOCK_QUERIES, len(ids)))
                first, stop = np.searchsorted(own, ids[part], "left"), np.searchsorted(own, ids[part], "right")
                mine = np.flatnonzero(stop > first)
                yield part, own, products(queries[part], some).astype(kind, copy=False), np.stack([mine, first[mine], stop[mine]], axis=1)


def _histogram(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, kind: type, low: np.ndarray, width: int, needed: np.ndarray) -> DataFrame:
    """(q, bin, needed, n): how many scores of query number q lie in each bin above ``low``, over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ids), BINS + 2), np.int64)  # first and last: below and above the range
        for part, _, scores, own in _blocks(batches, ids, queries, kind):
            bins = (scores - low[part, None].astype(kind)) // kind(width) + 1
            np.clip(bins, 0, BINS + 1, out=bins)
            for q, first, stop in own:
                bins[q, first:stop] = 0
            size = len(bins)
            bins += (np.arange(size, dtype=bins.dtype) * (BINS + 2))[:, None]
            n[part] += np.bincount(bins.ravel(), minlength=size * (BINS + 2)).reshape(size, -1)
        n = n[:, 1:-1]
        higher = n[:, ::-1].cumsum(axis=1)[:, ::-1] - n
        q, b = np.nonzero((n > 0) & (higher < needed[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(needed[q]), pa.array(n[q, b])], names=["q", "bin", "needed", "n"])

    return vectors.mapInArrow(run, "q long, bin long, needed long, n long").groupBy("q", "bin", "needed").agg(F.sum("n").alias("n"))


def _selected(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, kind: type, kth: np.ndarray, missing: np.ndarray, k: int) -> DataFrame:
    """(q, query_id, vec_id, score): scores above the kth, and the smallest ids of those equal to it, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tied = np.full((len(ids), k), _LAST)
        n_tied = np.zeros(len(ids), np.int64)

        def of(q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q]), pa.array(vec), pa.array(score.astype(np.int64))], names=["q", "query_id", "vec_id", "score"])

        for part, named, scores, own in _blocks(batches, ids, queries, kind):
            for q, first, stop in own:
                scores[q, first:stop] = np.iinfo(kind).min
            limit = kth[part, None].astype(kind)
            q, c = np.nonzero(scores > limit)
            if len(q):
                yield of(q + part.start, named[c], scores[q, c])
            q, c = np.nonzero(scores == limit)
            place = np.arange(len(q)) - np.searchsorted(q, q)  # vectors of a block are in order of their ids
            early = place < missing[part][q]
            q, c, place = q[early], c[early], place[early]
            if len(q):
                rows, at = np.unique(q, return_inverse=True)
                new = np.full((len(rows), 2 * k), _LAST)
                new[:, :k] = tied[part][rows]
                new[at, k + place] = named[c]
                new.sort(axis=1)
                tied[part.start + rows] = new[:, :k]
                n_tied[part.start + rows] = np.minimum(n_tied[part.start + rows] + np.bincount(at), k)
        q, place = np.nonzero(np.arange(k) < np.minimum(n_tied, missing)[:, None])
        yield of(q, tied[q, place], kth[q])

    return vectors.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def _wave(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, most: int, k: int) -> DataFrame:
    """Results of a wave's queries; no score is beyond ``most`` either way."""
    kind = np.int32 if most < 1 << 28 else np.int64
    low, needed, all_of = np.full(len(ids), -most), np.full(len(ids), k), np.zeros(len(ids), bool)
    width = 1
    while width * BINS < 2 * most + 1:
        width *= BINS
    from_top = Window.partitionBy("q").orderBy(F.desc("bin"))
    while width:
        upto = _histogram(vectors, ids, queries, kind, low, width, needed).withColumn("upto", F.sum("n").over(from_top))
        place = F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("higher"))).alias("place")
        found = upto.where("upto >= needed").groupBy("q").agg(place).select("q", "place.*").toPandas()  # a row for each query of the wave at most
        q = found.q.to_numpy(np.int64)
        few = np.ones(len(ids), bool)
        few[q] = False
        all_of |= few
        low[q] += width * found["bin"].to_numpy(np.int64)
        needed[q] -= found.higher.to_numpy(np.int64)
        needed[all_of] = 0  # these are not counted further
        width //= BINS
    low[all_of] = -most - 1
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = _selected(vectors, ids, queries, kind, low, needed, k).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


RESULT = "query_id long, rank int, vec_id long, score long"


def _slim(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = integer_rows(batch.column(1))[1].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([(rows**2).sum(axis=1).max(initial=0)])], names=["square"])


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """The k best vectors of every query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    queries, vectors = _slim(queries), _slim(vectors)
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    rows = max(1, min(WAVE_ROWS, WAVE_COMPONENTS // max(1, width)))
    stored = written(queries.repartition(max(1, -(-n // rows))), "queries")  # a file for each wave
    reach = vectors.mapInArrow(_squares, "square double").agg(F.max("square")).first()[0] or 0.0
    waves = []
    for file in sorted(stored.inputFiles()):
        asked = spark.read.schema(stored.schema).parquet(file).toArrow().combine_chunks()  # bounded by ``rows``
        if asked.num_rows:
            at, matrix = integer_rows(asked.column(1).chunk(0))
            if len(at):
                ids = asked.column(0).to_numpy()[at]
                square = float((matrix.astype(np.float64) ** 2).sum(axis=1).max())
                most = isqrt(int(reach * square * 1.001)) + 1  # Cauchy-Schwarz, with room for rounding
                waves.append(written(_wave(vectors, ids, matrix, most, k), "top-k"))
    discard(stored)
    return spark.read.schema(RESULT).parquet(*[w.stored_at for w in waves]) if waves else spark.createDataFrame([], RESULT)


def top_k(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``EVERY``."""
    return search(embeddings.where(F.col("vec_id").cast("long") % EVERY == 0), embeddings)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s) WHERE rank <= {K}
"""
