"""Operator 11: centroid clustering by filtering ball trees.

Every input partition is cut into runs of at most ``TREE_ROWS`` vectors. Of each run a balanced metric tree is built once
and stored: vectors in tree order, and for every ball its radius, count and exact integer sum. A round walks
the trees level by level with all centroids. Where the triangle inequality leaves a ball one centroid, the ball's count
and sum go there whole; else the centroids that it rules out are dropped and the halves are looked at, down to leaves,
whose vectors are compared exactly. A task hands on one count and sum per centroid, so a round shuffles a few rows a
task, and the centroids (a fixed number) are all that reaches the driver.

Bounds of balls are floating-point with a margin, and only decide what is compared: every distance and sum that
reaches a result is of integers, and ties go to the centroid of the smaller number.

Defined results: vectors that are null, not of ``WIDTH`` components, or with null or non-finite components are left out;
repeated rows count each; a null vec_id is assigned and returned, but starts no centroid; fewer vectors with an id than
centroids make as many centroids as there are; an empty table gives no rows; further columns are ignored. A component
beyond 2**27 after scaling is an error, since its distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .vectors import SCALE, integer_rows, products

WIDTH = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
TREE_ROWS = 2_048
LEAF_ROWS = 32

#: Of a run: ids and vectors in tree order; radius and sum of every ball, level after level. Counts follow from the places.
TREES = "ids array<long>, vectors binary, radii binary, sums binary"


# --- trees ---------------------------------------------------------------------------------------------------------


def levels(n: int) -> int:
    """Levels below the root of a tree whose leaves hold at most ``LEAF_ROWS`` of ``n`` rows."""
    return (-(-n // LEAF_ROWS) - 1).bit_length()


def ends(n: int, level: int) -> np.ndarray:
    """Where the balls of a level begin in tree order, and where the last one ends."""
    return (np.arange((1 << level) + 1) * n) >> level


def build_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tree order of the rows, radius and integer sum of every ball, level after level).

    A ball is cut at the median of its projection on the line between two members that lie far apart.
    """
    n, order, x = len(rows), np.arange(len(rows)), rows.astype(np.float64)
    radii, sums = [], []
    for level in range(levels(n) + 1):
        at, below = ends(n, level), ends(n, level + 1)
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            own, total = x[order[a:b]], rows[order[a:b]].sum(axis=0)
            away = np.sqrt(((own - total / (b - a)) ** 2).sum(axis=1))
            radii.append(away.max())
            sums.append(total)
            if level < levels(n):
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                order[a:b] = order[a:b][np.argpartition(own @ (other - far), below[2 * i + 1] - a)]
    return order, np.array(radii), np.array(sums)


def walk(rows: np.ndarray, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Filter a tree's balls by the centroids.

    Returns the balls that go to one centroid whole, as (first row, row behind the last, ball, centroid), and of all other
    rows the places and the exactly nearest centroids.
    """
    n, first = len(rows), 0
    active, possible = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    whole: list[tuple[int, int, int, int]] = []
    for level in range(levels(n) + 1):
        at = ends(n, level)
        centre = sums[first + active] / np.diff(at)[active, None]
        d = np.sqrt(((centre[:, None] - centroids) ** 2).sum(axis=2))
        d[~possible] = np.inf
        r, least = radii[first + active][:, None], d.min(axis=1, keepdims=True)
        possible = d - r <= (least + r) + 1e-9 * (1 + least + r)
        alone = possible.sum(axis=1) == 1
        whole += [(int(at[k]), int(at[k + 1]), int(first + k), int(c)) for k, c in zip(active[alone], possible[alone].argmax(axis=1), strict=True)]
        active, possible = active[~alone], possible[~alone]
        if level < levels(n):
            first += 1 << level
            active, possible = np.concatenate([2 * active, 2 * active + 1]), np.concatenate([possible, possible])
    sizes = np.diff(at)[active]
    places = np.repeat(at[active], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    d = (centroids**2).sum(axis=1) - 2 * products(rows[places], centroids).astype(np.int64)  # less the row's own square
    d[~np.repeat(possible, sizes, axis=0)] = np.iinfo(np.int64).max
    return whole, places, d.argmin(axis=1)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, rows = pa.array([], pa.int64()), np.zeros((0, WIDTH), np.int64)

    def of(ids: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
        order, radii, sums = build_tree(rows)
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (rows[order].astype(np.int32), radii, sums)]
        return pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(order))], pa.list_(pa.int64())), *packed], names=["ids", "vectors", "radii", "sums"])

    for batch in batches:
        at, new = integer_rows(batch.column(1), WIDTH)
        ids, rows = pa.concat_arrays([ids, batch.column(0).take(pa.array(at))]), np.concatenate([rows, new])
        while len(rows) >= TREE_ROWS:
            yield of(ids[:TREE_ROWS], rows[:TREE_ROWS])
            ids, rows = ids[TREE_ROWS:], rows[TREE_ROWS:]
    if len(rows):
        yield of(ids, rows)


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        ids, vectors, radii, sums = (c[i] for c in batch.columns)
        yield ids.values, np.frombuffer(vectors.as_py(), np.int32).reshape(-1, WIDTH).astype(np.int64), np.frombuffer(radii.as_py()), np.frombuffer(sums.as_py(), np.int64).reshape(-1, WIDTH)


# --- on Spark ------------------------------------------------------------------------------------------------------


def _starts(slim: DataFrame) -> np.ndarray:
    kept = F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)) & (F.size("embedding") == WIDTH)
    first = slim.where(kept & F.col("vec_id").isNotNull()).orderBy(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256), "embedding").limit(CENTROIDS)
    rows = [r.embedding for r in first.select("embedding").collect()]  # at most CENTROIDS
    return integer_rows(pa.array(rows, pa.list_(pa.float64())), WIDTH)[1]


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, rows, radii, sums in _stored(batch):
                whole, places, nearest = walk(rows, radii, sums, centroids)
                for a, b, ball, c in whole:
                    n[c] += b - a
                    total[c] += sums[ball]
                n += np.bincount(nearest, minlength=len(n))
                np.add.at(total, nearest, rows[places])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    partial = trees.mapInArrow(run, "cluster long, n long, total array<long>")
    exact = [F.sum(F.get("total", F.lit(j)).cast("decimal(20,0)")).alias(f"s{j}") for j in range(WIDTH)]
    out = centroids.copy()
    for r in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # at most CENTROIDS rows
        out[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(WIDTH)]
    return out


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, radii, sums in _stored(batch):
                whole, places, nearest = walk(rows, radii, sums, centroids)
                cluster = np.zeros(len(rows), np.int32)
                cluster[places] = nearest
                for a, b, _, c in whole:
                    cluster[a:b] = c
                distance = ((rows - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(embeddings: DataFrame) -> DataFrame:
    """One row per kept vector: its cluster and squared distance, the inertia of the cluster and of all, and a digest of the
    cluster's final centroid."""
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    spark = slim.sparkSession
    centroids = _starts(slim)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = written(slim.mapInArrow(_trees, TREES), "ball-trees")
    for _ in range(ROUNDS):
        centroids = _moved(trees, centroids)
    assigned = written(_assigned(trees, centroids), "assigned")
    discard(trees)
    of = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # at most CENTROIDS rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(c, i, sum(of.values()), digests[c]) for c, i in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# --- the same in DuckDB --------------------------------------------------------------------------------------------


def _oracle() -> str:
    """Assignments as joins with all centroids, one after another."""
    kept = "isfinite(x::DOUBLE)"
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: {kept})) = {WIDTH})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, e AS c FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CENTROIDS})",
    ]
    distance = f"list_sum(list_transform(range(1, {WIDTH} + 1), lambda i: (e[i] - c[i]) * (e[i] - c[i])))::BIGINT"
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, min(struct_pack(d := d, cluster := cluster)) AS a FROM (SELECT vec_id, e, cluster, {distance} AS d FROM v, c{k}) GROUP BY vec_id)")
        if k < ROUNDS:
            sums = f"SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT a.cluster AS cluster, i, floor(sum(e[i]) / count(*))::BIGINT AS m FROM a{k}, (SELECT unnest(range(1, {WIDTH} + 1)) AS i) GROUP BY 1, 2) GROUP BY 1"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.cluster, coalesce(s.c, c{k}.c) AS c FROM c{k} LEFT JOIN ({sums}) s USING (cluster))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c.cluster::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY c.cluster)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.cluster = a.cluster"""


ORACLE = _oracle()
