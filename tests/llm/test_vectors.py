"""Clustering and exact search over embeddings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from catalith.llm import ball_clusters, top_k, vectors

SCHEMA = "vec_id long, embedding array<float>"


def scaled(rows, width=None):
    """(id, integer components) of the rows that count."""
    out = []
    for i, x, *_ in rows:
        if x is not None and (width is None or len(x) == width) and all(v is not None and np.isfinite(v) for v in x):
            out.append((i, [int(np.floor(64 * np.float64(np.float32(v)))) for v in x]))
    return out


def blobs(rng, n, width=64, places=6, spread=0.02):
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(places)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]


def odd_vectors(width=64):
    rng = random.Random(3)
    rows = list(enumerate(blobs(rng, 150, width)))
    hot = [0.25] * width
    rows += [(1000 + i, hot) for i in range(90)]  # a third are one vector
    rows += [(2000 + i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(30)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * (width - 1)), (3003, [1.0] * (width + 1)), (3004, [None] + [0.5] * (width - 1)), (3005, [float("nan")] + [0.5] * (width - 1))]
    rows += [(3006, [float("inf")] + [0.5] * (width - 1)), (7, rows[7][1]), (7, rows[8][1]), (3007, [-0.001] * width), (3008, [0.0] * width)]
    return rows


# --- scaling -------------------------------------------------------------------------------------------------------


def test_integer_rows_of_a_slice():
    column = pa.array([[9.0], [0.5, -0.01], None, [None, 1.0], [float("nan")], [], [1.0, 2.0, 3.0]], pa.list_(pa.float64()))
    at, rows = vectors.integer_rows(column.slice(1))
    assert at.tolist() == [0, 4, 5] and rows.tolist() == [[32, -1, 0], [0, 0, 0], [64, 128, 192]]
    at, rows = vectors.integer_rows(column.slice(1), 2)
    assert at.tolist() == [0] and rows.tolist() == [[32, -1]]
    assert vectors.integer_rows(column.slice(2, 1))[1].shape == (0, 0)
    with pytest.raises(ValueError, match="beyond"):
        vectors.integer_rows(pa.array([[1e30]], pa.list_(pa.float64())))


@pytest.mark.parametrize("most", [3, 60_000, 1 << 28])
def test_products_are_exact(most):
    rng = random.Random(1)
    a, b = [np.array([[rng.randint(-most, most) for _ in range(5)] for _ in range(n)]) for n in (7, 4)]
    assert vectors.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]


# --- clusters ------------------------------------------------------------------------------------------------------


def brute_clusters(rows):
    kept = scaled(rows, 64)
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:16]
    centroids = [x for _, x in first]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(centroids)), key=lambda k: (square(x, centroids[k]), k))
    for _ in range(3):
        of = [nearest(x) for _, x in kept]
        for k in range(len(centroids)):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    out = [(i, nearest(x), square(x, centroids[nearest(x)])) for i, x in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out)


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors()[:5], [(None, [0.5] * 64), (3, [0.25] * 64), (3, [0.25] * 64), (3, [0.75] * 64)], [(1, None)], []], ids=["odd", "few", "ids", "none", "empty"])
def test_clusters(spark, rows):
    got = ball_clusters.clusters(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows)


def test_clusters_with_small_trees_and_further_columns(spark, monkeypatch):
    monkeypatch.setattr(ball_clusters, "TREE_ROWS", 40)
    monkeypatch.setattr(ball_clusters, "LEAF_ROWS", 4)
    rows = [(i, x, 5, 1, [1.0], "t") for i, x in odd_vectors()]
    got = ball_clusters.clusters(spark.createDataFrame(rows, SCHEMA + ", cluster int, distance long, vectors array<double>, n string").repartition(3))
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows)


def test_balls_hold_their_rows_and_go_whole():
    rng = random.Random(4)
    rows = np.array([x for _, x in scaled(list(enumerate(blobs(rng, 700))))])
    order, radii, sums = ball_clusters.build_tree(rows)
    tree = rows[order]
    assert sorted(order) == list(range(700))
    ball = 0
    for level in range(ball_clusters.levels(700) + 1):
        at = ball_clusters.ends(700, level)
        for a, b in zip(at, at[1:], strict=False):
            assert (sums[ball] == tree[a:b].sum(axis=0)).all()
            assert np.sqrt(((tree[a:b] - sums[ball] / (b - a)) ** 2).sum(axis=1)).max() <= radii[ball] + 1e-9
            ball += 1
    assert ball == len(radii) == len(sums)
    centroids = rows[:16]
    whole, places, nearest = ball_clusters.walk(tree, radii, sums, centroids)
    exact = ((tree[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
    found = np.full(700, -1)
    found[places] = nearest
    for a, b, _, c in whole:
        assert (found[a:b] == -1).all()
        found[a:b] = c
    assert (found == exact).all() and any(b - a > 2 * ball_clusters.LEAF_ROWS for a, b, *_ in ball_clusters.walk(tree, radii, sums, rows[:2] * 3)[0])


# --- search --------------------------------------------------------------------------------------------------------


def brute_top(rows, k=20, asked=lambda i: i % 20 == 0):
    kept = [r for r in scaled(rows) if r[0] is not None]
    out = []
    for q, x in kept:
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in kept if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors()[:12], [*odd_vectors(6), (None, [0.1] * 6), (40, [5000.0] * 6), (60, [-90000.0] * 6)], [(20, [0.5])], [(20, None)], []], ids=["odd", "few", "large", "alone", "none", "empty"])
def test_top_k(spark, rows):
    got = top_k.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute_top(rows)


def test_top_k_in_waves_blocks_and_rounds(spark, monkeypatch):
    for name, value in {"WAVE_ROWS": 5, "BINS": 4, "BLOCK_QUERIES": 2, "BLOCK_VECTORS": 7}.items():
        monkeypatch.setattr(top_k, name, value)
    rows = [(i, x, 1, 2, "q") for i, x in odd_vectors(8)]
    df = spark.createDataFrame(rows, SCHEMA + ", rank int, score long, q string").repartition(3)
    assert Counter(map(tuple, top_k.top_k(df).collect())) == brute_top(rows)
    few = top_k.search(spark.createDataFrame(odd_vectors(8)[:3], SCHEMA), df, k=3)
    assert Counter(map(tuple, few.collect())) == brute_top(rows, 3, lambda i: i < 3)
