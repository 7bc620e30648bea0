"""Operator 9: quality classifier, histogram gradient-boosted trees over document statistics.

A text becomes a fixed row of statistics (shares of byte classes, word and line repetition, lengths). Trees are grown on
the driver from a bounded sample of labelled rows (``SAMPLE_ROWS``, a parameter), on values cut into ``BINS`` quantile
bins. All trees are flattened into arrays of split feature, threshold and leaf value, in heap order, so that a batch of
rows walks one level of one tree in a few numpy operations.

Defined results: a null text counts as empty and is scored; a null doc_id is carried and not held out; labels of rows
held out (crc32 of the id as text, modulo 4, is 2) are never read; several labels of an id count by their mean; labels
that are null or without a document are ignored; without labels every score is 0.5, with one class it is that class;
equal rows get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, slices

SAMPLE_ROWS = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
L2 = 1.0
LEAST_ROWS = 20
ACCEPT = 0.7

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "stop_comma", "mark", "line_break", "non_ascii", "word_length", "long_word",
    "distinct_words", "repeated_next", "distinct_lines", "line_length", "closed_lines", "capital_words", "bare_words", "longest_word",
)
_BYTE_CLASS = np.full(256, 5)  # marks
_BYTE_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_BYTE_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_BYTE_CLASS[[*b"0123456789"]] = 2
_BYTE_CLASS[[*b" \t\r\x0b\x0c"]] = 3
_BYTE_CLASS[[*b".,;:"]] = 4
_BYTE_CLASS[10] = 6
_BYTE_CLASS[128:] = 7


def statistics(text: str | None) -> list[float]:
    """The statistics named in ``FEATURES``; zeros for an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    share = np.bincount(_BYTE_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=8) / n
    words = raw.split()
    count = max(1, len(words))
    lines = raw.split(b"\n")
    sizes = [*map(len, words)] or [0]
    return [
        float(np.log1p(n)), share[0], share[1], share[2], share[4], share[5], share[6], share[7],
        sum(sizes) / count, sum(s > 15 for s in sizes) / count,
        len(set(words)) / count, sum(map(eq, words, words[1:])) / count,
        len(set(lines)) / len(lines), n / len(lines), sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        sum(w[:1].isupper() for w in words) / count, sum(not w[:1].isalnum() and w[:1] < b"\x80" for w in words) / count, float(np.log1p(max(sizes))),
    ]


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


# --- trees ---------------------------------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees in heap order: children of node k are 2k+1 and 2k+2; a node without a split sends all rows left."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        z = np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += value[node - inner]
        return 1 / (1 + np.exp(-z))


def _edges(column: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower"))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for the logistic loss by second-order gains over binned values."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = float(y.mean()) if len(y) else 0.5
    if mean in (0.0, 1.0) or not len(y):
        z = {0.0: -20.0, 1.0: 20.0}.get(mean, 0.0)
        return Forest(z, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [_edges(x[:, f]) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)  # bin b holds values up to edge b
    base = float(np.log(mean / (1 - mean)))
    z = np.full(len(y), base)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    columns = np.arange(x.shape[1]) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * (x.shape[1] * BINS) + columns + bins).ravel()
            shape = (width, x.shape[1], BINS)
            sums = [np.bincount(slot, np.repeat(v, x.shape[1]), width * x.shape[1] * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = sums, [s[:, :1, -1:] for s in sums]
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(nl < LEAST_ROWS) | (na - nl < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        z += value[t, leaf]
    return Forest(base, feature, threshold, value)


# --- on Spark ------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``rows`` labelled documents that are not held out, picked by a hash of their ids."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("quality"))
        .where(F.col("quality").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
        .groupBy("label_id").agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            for some in slices(batch, "text"):
                x = feature_rows(some.column(1).to_pylist())
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([some.column(0), flat, some.column(2)], names=["doc_id", "x", "quality"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = slim.join(F.broadcast(marked), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")
    got = sample.mapInArrow(run, "doc_id long, x array<double>, quality double").orderBy("doc_id", "x").limit(2 * rows).toPandas()
    if not len(got):
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    return grow(np.stack(got.x.to_numpy()), (got.quality.to_numpy() >= 0.5).astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(forest.score(feature_rows(some.column(1).to_pylist())))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepts(forest: Forest, text: Column) -> Column:
    """Whether a text is accepted, for use as a filter. Texts become Python objects in bounded slices."""

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        drop_kept()
        some = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")
        marks = [forest.score(feature_rows(x.column(0).to_pylist())) >= ACCEPT for x in some]
        return pa.array(np.concatenate(marks) if marks else [], pa.bool_())

    return accepted(text)
