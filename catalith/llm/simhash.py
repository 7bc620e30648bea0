"""Operator 8: SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at ``THRESHOLD`` = 3 or fewer differing bits. Of two linked fingerprints, one of two disjoint
31-bit halves differs in one bit at most. Each half is covered by the perfect Hamming code of length 31, whose words
(the anchors) have covering radius 1: every half lies within 1 of exactly one anchor, its centre. A half is replicated
to every anchor within radius + 1 = 2 (1 or 16 of them), so of two halves that differ in one bit, both reach the centre
of either. Only fingerprints that share an anchor are compared, over all 64 bits.

Exact copies never meet: distinct fingerprints are compared, and documents join their fingerprint's component at the
end. A crowded anchor is cut into cells (centre chunk, member chunk), sized by its centres and by its members, so no
task holds it whole; cells without a centre are passed over, since every link meets at a centre. Inside a cell a search
from member to member gives a spanning forest of the links rather than all pairs.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; fewer than three words are
one shingle; rows with equal ids are separate rows; a null doc_id never names a component unless all of its ids are
null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, drop_kept, slices, written

THRESHOLD = 3
SHINGLE = 3
SEED = 42
HALF_BITS = 31
#: An anchor with more members than this is cut into cells of about so many, centres and members each.
CELL = 5_000
#: Halves within 2 bits of an anchor.
REACH = 1 + HALF_BITS + HALF_BITS * (HALF_BITS - 1) // 2
SMALL_GROUP = 32


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the XXH64 of the 3-word shingles, repeats included."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    width = min(SHINGLE, len(words))
    hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)])
    n = len(hashes) // 8
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    counts = sum(np.unpackbits(rows[k : k + 16384], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, n, 16384))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, digest of the text, fp) of each row, and the columns ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            for some in slices(batch, "text"):
                texts = some.column(1).to_pylist()
                digests = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(digests), pa.array([fingerprint(t) for t in texts], pa.int64()), *some.columns[2:]], names=["doc_id", "digest", "fp", *carried])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("fp", T.LongType()), *slim.schema.fields[2:]]
    return slim.mapInArrow(run, T.StructType(kinds))


# --- anchors -------------------------------------------------------------------------------------------------------


def _syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the set bits: 0 for an anchor, else the place whose flip leads to the centre."""
    s = np.zeros(len(half), np.int64)
    for bit in range(HALF_BITS):
        s ^= np.where((half >> bit) & 1, bit + 1, 0)
    return s


def half_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``half``, anchor) for every anchor within 2 bits; a half's first entry is its centre."""
    s = _syndrome(half)
    own = np.arange(len(half))
    flip = np.concatenate([[0], 1 << np.arange(HALF_BITS, dtype=np.int64)])  # by place
    at, anchors = [own], [half ^ flip[s]]
    odd = np.flatnonzero(s)
    for i in range(1, HALF_BITS + 1):
        j = i ^ s[odd]
        some = odd[i < j]
        at.append(some)
        anchors.append(half[some] ^ flip[i] ^ flip[i ^ s[some]])
    return np.concatenate(at), np.concatenate(anchors)


ANCHORED = "anchor long, fp long, centre boolean"


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for lo in range(0, len(fp), 20_000):
            some = fp[lo : lo + 20_000]
            for which in (0, 1):
                half = (some >> (which * HALF_BITS)) & ((1 << HALF_BITS) - 1)
                at, anchor = half_anchors(half)
                centre = np.arange(len(at)) < len(half)
                yield pa.RecordBatch.from_arrays([pa.array(anchor * 2 + which), pa.array(some[at]), pa.array(centre)], names=["anchor", "fp", "centre"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for which in (0, 1):
            half = (fp >> (which * HALF_BITS)) & ((1 << HALF_BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(half * 2 + which)], names=["half"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each half, with how many fingerprints it brings as members and as centres."""
    for batch in batches:
        coded, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at, anchor = half_anchors(coded >> 1)
        centre = np.arange(len(at)) < len(coded)
        yield pa.RecordBatch.from_arrays([pa.array(anchor * 2 + (coded[at] & 1)), pa.array(n[at]), pa.array(np.where(centre, n[at], 0))], names=["anchor", "members", "centres"])


def _in_cells(anchored: DataFrame, prints: DataFrame) -> DataFrame:
    """Give crowded anchors cells (c, m): centres of chunk c against members of chunk m.

    Members are counted by half. Halves of CELL / REACH fingerprints or fewer are left out: together they add CELL at
    most to an anchor. So counting costs two rows a fingerprint, and a cell holds about twice CELL of a kind at most.
    """
    heavy = prints.select("fp").mapInArrow(_halves, "half long").groupBy("half").count().where(F.col("count") > CELL // REACH)
    reached = heavy.select("half", F.col("count").alias("n")).mapInArrow(_reached, "anchor long, members long, centres long")
    crowd = reached.groupBy("anchor").agg(F.sum("members").alias("members"), F.sum("centres").alias("centres")).where(F.col("members") > CELL)
    # At most 32 * fingerprints / CELL rows. Written, so that Spark knows the size and broadcasts it only under its threshold;
    # else the replicas would be dealt by anchor for this join and again by cell.
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / CELL)).cast("int")
    crowd = written(crowd.select("anchor", chunks("centres").alias("kc"), chunks("members").alias("km")), "crowded-anchors")
    kc, km = F.coalesce("kc", F.lit(1)), F.coalesce("km", F.lit(1))
    chunk = lambda k: F.pmod(F.xxhash64("fp"), k).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), kc - 1), lambda c: c * km + chunk(km))
    as_centre = F.transform(F.sequence(F.lit(0), km - 1), lambda m: chunk(kc) * km + m)
    cells = F.when(kc * km == 1, F.array(F.lit(0))).when(F.col("centre"), F.array_distinct(F.concat(as_member, as_centre))).otherwise(as_member)
    return anchored.join(crowd, "anchor", "left").select("anchor", F.explode(cells).alias("cell"), "fp", "centre")


# --- links ---------------------------------------------------------------------------------------------------------


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``fp``: each found member searches only among those not yet found."""
    left, edges = fp, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= THRESHOLD
            if near.any():
                edges += [(int(x), int(y)) for y in left[near]]
                todo += list(left[near])
                left = left[~near]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (anchor, cell); a run may span batches, its fingerprints are carried."""
    held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]

    def of(cols: list[np.ndarray]) -> pa.RecordBatch:
        anchor, cell, fp, centre = cols
        starts = lambda: np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])])) if len(fp) else np.zeros(0, np.int64)
        if len(fp):
            new = starts()
            led = np.repeat(np.logical_or.reduceat(centre, new), np.diff(np.concatenate([new, [len(fp)]])))
            anchor, cell, fp = anchor[led], cell[led], fp[led]
        new = starts()
        sizes = np.diff(np.concatenate([new, [len(fp)]]))
        found: list[np.ndarray] = []
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for s in range(1, min(SMALL_GROUP, int(sizes.max(initial=1)))):
            i = np.flatnonzero((group[s:] == group[:-s]) & small[s:])
            if not len(i):
                break
            i = i[np.bitwise_count((fp[i] ^ fp[i + s]).view(np.uint64)) <= THRESHOLD]
            found.append(np.stack([fp[i], fp[i + s]], axis=1))
        for g in np.flatnonzero(sizes > SMALL_GROUP):
            if edges := _forest(fp[new[g] : new[g] + sizes[g]]):
                found.append(np.array(edges, np.int64))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        keep = int(last[-1]) + 1 if len(last) else 0
        held = [c[keep:] for c in cols]
        if keep:
            yield of([c[:keep] for c in cols])
    yield of(held)


def links(prints: DataFrame) -> DataFrame:
    """Pairs of distinct fingerprints (column ``fp``) that connect all that link."""
    anchored = prints.select("fp").mapInArrow(_replicate, ANCHORED)
    cells = _in_cells(anchored, prints).select("anchor", F.col("cell").cast("long").alias("cell"), "fp", "centre")
    dealt = cells.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) with the least node of each component, by minimum labels over neighbours and pointer jumping.

    Each round is written to the shared folder, so a lost executor repeats one round at most; the round before is deleted.
    """
    both = written(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")), "links")
    stored = labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        hop = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(hop.join(up, "label").select("node", F.least("label", "up").alias("label"), (F.least("label", "up") < F.col("old")).alias("moved")), "labels")
        discard(stored)
        stored, labels = new, new.select("node", "label")
        if new.where("moved").isEmpty():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id of its component; also a digest of the text and
    the component's least fingerprint (``label``)."""
    prints = written(fingerprints(docs), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = components(written(links(nodes), "pairs"))
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = named.join(least, "label").select(F.col("fp").alias("node_fp"), "component_id", "label")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(of_print, F.col("fp") == F.col("node_fp")).select("doc_id", hexed, "component_id", "digest", "label")


def survivors(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, digest, and the columns ``carried``) of the document of each component that stays: the smallest id, nulls
    last, then the least digest, then the least of what is carried. Rows are reduced by fingerprint before they meet labels."""
    prints = fingerprints(docs, carried)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", *carried)
    nodes = written(prints.groupBy("fp").agg(F.min(order).alias("first")), "nodes")
    labels = components(written(links(nodes), "pairs"))
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("label", "fp").alias("label"))
    return named.groupBy("label").agg(F.min("first").alias("kept")).select("kept.*").drop("last")
