"""Operator 1: token-id output in Simple-8b blocks.

Every 64-bit word holds a 4-bit selector and 60 bits of payload; the selector says how many ids of which width the
payload packs. Ids of 60 bits and more leave an escape mark in the payload and stand in the block's escape list. A
block carries the index of the first id of every ``OFFSET_STEP``-th word, so that a reader can decode any range of it.

The file format is a Parquet folder of blocks; file order, then block order, is ascending doc_id order.

Defined results: a null text counts as empty (only the end id); a null doc_id sorts first; rows with one doc_id are
ordered by the head and a hash of their texts, equal rows stay separate rows; an empty table gives no blocks; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_offsets, slices, written
from .tokens import END_ID, encode_with_end, tokenizer_path

# The published Simple-8b selectors, as (ids in a word, bits of each).
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in SELECTORS], np.int64)
ESCAPE = (1 << 60) - 1
OFFSET_STEP = 64
BLOCK_IDS = 1 << 16

BLOCKS = "part int, block long, before long, doc_ids array<long>, doc_counts array<long>, n_ids long, words binary, offsets binary, escapes binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value (uint8); 0 for 0."""
    return np.searchsorted(np.array([1 << b for b in range(60)], np.uint64), values, side="right").astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, offsets (index of the first id of every OFFSET_STEP-th word) and escaped ids of an array of uint64."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    big = values >= np.uint64(ESCAPE)
    escapes, plain = values[big], np.where(big, np.uint64(ESCAPE), values)
    small = plain < (1 << 20)
    if small.all():
        width = _WIDTH_OF[plain.astype(np.int64)] if n else np.zeros(0, np.uint8)
    else:
        width = _widths(plain)
    # Widest of the next 1, 2, 3 ... ids, each from two shorter runs; behind the end stand zeros, which fit anywhere.
    run = {1: np.concatenate([width, np.zeros(240, np.uint8)])}

    def widest(k: int) -> np.ndarray:
        if k not in run:
            half = 1 << ((k - 1).bit_length() - 1)
            a = widest(half)
            b = a[k - half :]
            run[k] = np.maximum(a[: len(b)], b)
        return run[k]

    choice = np.full(n, len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        fits = widest(SELECTORS[s][0])[:n] <= SELECTORS[s][1]
        if not fits.any() and SELECTORS[s][0] >= 60:
            continue
        choice[fits] = s
    step = COUNTS[choice].tolist()
    starts: list[int] = []
    i = 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    chosen = choice[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([plain, np.zeros(240, np.uint64)])
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.flatnonzero(chosen == s)):
            here = at[mine]
            for k in range(count):
                words[mine] |= padded[here + k] << np.uint64(k * bits)
    return words, at[::OFFSET_STEP].astype(np.uint32), escapes


_WIDTH_OF = np.repeat(np.arange(21, dtype=np.uint8), [1, *(1 << max(b - 1, 0) for b in range(1, 21))])


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` ids of whole words, selector by selector."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.flatnonzero(chosen == s)):
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[first[mine] + k] = (words[mine] >> np.uint64(k * bits)) & mask
    out = out[:n]
    if len(escapes):
        out[out == np.uint64(ESCAPE)] = escapes
    return out


def unpack_range(words: np.ndarray, offsets: np.ndarray, n: int, escapes: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi - 1 by decoding only the word groups that hold them (blocks with escapes are decoded whole)."""
    if len(escapes) or hi <= lo:
        return unpack(words, n, escapes)[lo:hi]
    a = int(np.searchsorted(offsets, lo, side="right")) - 1
    b = int(np.searchsorted(offsets, hi, side="left"))
    base = int(offsets[a])
    stop = int(offsets[b]) if b < len(offsets) else n
    return unpack(words[a * OFFSET_STEP : b * OFFSET_STEP], stop - base, escapes)[lo - base : hi - base]


def _as_blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("words", pa.binary()), ("offsets", pa.binary()), ("escapes", pa.binary())])
        part = TaskContext.get().partitionId()
        block = before = 0
        for batch in batches:
            for some in slices(batch, "text"):
                docs = some.column(0).to_pylist()
                ids, counts = encode_with_end(path, [t or "" for t in some.column(1).to_pylist()], end_id)
                stops = np.cumsum(counts)
                rows, first = [], 0
                while first < len(docs):  # whole documents until a block is full
                    base = int(stops[first - 1]) if first else 0
                    last = min(max(int(np.searchsorted(stops, base + BLOCK_IDS)), first) + 1, len(docs))
                    words, offsets, escapes = pack(ids[base : int(stops[last - 1])])
                    rows.append((part, block, before, docs[first:last], counts[first:last].tolist(), int(stops[last - 1]) - base, words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()))
                    before += int(stops[last - 1]) - base
                    block, first = block + 1, last
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def encode_corpus(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids, each document closed by ``end_id``, and return the stored blocks.

    One range shuffle of the texts puts them in doc_id order; tokenizing comes after it, so that the shuffle's sampling
    does not encode anything. Rows of one doc_id (or none) are dealt out too: by their texts, and equal ones by where they
    were read.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = ["doc_id", F.substring("text", 1, 64), F.xxhash64("text"), F.col("source_part")]
    ordered = ordered.withColumn("source_part", F.spark_partition_id()).repartitionByRange(*place).sortWithinPartitions(*place).drop("source_part")
    return written(ordered.mapInArrow(_as_blocks(path or tokenizer_path(), end_id), BLOCKS), "token-blocks")


def decode_corpus(blocks: DataFrame) -> DataFrame:
    """Read the stored blocks back: one row per document with its global start, length and checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), r["n_ids"], np.frombuffer(r["escapes"], "<u8")).astype("<u4")
                counts = np.array(r["doc_counts"], np.int64)
                stops = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(stops.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(stops - counts + r["before"] + r["part_start"]), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = running_offsets(totals, "part", "n", "part_start").select("part", "part_start")
    return blocks.join(F.broadcast(starts), "part").select("before", "part_start", "doc_ids", "doc_counts", "n_ids", "words", "escapes").mapInArrow(run, RESULT)


def token_output(docs: DataFrame, path: str | None = None) -> DataFrame:
    return decode_corpus(encode_corpus(docs, path))
