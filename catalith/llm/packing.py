"""Operator 6: hierarchical multi-length packing.

A document is cut into full windows of the longest context size; its rest is routed to the smallest context tier that
holds it. Each tier's rests open windows of the tier's size, longest tier first; the gap of a window is filled by the
best-fitting rests of shorter tiers, and at last by the head of one more document, cut to fit. Windows thus come out
exactly full, at a power of two; only what is left at the end of an input partition makes one padded sequence.
Finished sequences are dealt to step groups of ``STEP_TOKENS`` places (padding included), largest first to the lightest
group, some ``HELD_STEPS`` groups at a time. Only as many go as make full groups, which tiers that divide each other and the
group always do exactly; the rest waits. What an input partition leaves in the end, less than a group, is numbered by tier
and dealt over all partitions, longest tier first; so only the very last group of all may be light.

Packing is local to an input partition and streams through it: nothing is shuffled, and memory holds one slice of texts
fewer than two windows of carried rests, and the windows of ``HELD_STEPS`` groups. Numbers of sequences and groups are made
global from the totals of each partition, and for what it leaves of each tier.

Defined results: a null text counts as empty and still takes one place (its end id); a null doc_id is carried; equal
rows are packed separately; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets, slices, written
from .tokens import END_ID, encode_with_end, tokenizer_path

TIERS = (256, 512, 1024, 2048, 4096)
STEP_TOKENS = 16 * 4096
HELD_STEPS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, sequence long, offset long, tier int, step long"


class Packer:
    """Packs rests given as (length, document); a window is (tier, pieces) with pieces (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = tiers, tiers[-1]
        self.rests: list[tuple[int, int, int]] = []  # length, document, start within it; ascending
        self.total = 0

    def add(self, doc: int, tokens: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        full = tokens - tokens % self.longest
        for start in range(0, full, self.longest):
            yield self.longest, [(doc, start, self.longest)]
        if tokens > full:
            insort(self.rests, (tokens - full, doc, full))
            self.total += tokens - full

    def _take(self, k: int) -> tuple[int, int, int]:
        self.total -= self.rests[k][0]
        return self.rests.pop(k)

    def window(self) -> tuple[int, list[tuple[int, int, int]]]:
        """The window that the longest rest opens; the rests together must fill its tier."""
        length, doc, start = self._take(len(self.rests) - 1)
        tier = next(t for t in self.tiers if t >= length)
        pieces, gap = [(doc, start, length)], tier - length
        while gap and self.rests:
            k = bisect_right(self.rests, (gap, 1 << 62, 0)) - 1
            if k >= 0:  # the longest rest that fits
                length, doc, start = self._take(k)
                pieces.append((doc, start, length))
                gap -= length
            else:  # none fits: the head of the shortest one
                length, doc, start = self._take(0)
                pieces.append((doc, start, gap))
                insort(self.rests, (length - gap, doc, start + gap))
                self.total += length - gap
                gap = 0
        return tier, pieces

    def windows(self, keep: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Windows while more than ``keep`` tokens of rests are there."""
        while self.total > keep:
            yield self.window()

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows of the largest tier that the remaining tokens fill, then one padded sequence."""
        while self.rests:
            tier = next((t for t in reversed(self.tiers) if t <= self.total), self.longest)
            gap, pieces = min(tier, self.total), []
            while gap:
                length, doc, start = self._take(len(self.rests) - 1)
                part = min(gap, length)
                pieces.append((doc, start, part))
                gap -= part
                if part < length:
                    insort(self.rests, (length - part, doc, start + part))
                    self.total += length - part
            yield tier, pieces


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Group of each sequence: largest first, each to the lightest of about total / step_tokens groups."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (load + sizes[i], g))
    return out


def full_groups(windows: list, step_tokens: int = STEP_TOKENS) -> tuple[list, list[int], list]:
    """The windows that make full groups, the group of each, and the windows left, which have less than a group's places
    where tiers divide each other."""
    order = sorted(windows, key=lambda w: -w[0])
    room = sum(w[0] for w in order) // step_tokens * step_tokens
    taken = bisect_right(list(accumulate(w[0] for w in order)), room)
    full = order[:taken]
    return full, step_groups([w[0] for w in full], step_tokens), order[taken:]


def _pack(path: str, tiers: tuple[int, ...], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(tiers)
        held: dict[int, tuple[int | None, memoryview, int, int]] = {}  # number: doc_id, ids, tokens, tokens not yet placed
        number = sequence = step = waiting = 0
        windows: list = []  # finished, not yet in a step group

        def rows(windows: list, steps: list[int]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for (tier, pieces), group in zip(windows, steps, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    name, raw, tokens, left = held[doc]
                    out.append((name, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), tokens, part, sequence, offset, tier, group))
                    offset += length
                    if left == length:
                        del held[doc]
                    else:
                        held[doc] = (name, raw, tokens, left - length)
                sequence += 1
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [f.split()[0] for f in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

        def grouped() -> pa.RecordBatch:
            nonlocal windows, step
            full, groups, windows = full_groups(windows)
            steps = [step + g for g in groups]
            step += max(groups, default=-1) + 1
            return rows(full, steps)

        for batch in batches:
            for some in slices(batch, "text"):
                ids, counts = encode_with_end(path, [t or "" for t in some.column(1).to_pylist()], end_id)
                stops = np.cumsum(counts).tolist()
                ids = ids.astype("<u4")
                before = len(windows)
                for name, b, c in zip(some.column(0).to_pylist(), stops, counts.tolist(), strict=True):
                    held[number] = (name, memoryview(ids[b - c : b].tobytes()), c, c)
                    windows += packer.add(number, c)
                    number += 1
                windows += packer.windows(2 * packer.longest)
                waiting += sum(tier for tier, _ in windows[before:])
                if waiting >= HELD_STEPS * STEP_TOKENS:
                    yield grouped()
                    waiting = sum(tier for tier, _ in windows)
        windows += packer.finish()
        yield grouped()
        number_in_tier: Counter[int] = Counter()
        left = []  # -1 - number of a window among those of its tier that are left
        for tier, _ in windows:
            number_in_tier[tier] += 1
            left.append(-number_in_tier[tier])
        yield rows(windows, left)

    return run


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where its ids stand in its document and in which sequence, at which place."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(slim.mapInArrow(_pack(path or tokenizer_path(), tiers, end_id), PIECES), "pieces")
    totals = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n"), F.greatest(F.max("step") + 1, F.lit(0)).alias("m"))
    offsets = running_offsets(running_offsets(totals, "part", "n", "n0"), "part", "m", "m0").select("part", "n0", "m0", F.sum("m").over(Window.partitionBy()).alias("m_all"))
    # Places that the sequences left by earlier partitions, longest tier first, take: a row for each partition and tier.
    left = pieces.where("step < 0 AND offset = 0").groupBy("part", "tier").agg((F.count("*") * F.first("tier")).alias("places"))
    left = running_offsets(left.withColumn("at", F.struct(-F.col("tier"), "part")), "at", "places", "left0").select("part", "tier", "left0")
    dealt = F.floor((F.col("left0") + (-1 - F.col("step")) * F.col("tier")) / STEP_TOKENS)
    step = F.when(F.col("step") < 0, F.col("m_all") + dealt).otherwise(F.col("step") + F.col("m0"))
    numbered = pieces.join(F.broadcast(offsets), "part").join(F.broadcast(left), ["part", "tier"], "left")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("n0")).alias("sequence_id"), "offset", "tier", step.cast("long").alias("step_group"))
