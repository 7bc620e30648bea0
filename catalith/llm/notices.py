"""Operator 10: license notices, found fuzzily.

Short notices are searched in the words of a text with a bounded number of character edits. A notice allowed k edits is
cut into k + 1 seeds; of any match, one seed at least is unedited (pigeonhole), so exact finds of the seeds locate all
candidates. Around each, the regex library's bounded-error matching verifies the edits and gives the span. A span begins
and ends with whole words; edits may stand anywhere inside it, spaces included.

Base phrases are exact: places where their words stand consecutively.

Defined results: a null text counts as empty: no words, no labels, score 0; a null doc_id is carried; equal rows are
judged separately and alike; overlapping places all count; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices with their labels and the edits allowed, for texts as words joined by single spaces.
NOTICES = (
    ("all rights reserved", "reserved", 2),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("licensed under cc by", "cc-by", 1),
    ("dedicated to the public domain", "public-domain", 3),
)
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, edits: int>>"


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts of about equal length with their places."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def _compiled():
    import regex

    return [(regex.compile(f"(?e)(?:{regex.escape(n, special_only=True)}){{e<={k}}}(?![^ ])"), n, label, k, seeds(n, k)) for n, label, k in NOTICES]


def word_text(text: str | None) -> str:
    """Words ([0-9a-z] and non-ASCII after lower-casing A-Z) joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()).decode("utf-8")


def _finds(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _word_starts(text: str, lo: int, hi: int) -> Iterator[int]:
    """Places of first letters of words from lo to hi."""
    at = 0 if lo <= 0 else text.find(" ", lo - 1, hi) + 1 or hi + 1
    while at <= hi:
        yield at
        at = text.find(" ", at, hi) + 1 or hi + 1


def fuzzy(text: str) -> Iterator[tuple[str, int, int, int, float]]:
    """(label, start, stop, edits, likeness) of the best spans of each notice that do not overlap, fewest edits first.

    A seed found at its place, give or take the edits before it, fixes where a span may start.
    """
    for pattern, notice, label, k, parts in _compiled():
        starts = {s for place, part in parts for at in _finds(text, part) for s in _word_starts(text, at - place - k, at - place + k)}
        matched = []
        for s in sorted(starts):
            word_end = text.find(" ", s + len(notice) + k)
            if m := pattern.match(text, s, len(text) if word_end < 0 else word_end):
                matched.append((sum(m.fuzzy_counts), s, m.end()))
        taken: list[tuple[int, int]] = []  # ascending and apart
        for edits, s, e in sorted(matched):
            k_after = bisect_left(taken, (s, 0))
            if (k_after == 0 or taken[k_after - 1][1] <= s) and (k_after == len(taken) or taken[k_after][0] >= e):
                taken.insert(k_after, (s, e))
                yield label, s, e, edits, 1 - edits / len(notice)


def word_numbers(words: str, places: Iterable[int]) -> list[int]:
    """Number of the word at each place; the text is walked once, however many places there are."""
    places = list(places)
    number, at, of = 0, 0, {}
    for p in sorted(set(places)):
        number += words.count(" ", at, p)
        of[p], at = number, p
    return [of[p] for p in places]


def scan_text(text: str | None) -> tuple:
    words = word_text(text)
    n_words = words.count(" ") + 1 if words else 0
    padded = f" {words} "
    base: dict[str, list[int]] = {}
    for phrase, label in BASE.items():
        if places := word_numbers(padded, _finds(padded, f" {phrase} ")):
            base[label] = places
    found = list(fuzzy(words))
    firsts, lasts = word_numbers(words, [f[1] for f in found]), word_numbers(words, [max(f[1], f[2] - 1) for f in found])
    spans = [{"label": f[0], "first_word": a, "last_word": b, "edits": f[3]} for f, a, b in zip(found, firsts, lasts, strict=True)]
    best = max([1.0 if base else 0.0, *(f[4] for f in found)])
    starts = [p for places in base.values() for p in places]
    labels = sorted({*base, *(s["label"] for s in spans)})
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), best, spans


def scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            for some in slices(batch, "text"):
                rows = [scan_text(t) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, RESULT)
