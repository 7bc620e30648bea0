"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from catalith.llm import spellings

from .samples import CLASHING, documents, odd_rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


def texts():
    rng = random.Random(11)
    base = ["abcdefgh", "connection", "Ångström", "éééééééé", "aaaaaaaa", "prefixedword", "prefixedworld", "straßenbahn", "ÀÿÀÿÀÿÀ"]
    rows = odd_rows()
    for i in range(60):
        said = []
        for _ in range(120):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w) + 1), rng.choice("abéxÿ")
                w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            said.append(w)
        rows.append((5000 + i % 50, rng.choice([" ", "-", "3", "ň"]).join(said), "en", "web", None))
    rows += [(6000 + i, "hotprefix" + "".join(rng.choice("ab") for _ in range(6)), None, None, None) for i in range(300)]
    return rows


@pytest.mark.parametrize("comparisons", [1, 30, spellings.COMPARISONS])
def test_variants(spark, monkeypatch, comparisons):
    """Also with groups cut down to single letters."""
    monkeypatch.setattr(spellings, "COMPARISONS", comparisons)
    rows = texts()
    got = Counter(map(tuple, spellings.variants(documents(spark, rows)).collect()))
    want = brute(rows)
    assert got == want and sum(1 for r in want if r[1]) > 20 and any(r[2] != r[1] for r in want if r[1])


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spellings, "COUNTED", 3)
    rows = texts()[:40]
    got = {r.word: r.n for r in spellings.vocabulary(documents(spark, rows)).collect()}
    assert got == {r[0]: r[3] for r in brute(rows)}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "wordword wordword", None, None, None), (1, "", None, None, None)]], ids=["empty", "null", "no id"])
def test_few_rows(spark, rows):
    assert Counter(map(tuple, spellings.variants(documents(spark, rows)).collect())) == brute(rows)


def test_further_columns(spark):
    rows = [(i, "wordword wordwore", "d", 5, ["w"], 3, 4, "l", 9, 0) for i in range(3)]
    assert Counter(map(tuple, spellings.variants(spark.createDataFrame(rows, CLASHING)).collect())) == brute(rows)
