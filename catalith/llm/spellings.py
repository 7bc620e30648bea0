"""Operator 13: spelling variant grouping by an even-partition pigeonhole join.

A word of length L is cut into two halves. Of two words at one edit, one half is untouched: it is a half of the shorter
word and stands in the other at the same place, or, behind the edit, shifted by the difference of lengths. So every word
is indexed under its two halves and probes with the halves of words of its own length and of those one shorter, each at
the one place where it can stand. Words that meet are candidates; candidates are verified to be one edit apart, and a
pair found by both halves counts once.

Groups of words that share a half can be of any size (a frequent prefix). What is left of such words, without the half that
they share, must again be one edit apart, so a crowded group is cut by the halves of these rests, and so on until the group
is small or the rest is a single letter; of those a group holds as many as the alphabet allows. No group is compared whole
by one task, and nothing is dropped.

Defined results: a null text has no words; a null doc_id counts as empty in the hash; repeated rows count each; texts without
such words and empty tables give no rows; equal numbers of occurrences are decided by code points; further columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, written

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form has at least so many times the occurrences of its variant.
TIMES = 10
DROP_EVERY = 31
#: Letters, where A-Z are lower-cased already.
RUN = re.compile(rf"[a-z\u00C0-\u00FF]{{{LEAST_LENGTH},}}")
#: Comparisons that a group may cost before it is cut further.
COMPARISONS = 1 << 14
#: Distinct words that a task counts before it hands their counts on.
COUNTED = 200_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for some in slices(batch, "text"):
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
                for run, n in Counter(RUN.findall(lowered)).items():
                    h = zlib.crc32(run.encode(), head)
                    if h % DROP_EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= LEAST_LENGTH:
                        held[run] += n
            if len(held) >= COUNTED:
                yield of()
    yield of()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words and their occurrences over all documents."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- pairs ---------------------------------------------------------------------------------------------------------


def _placed(words: DataFrame) -> DataFrame:
    """Every word as indexed (``more`` null) and as probing: for words of its length (0) and of one less (1). The group of
    the first cut is the length of the indexed words."""
    role = lambda more: F.struct(F.lit(more).cast("int").alias("more"), (F.length("word") - (more or 0)).alias("size"))
    roles = words.select("word", "n", F.inline(F.array(role(None), role(0), role(1)))).where(F.col("size") >= LEAST_LENGTH)
    return roles.withColumns({"rest": F.col("word"), "group": F.col("size").cast("long")})


def _halved(rows: DataFrame) -> DataFrame:
    """Each row under the two halves of its rest: ``size`` is the length of the indexed words' rests."""
    half, more = F.floor(F.col("size") / 2).cast("int"), F.coalesce("more", F.lit(0))
    rest, n = F.col("rest"), F.length("rest")

    def cut(which: int, shared: Column, left: Column, size: Column) -> Column:
        return F.struct(F.xxhash64("group", F.lit(which), shared).alias("group"), left.alias("rest"), size.alias("size"))

    head = cut(1, F.substring(rest, F.lit(1), half), F.substring(rest, half + 1, n), F.col("size") - half)
    tail = cut(2, F.substring(rest, half + more + 1, n), F.substring(rest, F.lit(1), half + more), half)
    return rows.select("word", "n", "more", F.inline(F.array(head, tail)))


def _crowded(rows: DataFrame) -> DataFrame:
    """Groups that cost too much and can be cut."""
    indexed, probing = F.count_if(F.col("more").isNull()), F.count_if(F.col("more").isNotNull())
    counted = rows.groupBy("group").agg(indexed.alias("indexed"), probing.alias("probing"), F.min("size").alias("least"))
    return counted.where((F.col("indexed") * F.col("probing") > COMPARISONS) & (F.col("least") > 1)).select("group")


def _met(rows: DataFrame) -> DataFrame:
    """Verified pairs of the words that meet in a group: (word, n, near, near_n) with ``word`` the probing one."""
    indexed = rows.where("more IS NULL").select("group", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("rest").alias("near_rest"))
    probing = rows.where("more IS NOT NULL").select("group", "word", "n", "more", "rest")
    once = (F.col("more") == 1) | (F.col("word") < F.col("near"))  # of one length both probe for each other
    return probing.join(indexed, "group").where(once & (F.levenshtein("rest", "near_rest", 1) == 1)).select("word", "n", "near", "near_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each unordered pair of words at one edit, once."""
    rows, found = written(_halved(_placed(words)), "halves"), []
    while True:
        crowded = written(_crowded(rows), "crowded")
        if crowded.isEmpty():
            found.append(written(_met(rows), "near"))
            discard(rows)
            break
        found.append(written(_met(rows.join(crowded, "group", "left_anti")), "near"))
        finer = written(_halved(rows.join(crowded, "group", "left_semi")), "halves")
        discard(rows)
        rows = finer
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


# --- groups --------------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer jumping: a form has ``TIMES`` the occurrences of its variant, so
    chains are short."""
    table = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_root = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(table.select("word", "root").join(next_root, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(table)
        table = new
        if table.where("moved").isEmpty():
            return table.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: its form, the root at the end of the forms, occurrences, number of near words, the form's occurrences."""
    words = written(vocabulary(docs), "vocabulary")
    pairs = near_pairs(words)
    swapped = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    per_word = pairs.union(swapped).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has_form = -F.col("best.less") >= TIMES * F.col("n")
    grouped = words.join(per_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")
    )
    grouped = written(grouped, "variants")
    roots = _roots(grouped.where("form IS NOT NULL"))
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# --- the same in DuckDB, by words with one letter left out ----------------------------------------------------------

ORACLE = rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
coded AS (SELECT run, n, list_transform(range(1, length(doc_id || ':' || run) + 1), lambda i: unicode((doc_id || ':' || run)[i])::BIGINT) AS u FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM coded, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
holes AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
UNION SELECT DISTINCT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.a || h.b UNION SELECT DISTINCT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.a || h.b),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS b FROM near GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {TIMES} * n THEN b.near END AS form, CASE WHEN -b.less >= {TIMES} * n THEN -b.less END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN last USING (word)
"""
