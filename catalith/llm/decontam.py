"""Operator 2 [native]: benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (the whole item where it has fewer). A window, seen as the
set of its shingles of ``SHINGLE`` words, is contained in a document only if every one of its shingles is, so one
shingle is a sufficient prefix: the rarest one over the whole corpus. The steps are

1. a first scan of the documents counts how often each benchmark shingle occurs, shingles of all widths at once; only
   counts leave it;
2. keep each window's rarest shingle as its prefix;
3. a second scan keeps, of every document, its number of words, and every position of a prefix with the few words around
   it, so what is kept does not grow with shingles that the corpus is full of;
4. join the kept positions with the windows of their prefixes; the prefix's place in the window fixes where the window
   would start (positional bound) and the document must reach to its end (length bound); compare the words there;
5. merge the verified windows of a document into hit words, and map windows back to items.

Up to ``KNOWN_SHINGLES`` distinct benchmark shingles are broadcast as they are. Of more, a bitmap of at most
``MOST_BITS`` bits (256 MB) is broadcast, 16 bits a shingle as long as that allows: it passes all benchmark shingles and a
few others, which the joins of steps 1 and 4 drop, then dealt by shingle. Documents never shuffle their words: only the
kept positions and one row per document do.

Defined results: a null or empty text has no words and is clean; a null doc_id is carried; rows equal in id and text get
equal results, rows of one id with different texts are judged apart; items without words match nothing; repeated items
count once per item_id; an empty benchmark leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_BITS, ascii_lower, bit_at, written

WINDOW = 13
SHINGLE = 5
#: Distinct shingles and windows that are broadcast, about 100 MB each.
KNOWN_SHINGLES = 2_000_000
KNOWN_WINDOWS = 200_000
MOST_BITS = 1 << 31
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(at: str, pos: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(F.col(at), pos + k) for k in range(width)])


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with their words; rows are told apart by id and a digest of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), words(text).alias("words"))


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, window) for each item, and the distinct windows (window, window_words, width of their shingles)."""
    items = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    cut = items.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))), lambda i: F.slice("w", i, WINDOW))).alias("window_words"),
    ).distinct()
    cut = written(cut.withColumn("window", F.md5(F.array_join("window_words", " "))), "bench-windows")
    distinct = cut.select("window", "window_words").distinct().withColumn("width", F.least(F.size("window_words"), F.lit(SHINGLE)))
    return cut.select("item_id", "window"), distinct


def _of_width(widths: list[int], width: Column, at: str, pos: Column) -> Column:
    """The shingle of the row's width at ``pos``."""
    return F.coalesce(*[F.when(width == w, _shingle(at, pos, w)) for w in widths])


def _window_shingles(distinct: DataFrame, widths: list[int]) -> DataFrame:
    placed = distinct.select("window", "window_words", "width", F.explode(F.sequence(F.lit(0), F.size("window_words") - F.col("width"))).alias("at"))
    return placed.select("window", "window_words", "at", _of_width(widths, F.col("width"), "window_words", F.col("at")).alias("shingle"))


def _known(positions: DataFrame, shingles: DataFrame) -> DataFrame:
    """The rows without a shingle, and those whose shingle the benchmark has, or may have where it is large."""
    own = shingles.select("shingle").distinct()
    n = own.count()
    if n <= KNOWN_SHINGLES:
        known = F.broadcast(own.withColumnRenamed("shingle", "known"))
        return positions.join(known, F.col("shingle") == F.col("known"), "left").where(F.col("shingle").isNull() | F.col("known").isNotNull()).drop("known")
    bits = min(MOST_BITS, max(BUCKET_BITS, 1 << (16 * n - 1).bit_length()))
    slot = F.pmod(F.col("shingle"), F.lit(bits))
    bucket, place = F.floor(slot / BUCKET_BITS), slot % BUCKET_BITS
    bitmap = own.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    found = bit_at(F.col("bits"), place)
    return positions.join(F.broadcast(bitmap), bucket == F.col("bucket"), "left").where(F.col("shingle").isNull() | found).drop("bucket", "bits")


def _positions(docs: DataFrame, widths: list[int], whole: bool) -> DataFrame:
    """Every position of the documents' words with its shingle, for each width; with ``whole`` also a row for each document
    (``pos`` null)."""
    k, n = F.col("k"), len(widths)
    placed = _keyed(docs).select("*", F.explode(F.sequence(F.lit(-1), F.size("words") * n - 1)).alias("k"))
    # k is -1 for the document and else runs over positions and widths.
    pos = F.when(k >= 0, (k / n).cast("int")) if n else F.lit(None).cast("int")
    width = F.get(F.array(*[F.lit(w) for w in widths]), k % n) if n else F.lit(1)
    placed = placed.select("doc_id", "digest", "words", pos.alias("pos"), width.alias("width"))
    inside = F.col("pos") + F.col("width") <= F.size("words")
    placed = placed.where(F.col("pos").isNull() | inside if whole else inside)
    return placed.select("doc_id", "digest", "words", "pos", F.when(F.col("pos").isNotNull(), _of_width(widths or [1], F.col("width"), "words", F.col("pos"))).alias("shingle"))


def prefixes(docs: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """(shingle, at, window, window_words): the rarest shingle of each window that can occur, and its place there.

    A window of which a shingle is in no document has that as its rarest, and is left out.
    """
    known = _known(_positions(docs, widths, whole=False).select("shingle"), shingles)
    counts = known.groupBy("shingle").count()
    order = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "shingle", "at")
    ranked = shingles.join(counts, "shingle", "left").withColumn("rank", F.row_number().over(order))
    return written(ranked.where((F.col("rank") == 1) & F.col("count").isNotNull()).select("shingle", "at", "window", "window_words"), "bench-prefixes")


def scan(docs: DataFrame, prefix: DataFrame, widths: list[int]) -> DataFrame:
    """One row for each document (``pos`` null) and one for each position whose shingle is a prefix, or may be, with the
    words from ``first`` on that any window around it can touch."""
    first = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    kept = _known(_positions(docs, widths, whole=True), prefix).select(
        "doc_id", "digest", F.size("words").alias("n_words"), "pos", "shingle",
        F.when(F.col("pos").isNotNull(), first).alias("first"),
        F.when(F.col("pos").isNotNull(), F.slice("words", first + 1, F.col("pos") - first + WINDOW)).alias("around"),
    )
    return written(kept, "bench-positions")


def occurrences(kept: DataFrame, prefix: DataFrame) -> DataFrame:
    """Verified occurrences of benchmark windows: doc_id, digest, window, first word, one past the last word."""
    hits = kept.where(F.col("pos").isNotNull())
    if prefix.count() <= KNOWN_WINDOWS:
        prefix = F.broadcast(prefix)
    start, size = F.col("pos") - F.col("at"), F.size("window_words")
    found = (
        hits.join(prefix, "shingle")
        .where((start >= 0) & (start + size <= F.col("n_words")))
        .where(F.slice("around", start - F.col("first") + 1, size) == F.col("window_words"))
    )
    return written(found.select("doc_id", "digest", "window", start.alias("first"), (start + size).alias("stop")), "bench-occurrences")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, and the contamination verdict."""
    item_windows, distinct = windows(benchmark)
    widths = [r[0] for r in distinct.select("width").distinct().orderBy("width").collect()]  # at most SHINGLE values
    shingles = written(_window_shingles(distinct, widths or [1]), "bench-shingles")
    prefix = prefixes(docs, shingles, widths)
    kept = scan(docs, prefix, widths)
    occurring = occurrences(kept, prefix)
    # Hit words: windows in order of their first word, each adding what reaches beyond all earlier ones.
    order = Window.partitionBy("doc_id", "digest").orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = occurring.select("doc_id", "digest", "first", "stop").distinct()
    gain = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("first"), F.coalesce(F.max("stop").over(order), F.lit(0))))
    hits = spans.withColumn("gain", gain).groupBy("doc_id", "digest").agg(F.sum("gain").alias("n_hit"))
    items = (
        occurring.select("doc_id", "digest", "window").distinct()
        .join(item_windows, "window")
        .groupBy("doc_id", "digest")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    judged = hits.join(items, (hits.doc_id.eqNullSafe(items.doc_id)) & (hits.digest == items.digest)).select(
        hits.doc_id.alias("hit_id"), hits.digest.alias("hit_digest"), "n_hit", "items"
    )
    docs_words = kept.where(F.col("pos").isNull()).select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return docs_words.join(judged, (F.col("digest") == F.col("hit_digest")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "digest",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bp AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s, least(len(w), 13) AS n FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dp),
occ AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (s, n)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM occ),
h AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
