"""Documents that every operator of the subpackage must take, and helpers for brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, digest string, fp long, words array<string>, part int, shard int, label string, count long, quality int"


def words(rng: random.Random, n: int) -> str:
    some = ["alpha", "Beta", "gamma,", "delta.", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "42", "don't", "x_y", "λόγος", "日本語"]
    return " ".join(rng.choice(some) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    texts = [None, "", "   \n\t ", "one", "two words", "a\x00b\x1cc d e　f", "É" * 300, words(rng, 30_000), "tie tie tie tie", "<|endoftext|> and <|startoftext|>."]
    rows = [(i, t, "en", "web", None) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "web", None), (3, "other text of id three", None, None, None), (None, "no id", "en", None, None), (None, None, None, None, None)]
    base = words(rng, 200)
    rows += [(100 + i, base, "en", "hot", None) for i in range(12)]  # copies
    rows += [(200 + i, f"{base} {words(rng, 1)}", "en", "hot", None) for i in range(8)]  # near copies
    rows += [(300 + i, words(rng, rng.randint(1, 400)), "en", "web", None) for i in range(40)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def clashing(spark):
    rows = [(1, "some text here", "d", 5, ["w"], 3, 4, "l", 9, 0), (2, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CLASHING)


def key(row: tuple) -> str:
    return repr(row)
