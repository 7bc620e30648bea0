"""Corpus pipeline: quality gate, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns
of documents. Between stages the rows are written as Parquet to the shared folder and read again.

Defined for every stage: an empty table gives no rows; further columns are carried unchanged, whatever their names (the last
stage returns pieces and leaves them out); a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import decontam, packing, quality, simhash
from catalith.llm.common import at_places, corpus, discard, free_name, row_key, table, with_key, with_places, written

#: Contaminated documents whose keys are broadcast, about 64 MB; with more the documents are dealt by key.
KNOWN_DIRTY = 1_000_000

#: The fixed tokenizer and the grown forest are outside SQL.
ORACLE_SQL = None


def quality_gate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    A row is judged by its text alone, so rows equal in text share their fate, with null ids and repeated ids too. Labels of
    ids that the documents lack are not used; without any usable label nothing is accepted (every score is 0.5).
    """
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.accepts(forest, F.col("text")))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest id (null last), then of the least digest of the text.

    Of rows equal in id and text the one stays whose other columns come first as JSON, and of those equal in all columns
    the first in the files. Null, empty and blank texts are one component, with all others whose fingerprint is near zero.
    Texts are read where they lie, for their fingerprints and again for the rows that stay; they are not shuffled.
    """
    place = free_name(docs, "place")
    placed = with_places(docs, place)
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    slim = placed.select("doc_id", "text", others.alias("others"), F.col(f"{place}.file").alias("file"), F.col(f"{place}.row").alias("row"))
    kept = simhash.survivors(slim, ("others", "file", "row"))
    return at_places(placed, place, kept)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Rows of one id with different texts are judged apart; repeated rows share their fate and stay repeated; texts without
    words and, with an empty benchmark, all documents stay.
    """
    key = free_name(docs, "row_key")
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    dirty = written(judged.select(row_key(F.col("doc_id"), F.col("digest")).alias(key)).distinct(), "dirty")
    if dirty.count() <= KNOWN_DIRTY:
        dirty = F.broadcast(dirty)
    return with_key(docs, key).join(dirty, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, as sequences. Repeated rows are packed separately; an empty text takes one place."""
    return packing.pack(docs)


STAGES = [
    ("quality_gate", quality_gate),
    ("near_duplicate_removal", near_duplicate_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
