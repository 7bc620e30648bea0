"""Registered queries of this subpackage: one for each operator, and the pipeline over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_clusters, decontam, edit_counts, html_density, media, notices, packing, quality, sharding, simhash, simple8b, spellings, top_k
from .common import corpus, table


def op1_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_output(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("digest")


def op3_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(corpus(spark, sf_dir))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over the stored pages, whose references have no payloads among the sample tables."""
    return media.page_sequences(corpus(spark, sf_dir, "pages"))


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(corpus(spark, sf_dir, "pages"))


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edit_counts(corpus(spark, sf_dir))


def op6_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(corpus(spark, sf_dir))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(corpus(spark, sf_dir)).drop("digest", "label")


def op9_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan(corpus(spark, sf_dir))


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(corpus(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_simple8b_tokens, op2_decontamination, op3_media_sequences, op4_text_density, op5_edit_aware_counts,
        op6_hierarchical_packing, op7_minimax_shards, op8_simhash_anchors, op9_boosted_quality, op10_fuzzy_notices,
        op11_ball_clusters, op12_exact_top_k, op13_spelling_variants, page_sequences,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontam.ORACLE, "op11_ball_clusters": ball_clusters.ORACLE, "op12_exact_top_k": top_k.ORACLE,
        "op13_spelling_variants": spellings.ORACLE,
    }
