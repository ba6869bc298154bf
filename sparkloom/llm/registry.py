"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op1_ngram_jaccard, op2_toxicity, op3_mixture_packing, op4_pruned_graph, op5_secret_scans, op6_token_counts, op7_best_fit, op8_quality_rules, op9_byte_bpe, op10_warc, op11_snapshot_diff, op12_exact_dedup, op13_spelling_variants, scratch

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixture_packing_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixture_packing.pack_mixture(_read(spark, sf_dir, "documents"), JSON, size=1024, end_id=0, alpha=0.7)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "packed")
    return op7_best_fit.read_packed(op7_best_fit.write_packed(_read(spark, sf_dir, "documents"), JSON, folder), folder)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ngram_jaccard.ngram_jaccard(_read(spark, sf_dir, "documents"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pruned_graph.nearest(_read(spark, sf_dir, "embeddings"), "_id % 50 = 0", k=5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secret_scans.secret_scan(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "bundles")
    return op10_warc.read_bundles(op10_warc.write_bundles(_read(spark, sf_dir, "pages"), folder, min_bytes=0), folder)


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_token_counts.token_counts(_read(spark, sf_dir, "documents"), JSON, limit=512)


def op9_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_byte_bpe.round_trip(_read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_snapshot_diff_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return op11_snapshot_diff.snapshot_diff(docs, op11_snapshot_diff.later_snapshot(docs), "doc_id", ["text", "lang", "source"], ["text", "lang"])


def op12_exact_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), scratch.new_path(spark, "index"))


def op13_spelling_variants_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling_variants.spelling_variants(_read(spark, sf_dir, "documents"))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality_rules.base_rules(_read(spark, sf_dir, "documents"))


_QUERIES = (
    op1_ngram_jaccard_join, op2_toxicity_chain, op3_mixture_packing_pieces, op4_nearest_vectors, op5_secret_scan, op6_token_count, op7_best_fit_packing, op8_quality,
    op9_byte_bpe_round_trip, op10_warc_bundles, op11_snapshot_diff_rekeyed, op12_exact_dedup_index, op13_spelling_variants_forms, quality_base_rules,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard.SQL, "op4_nearest_vectors": op4_pruned_graph.SQL, "op5_secret_scan": op5_secret_scans.SQL, "op10_warc_bundles": op10_warc.SQL,
        "op11_snapshot_diff_rekeyed": op11_snapshot_diff.SQL, "op12_exact_dedup_index": op12_exact_dedup.SQL, "op13_spelling_variants_forms": op13_spelling_variants.SQL,
               "quality_base_rules": op8_quality_rules.SQL,
    }
