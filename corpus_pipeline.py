"""The corpus pipeline: five operators one after the other over ``documents``.

Each stage takes what its predecessor kept and gives the columns of ``documents``; the last gives the packed
pieces. Between stages the documents are a table in the shared folder.

Cases, beside those of each operator: a null text is an empty one, which the quality rules reject, so that later stages see
texts alone; null ids, languages and sources pass; repeated rows are copies, of which one stays; texts of any length are
judged, masked and packed whole; further columns pass every stage but the last, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import op1_ngram_jaccard, op2_toxicity, op3_mixture_packing, op5_secret_scans, op8_quality_rules, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers go; so do null and empty texts."""
    return op8_quality_rules.good_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the last link of the chain flags go; without labels of both kinds, none."""
    return op2_toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: that with the smallest id, null ids last."""
    return op1_ngram_jaccard.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that are no copied examples are masked in the text, and ``n_chars`` follows; every document stays."""
    return op5_secret_scans.redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens that hold every source in proportion; each token of each document lies in one piece."""
    return op3_mixture_packing.pack_mixture(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("packing", packing),
]

#: SQL can't express the estimates, the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch.passing(spark) as written:  # a stage's working tables go once its result is a table
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.delete(spark, before)
        before = written[-1]
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
