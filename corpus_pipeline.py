"""Corpus pipeline: keep what language identification accepts, one document of each group of near copies,
and what no benchmark passage contaminates; replace personal data; pack the rest into sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, ngram_join, packing, pii
from tidemark.llm.common import settle, table

KEY, TEXT, LANGUAGE, SOURCE = "doc_id", "text", "lang", "source"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, TEXT, LANGUAGE, SOURCE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a similarity of 0.8 or more; the smallest id of each group stays."""
    return ngram_join.keep_one(docs, KEY, TEXT, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, TEXT, table(spark, sf_dir, "benchmark"), "item_id", "text")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The length of a text changes with it, so n_chars is counted anew."""
    out, counts = pii.replace(docs, TEXT)
    chars = F.coalesce(F.length(TEXT).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.withColumn("n_chars", chars).drop(counts)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, KEY, F.col(TEXT))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("pii_surrogates", replace_personal_data),
    ("best_two_fit", pack),
]

# Trained models, keyed surrogates and a tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
