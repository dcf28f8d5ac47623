"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm.common import share
from weftlink.llm.language import fit_languages, known_language
from weftlink.llm.ngram_join import one_of_each_class
from weftlink.llm.packing import pack_documents
from weftlink.llm.toxicity import fit_toxicity, without_toxic
from weftlink.session import cut_lineage, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; learnt from the labels of two thirds of them."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), share("doc_id", 3) != 1)
    return without_toxic(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in reach of a language learnt from three quarters of them."""
    return known_language(docs, fit_languages(docs, share("doc_id", 4) != 2))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share five-word shingles at a similarity of 0.8 or more."""
    return one_of_each_class(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces, each with its sequence and place there."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_copies", near_copies), ("best_fit_packing", best_fit_packing)]

#: Texts that a Python task gets at a time.
BATCH_ROWS = 1000

#: Tokens, phrases and fitted models have no form in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        with small_batches(spark, BATCH_ROWS):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES):
                docs = cut_lineage(docs)
    return docs
