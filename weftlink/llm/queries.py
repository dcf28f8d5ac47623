"""Queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.byte_bpe import byte_bpe_digests
from weftlink.llm.chat import conversation_digests, format_conversations
from weftlink.llm.class_lm import fit_class_model, score_texts
from weftlink.llm.collocations import collocations, collocations_sql
from weftlink.llm.common import share
from weftlink.llm.dim_kmeans import lloyd, lloyd_sql
from weftlink.llm.hyperminhash import near_duplicates, near_duplicates_sql
from weftlink.llm.language import fit_languages, identify
from weftlink.llm.ngram_join import similarity_classes
from weftlink.llm.packing import pack_documents
from weftlink.llm.phrases import edit_sensitivity
from weftlink.llm.token_store import stored_token_digests
from weftlink.llm.toxicity import fit_toxicity, score_toxicity
from weftlink.llm.vector_search import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_token_digests(_table(spark, sf_dir, "documents"))


def op2_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_sensitivity(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    fixed = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    more = spark.createDataFrame(fixed, "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(turns.unionByName(more)))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, share("doc_id", 3) != 1)
    return score_toxicity(docs, model).withColumn("held_out", share("doc_id", 3) == 1)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_class_model(docs, share("doc_id", 5) != 1)
    return score_texts(docs, model).withColumn("held_out", share("doc_id", 5) == 1)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_languages(docs, share("doc_id", 4) != 2)
    return identify(docs, model).withColumn("held_out", share("doc_id", 4) == 2)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(_table(spark, sf_dir, "documents"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op12_dim_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_phrase_fingerprint": op2_phrase_fingerprint,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_chat_format": op4_chat_format,
    "op5_pack": op5_pack,
    "op6_toxicity": op6_toxicity,
    "op7_nearest": op7_nearest,
    "op8_class_lm": op8_class_lm,
    "op9_language": op9_language,
    "op10_ngram_join": op10_ngram_join,
    "op11_hyperminhash": op11_hyperminhash,
    "op12_dim_kmeans": op12_dim_kmeans,
    "op13_collocations": op13_collocations,
}
#: The other operators have no form in plain SQL; tests/llm compares them with brute force.
LLM_SQL: dict[str, str] = {
    "op11_hyperminhash": near_duplicates_sql(),
    "op12_dim_kmeans": lloyd_sql(),
    "op13_collocations": collocations_sql(),
}
