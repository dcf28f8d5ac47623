"""Registered queries: a Spark form and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.sources.parquet import spread


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = Query(build, sql)
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are long texts."""
    return spread(table(spark, sf_dir, name))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, keyset, embedding`` of every vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("keyset"), "embedding"
    )


VECTORS = """
  vectors AS (
    SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS keyset, CAST(embedding AS DOUBLE[]) AS e
    FROM embeddings),
  units AS (
    SELECT id, keyset, e, sqrt(list_dot_product(e, e)) AS len FROM vectors)"""

EDGES = (
    VECTORS
    + """,
  edges AS (
    SELECT a.id AS id_a, b.id AS id_b, a.keyset AS keyset_a, b.keyset AS keyset_b,
           list_dot_product(a.e, b.e) / (a.len * b.len) AS raw_sim,
           round(CAST(list_dot_product(a.e, b.e) / (a.len * b.len) AS DOUBLE), 6) AS sim
    FROM units a JOIN units b ON a.id <> b.id)"""
)


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as definitions, the parts they ordered as cited works, their segment as keyset."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        lines.join(orders, "o_orderkey")
        .join(customers, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("o_custkey").cast("string").alias("id"),
            F.col("c_mktsegment").alias("keyset"),
            F.col("l_partkey").alias("work"),
        )
    )


CUSTOMER_PARTS = """
  cites AS (
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, c_mktsegment AS keyset, l_partkey AS work
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
  sizes AS (SELECT id, count(*) AS n FROM cites GROUP BY id),
  jedges AS (
    SELECT s.id_a, s.id_b, s.keyset_a, s.keyset_b, s.n_shared,
           CAST(s.n_shared AS DOUBLE) / (a.n + b.n - s.n_shared) AS jaccard
    FROM (SELECT a.id AS id_a, b.id AS id_b, a.keyset AS keyset_a, b.keyset AS keyset_b, count(*) AS n_shared
          FROM cites a JOIN cites b ON a.work = b.work AND a.id <> b.id GROUP BY ALL) s
    JOIN sizes a ON a.id = s.id_a JOIN sizes b ON b.id = s.id_b)"""


def order_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works cited by the vector definitions: every ordered part, assigned to a definition by customer."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = vectors.agg(F.count("*")).scalar()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_custkey"), n).alias("vec_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return (
        lines.join(orders, "o_orderkey")
        .join(vectors, "vec_id")
        .select(
            F.col("vec_id").cast("string").alias("id"),
            F.col("label").cast("string").alias("keyset"),
            F.col("l_partkey").alias("work"),
        )
    )


ORDER_CITES = """
  cites AS (
    SELECT DISTINCT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS keyset, l_partkey AS work
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN embeddings ON vec_id = o_custkey % (SELECT count(*) FROM embeddings)),
  sizes AS (SELECT id, count(*) AS n FROM cites GROUP BY id),
  jedges AS (
    SELECT s.id_a, s.id_b, s.keyset_a, s.keyset_b, s.n_shared,
           CAST(s.n_shared AS DOUBLE) / (a.n + b.n - s.n_shared) AS jaccard
    FROM (SELECT a.id AS id_a, b.id AS id_b, a.keyset AS keyset_a, b.keyset AS keyset_b, count(*) AS n_shared
          FROM cites a JOIN cites b ON a.work = b.work AND a.id <> b.id GROUP BY ALL) s
    JOIN sizes a ON a.id = s.id_a JOIN sizes b ON b.id = s.id_b)"""


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
