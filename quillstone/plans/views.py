"""The engine's entities as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("long").alias("document_id"), F.concat(F.lit("ds"), (F.col("label") % 3).cast("string")).alias("dataset"),
        F.md5(F.col("vec_id").cast("string")).alias("content_hash"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degraded queries: every tenth vector, with all after its sixth component zero; it expects itself."""
    c = chunks(spark, sf_dir).where(F.col("chunk_id") % 10 == 0)
    return c.select(
        F.col("chunk_id").alias("query_id"), F.transform("embedding", lambda x, i: F.when(i < 6, x).otherwise(F.lit(0.0).cast("float"))).alias("query_vector"), "dataset",
        F.col("content_hash").alias("expected_hash"), F.col("document_id").alias("expected_document"),
    )


#: The same for the oracle.
SQL = """
    chunks AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding, label::BIGINT AS document_id, 'ds' || (label % 3) AS dataset, md5(vec_id::VARCHAR) AS content_hash FROM embeddings),
    questions AS (SELECT chunk_id AS query_id, list_transform(embedding, lambda x, i: CASE WHEN i <= 6 THEN x ELSE 0.0 END) AS query_vector, dataset, content_hash AS expected_hash, document_id AS expected_document FROM chunks WHERE chunk_id % 10 = 0),
    scored AS (SELECT query_id, chunk_id, list_inner_product(query_vector, embedding) AS score, c.content_hash, c.document_id, q.dataset, expected_hash, expected_document, c.dataset AS chunk_dataset FROM questions q, chunks c),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
"""
