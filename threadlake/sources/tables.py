"""Readers for the Parquet tables, and the adapters that give them the session model."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as (session_id, message_index, role, content)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("message_index"),
        "role",
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (chunk_id, session_id, embedding); the label plays the session."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").cast("bigint").alias("session_id"),
        "embedding",
    )
