"""From raw documents to token ids: every stage works on what the stage before it kept, written and read again.

All stages but the last return the columns of documents; the last returns (doc_id, n_tokens, token_ids, ids_sha256,
decoded_sha256). Rows with a null text pass through all stages and encode to no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.llm import bpe, decontamination, near_duplicates, surrogates, toxicity
from threadlake.llm.queries import surrogate_key, word_vocabulary
from threadlake.llm.storage import durable, short_batches


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored as toxic."""
    short_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    short_batches(spark)
    return near_duplicates.without_duplicates(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def surrogates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars is that of the new text."""
    new = surrogates.replace(docs, surrogate_key(spark))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(new.columns[-1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the text decoded from them."""
    short_batches(spark)
    coded = bpe.encode_and_decode(docs, word_vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("surrogates", surrogates_stage),
    ("encoding", encoding_stage),
]

#: Neither the classifier nor the surrogates can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
