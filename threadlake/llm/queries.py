"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.llm import bpe, decontamination, hard_negatives, near_duplicates, ngram_join, perplexity, prefix_tries, rules, sql, substrings, surrogates, token_counts, toxicity
from threadlake.llm.storage import short_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slices_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, in Arrow batches of 10,000 rows: repeated pieces leave each slice of a batch once, so whole slices are
    worth more than memory here."""
    docs = _table(spark, sf_dir, "documents")
    short_batches(spark, 10_000)
    return docs


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    coded = bpe.encode_and_decode(_table(spark, sf_dir, "documents"), word_vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it stays."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of those labelled good, and whether it is kept."""
    return perplexity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").filter("quality = 1"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, with the pieces and scores of the public vocabulary of 32,000."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 13-word windows that an earlier one has."""
    return substrings.without_earlier_windows(_slices_of_many(spark, sf_dir)).drop("spans")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur at an earlier place, with that place."""
    return substrings.repeated_passages(_slices_of_many(spark, sf_dir))


#: For the tables of tests only; who replaces real data sets spark.threadlake.surrogateKey to a key of their own.
SAMPLE_KEY = "sample key"


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.threadlake.surrogateKey", None) or SAMPLE_KEY


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data, and how many it holds."""
    return surrogates.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark)).withColumn("n_entities", F.col("n_entities").cast("bigint"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside exact copies of benchmark windows, and the items they come from."""
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score and verdict for every document."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of every document."""
    return rules.judge(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_tries.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by links of similar sets of three-word shingles."""
    return ngram_join.alike(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with one label in seven moved on by one."""
    rows = hard_negatives.whole_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved), F.col("id") % 50 == 0)


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_perplexity": op2_perplexity,
    "op3_token_counts": op3_token_counts,
    "op4_substrings": op4_substrings,
    "op5_surrogates": op5_surrogates,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_rules": op8_rules,
    "op9_bpe": op9_bpe,
    "op10_passages": op10_passages,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ngram_join": op12_ngram_join,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {"op4_substrings": sql.SUBSTRINGS, "op7_decontamination": sql.DECONTAMINATION, "op8_rules": sql.RULES, "op11_prefix_trie": sql.PREFIX_TRIE, "op13_hard_negatives": sql.HARD_NEGATIVES}
