"""One query for each operator, over its whole table, and the SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_digest, format_conversations
from .clusters import centroid_clusters
from .common import Scratch, table
from .embeddings import near_vectors
from .filter_audit import audit_filters
from .line_dedup import dedup_lines
from .lm_scoring import score_texts
from .mixing import mix_documents
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import quality_rules
from .sharding import shard_documents
from .sql import ORACLES
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files


def tokenizer_path(name: str) -> str:
    """Vocabulary files are installed on every machine; their place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(spark, write_token_files(spark, docs, tokenizer_path("byte_bpe_50k.json")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


def near_vectors_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` and of each vector a copy with one component changed, by more or less: some are linked, some just not."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    change = (F.col("vec_id") % 5 + 1) * 0.05
    moved = F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 64, x + change).otherwise(x))
    return near_vectors(spark, rows.unionByName(rows.withColumn("embedding", moved).withColumn("vec_id", -F.col("vec_id") - 1)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    examples = Scratch(spark, "chat").save(format_conversations(rows.unionByName(fixed)), "examples")
    return chat_digest(examples)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark, table(spark, sf_dir, "embeddings"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package; it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_line_dedup": op2_line_dedup,
        "op3_token_files": op3_token_files,
        "op4_near_dedup": op4_near_dedup,
        "op5_mixing": op5_mixing,
        "op6_token_counts": op6_token_counts,
        "op7_quality_rules": op7_quality_rules,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "near_vectors_planted": near_vectors_planted,
        "op9_packing": op9_packing,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
