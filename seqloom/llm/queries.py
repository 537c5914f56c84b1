"""The operators as queries over the documents and conversations tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import (
    chat,
    conversation_repair,
    cutting_stock,
    fingerprints,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    sharding,
    token_counts,
    token_files,
    toxicity,
    vector_codes,
)
from seqloom.llm.encoding import vocabulary
from seqloom.llm.storage import shared_path, store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_sampled_splitters(spark, sf_dir):
    return sharding.document_shards(documents(spark, sf_dir))


@query
def op9_token_counts(spark, sf_dir):
    histogram = store(token_counts.length_histogram(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")), "lengths")
    return token_counts.limit_totals(histogram)


@query
def op10_token_files(spark, sf_dir):
    return token_files.token_file_digest(documents(spark, sf_dir), shared_path(spark, "tokens"), vocabulary("byte_bpe_50k.json"))


@query
def op2_pattern_packing(spark, sf_dir):
    return packing.document_packing(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op7_closed_syncmers(spark, sf_dir):
    return fingerprints.document_fingerprints(documents(spark, sf_dir))


@query
def op4_weak_supervision(spark, sf_dir):
    return quality_rules.document_quality(documents(spark, sf_dir))


@query
def op5_tensored_minhash(spark, sf_dir):
    return near_dedup.duplicate_classes(documents(spark, sf_dir))


@query
def op8_counterfactual_toxicity(spark, sf_dir):
    return toxicity.document_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_hierarchical_mixing(spark, sf_dir):
    return mixing.mixed_documents(documents(spark, sf_dir))


@query
def op3_prefix_tree_chat(spark, sf_dir):
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    segments = store(chat.format_conversations(conversations, vocabulary("byte_bpe_50k.json")), "segments", chat.GROUP_BYTES)
    return chat.read_conversations(segments)


@query
def op11_column_generation(spark, sf_dir):
    return cutting_stock.document_packing(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query
def op12_walsh_hadamard_codes(spark, sf_dir):
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_target_alignment(spark, sf_dir):
    return conversation_repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
