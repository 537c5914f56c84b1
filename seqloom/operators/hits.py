"""Filtering and summarizing alignment hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text as tx

# Default thresholds.
MIN_IDENTITY = 90.0
MAX_MISMATCH = 1


def _steps(min_pident: float, max_mismatch: int):
    full = F.col("length") == F.length("qseq")
    close = (F.col("pident") >= min_pident) & (F.col("mismatch") <= max_mismatch)
    li_only = (F.col("mismatch") == 0) | (
        tx.fold_li_upper(F.col("qseq")) == tx.fold_li_upper(F.col("sseq")))
    return full, close, li_only


def filter_hits(hits: DataFrame, tool: str, min_pident: float = MIN_IDENTITY,
                max_mismatch: int = MAX_MISMATCH) -> DataFrame:
    """Full-length hits above the thresholds that differ by L/I only."""
    full, close, li_only = _steps(min_pident, max_mismatch)
    return (hits.filter(full & close & li_only).withColumn("tool", F.lit(tool))
            .select("tool", "query_id", "subject_id", "pident", "mismatch", "qseq", "sseq", "evalue"))


def hit_funnel(hits: DataFrame, min_pident: float = MIN_IDENTITY,
               max_mismatch: int = MAX_MISMATCH) -> DataFrame:
    """Rows left after each filter, in one aggregation."""
    full, close, li_only = _steps(min_pident, max_mismatch)
    return hits.agg(F.count("*").alias("raw_hits"), F.count_if(full).alias("full_length"),
                    F.count_if(full & close).alias("after_identity"),
                    F.count_if(full & close & li_only).alias("after_li"))


def hit_subjects(hits: DataFrame) -> DataFrame:
    """(peptide, protein_id): every subject of an aligned query text, once."""
    return hits.select(F.col("qseq").alias("peptide"), F.col("subject_id").alias("protein_id")).distinct()


def subject_counts(subjects: DataFrame, tool: str) -> DataFrame:
    """(tool, peptide, n_proteins): distinct subjects per query text."""
    return subjects.groupBy("peptide").agg(F.count("*").alias("n_proteins")).select(F.lit(tool).alias("tool"), "peptide", "n_proteins")
