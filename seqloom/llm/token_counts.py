"""Exact histogram of encoded lengths and the totals it answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.encoding import encoder
from seqloom.llm.ranges import running_sums
from seqloom.llm.storage import text_batches


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents by encoded length: (length, n_docs). Null texts have length 0;
    every row counts, whatever its id. No documents, no rows. Lengths are
    pre-aggregated by each task, so the shuffle carries lengths and no texts."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            found = [len(ids) // 4 for ids in enc.encode_all(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["length"])

    text_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(lengths, "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def limit_totals(histogram: DataFrame) -> DataFrame:
    """For each occurring length taken as context limit: documents and tokens
    of that length, those at least as long (suffix sums), the total after
    cutting every document at the limit, what the cut removes, and the share of
    documents that fit. Limits between two lengths follow from the row of the
    next longer one; see ``truncated_total``."""
    # Lengths are cut into stretches of 1,024, so no task sums more than those and one row per stretch.
    cells = histogram.select("*", (F.col("length") * F.col("n_docs")).alias("n_tokens"),
                             F.expr("cast(length div 1024 as int)").alias("__major"))
    sums = running_sums(cells.withColumn("__minor", F.col("length")), ["__major", "__minor"], ["length"],
                        {"docs_shorter": "n_docs", "tokens_shorter": "n_tokens"})
    total = histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"),
                          F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("t")).first()
    at_least, tokens = F.lit(total["d"]) - F.col("docs_shorter"), F.lit(total["t"]) - F.col("tokens_shorter")
    cut = F.col("tokens_shorter") + F.col("length") * at_least
    return sums.select(
        "length", "n_docs", "n_tokens", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        cut.alias("truncated_total"), (F.lit(total["t"]) - cut).alias("tokens_cut"),
        ((F.col("docs_shorter") + F.col("n_docs")) / F.lit(float(total["d"] or 1))).alias("share_fitting"))


def quantile_length(totals: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents fit in."""
    return totals.where(F.col("share_fitting") >= share).agg(F.min("length")).first()[0]


def truncated_total(totals: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``."""
    row = totals.where(F.col("length") >= limit).orderBy("length").select("length", "docs_at_least", "truncated_total").first()
    if row is not None:
        return row["truncated_total"] - (row["length"] - limit) * row["docs_at_least"]
    return totals.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
