"""Sharding by sampled splitters.

Size-weighted samples of the key give quantile boundaries; records are dealt
to the ranges between them and overfull ranges are cut further. Ranges are
then laid end to end, and every shard takes an equal stretch of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.ranges import null_first, range_of, running_sums, splitters
from seqloom.llm.storage import sheltered, store

#: Ranges per shard. Boundaries of shards fall inside ranges, so this only sets how even the tasks are.
RANGES_PER_SHARD = 32
#: Bytes of records in a range beyond which it is cut into pieces of about this size.
RANGE_BYTES = 64 << 20


def assign_shards(df: DataFrame, keys: list[str], weight: str, n_shards: int,
                  range_bytes: int = RANGE_BYTES, seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``keys`` are non-null columns that order the records: rows with like first
    keys stay together, and a first key that holds a third of all rows is cut
    by the next ones. ``weight`` is a positive long. A shard takes the rows
    that start in its n-th part of all bytes, so shards differ by at most the
    largest row. Ties in all keys are cut in any order. Columns named shard or
    slot are replaced. An empty table gives no rows.
    """
    df, named = sheltered(df.drop("shard", "slot"), *keys, weight)
    bounds = splitters(df, keys, weight, n_shards * RANGES_PER_SHARD, seed)
    ranged = df.withColumn("__range", range_of(df, keys, bounds))
    # One row per overfull range at most, and the number of ranges is fixed by the number of shards.
    overfull = (
        ranged.groupBy("__range").agg(F.sum(weight).alias("__bytes"))
        .where(F.col("__bytes") > range_bytes)
        .select("__range", F.ceil(F.col("__bytes") / range_bytes).cast("int").alias("__pieces"))
    )
    cut = ranged.join(F.broadcast(overfull), "__range", "left").withColumn(
        "__piece", F.coalesce(F.pmod(F.xxhash64(*keys), F.col("__pieces")).cast("int"), F.lit(0))
    ).withColumn("__one", F.lit(1).cast("long")).drop("__pieces")
    placed = store(running_sums(cut, ["__range", "__piece"], keys, {"__start": weight, "__index": "__one"}), "placed")
    total = placed.agg(F.sum(weight)).first()[0] or 1
    placed = placed.withColumn("shard", F.expr(f"cast(__start * {n_shards} div {total} as int)"))
    # At most n_shards rows.
    first = placed.groupBy("shard").agg(F.min("__index").alias("__first"))
    done = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("__index") - F.col("__first"))
    return named(done, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a large shard is written by several tasks."""
    sharded.write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Law ``bytes`` for documents, ordered by text and id: equal texts stay
    together unless their group crosses a boundary. A null text has size 16
    and the checksum of an empty one; null ids come first."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("__text"),
        null_first("doc_id").alias("__id"),
    )
    sharded = assign_shards(store(narrow, "keys"), ["__text", "__id"], "size", n_shards)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
