"""Dense global numbering without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.session import materialize

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROW_BITS = 33


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """1-based position of each row in the order of the unique ``order``.

    A prefix sum on two levels: rows are range-partitioned by sampled bounds
    and sorted, each partition numbers its own, and the partitions' totals, of
    which there are as many as shuffle partitions, are summed up. The ranges
    are written once, so both levels see the same ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_row", _ROW_BITS), F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    totals = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("_part", F.coalesce(before, F.lit(0).cast("bigint")).alias("_before"))
    return (rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row per partition
            .withColumn(name, F.col("_before") + inside + 1).drop("_row", "_part", "_before"))


def with_peptide_ids(peptides: DataFrame, tool: str, order: list[str]) -> DataFrame:
    """Name the lines of a list ``<tool>_peptide_<i>``."""
    numbered = with_ordinal(peptides, order)
    return numbered.withColumn("id", F.concat(F.lit(f"{tool}_peptide_"), F.col("ordinal").cast("string")))
