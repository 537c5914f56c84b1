"""One row per key, without the rows' texts in an aggregation.

Which row is kept follows from keys and positions, which are numbers and short
texts; only keys that repeat are looked at again. The rows themselves, with
texts of any length, stay in the tasks that read them while the repeating keys
are few, and travel once through a join that adaptive execution may split where
they are many.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

#: Keys that repeat, up to which they are sent to all tasks; they are counted first.
REPEATED_KEYS = 500_000


def keep_one(rows: DataFrame, keys: list[str], position: str, last: bool) -> DataFrame:
    """The row of greatest (``last``) or least position of each key, with
    ``first`` (the key's least position) and ``n`` (its rows). Positions are unique within a key."""
    kept = (F.max if last else F.min)(position)
    groups = rows.groupBy(*keys).agg(kept.alias("_kept"), F.min(position).alias("_first"), F.count("*").alias("_n"))
    repeated = materialize(groups.filter("_n > 1").select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_kept", "_first", "_n"))
    few = F.broadcast if repeated.count() <= REPEATED_KEYS else (lambda df: df)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    joined = rows.join(few(repeated), same, "left").filter(F.col("_n").isNull() | (F.col(position) == F.col("_kept")))
    return joined.select(*rows.columns, F.coalesce("_first", position).alias("first"), F.coalesce("_n", F.lit(1)).cast("bigint").alias("n"))
