"""Range partitioning by sampled splitters, and prefix sums over the ranges.

Everything here is column expressions. A key is a tuple of non-null columns;
rows are ordered by it, so one hot first component is split by the next ones.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LONG = -(2**63)
#: Sampled rows per range: the relative error of a range is about 1 / sqrt of it.
SAMPLES_PER_RANGE = 16


def null_first(column: str) -> Column:
    """A long key whose nulls sort before every value."""
    return F.coalesce(F.col(column).cast("long"), F.lit(MIN_LONG))


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def splitters(df: DataFrame, keys: list[str], weight: str, n_ranges: int, seed: int = 1) -> list[tuple]:
    """Up to ``n_ranges - 1`` keys that cut ``df`` into ranges of like weight.

    A row is drawn with a probability in proportion to its weight, about
    ``SAMPLES_PER_RANGE * n_ranges`` in all: the driver sees that many keys
    whatever the size of the table. The draw is a hash of the key, so a task
    that runs again draws the same rows.
    """
    total = df.agg(F.sum(F.col(weight).cast("double"))).first()[0]
    if not total or n_ranges < 2:
        return []
    wanted = SAMPLES_PER_RANGE * n_ranges
    chance = F.least(F.lit(1.0), F.col(weight).cast("double") * (wanted / total))
    drawn = (
        df.select(*keys, chance.alias("__chance"), F.col(weight).cast("double").alias("__weight"))
        .where(uniform(*[F.col(k) for k in keys], F.lit(seed)) < F.col("__chance"))
        .groupBy(*keys).agg(F.sum(F.col("__weight") / F.col("__chance")).alias("__weight"))
        .collect()
    )
    rows = sorted((tuple(r[k] for k in keys), r["__weight"]) for r in drawn)
    step = sum(w for _, w in rows) / n_ranges
    bounds, seen, due = [], 0.0, step
    for key, w in rows:
        if seen >= due and (not bounds or key > bounds[-1]):
            bounds.append(key)
            due = (seen // step + 1) * step
        seen += w
    return bounds


def _at_most(item: Column, keys: list[str]) -> Column:
    """item <= key, column by column."""
    test = item[keys[-1]] <= F.col(keys[-1])
    for k in reversed(keys[:-1]):
        test = (item[k] < F.col(k)) | ((item[k] == F.col(k)) & test)
    return test


def range_of(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """The number of bounds at or below the row's key, found in two steps."""
    if not bounds:
        return F.lit(0)
    kind = "array<struct<" + ",".join(f"`{k}`:{df.schema[k].dataType.simpleString()}" for k in keys) + ">>"
    table = lambda rows: F.from_json(F.lit(json.dumps([dict(zip(keys, b, strict=True)) for b in rows])), kind)
    step = max(1, round(len(bounds) ** 0.5))
    block = F.size(F.filter(table(bounds[::step]), lambda x: _at_most(x, keys)))
    first = F.greatest(block - 1, F.lit(0)) * step
    return first + F.size(F.filter(F.slice(table(bounds), first + 1, F.lit(step)), lambda x: _at_most(x, keys)))


def running_sums(df: DataFrame, cell: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, per output name, the sum of a column over all rows before this one.

    Rows are ordered by ``cell`` (two columns, of which the first has a bounded
    number of values) and by ``order`` inside. Each cell is summed by itself;
    the totals of the cells before it come from a small table.
    """
    major, minor = cell
    cells = df.groupBy(*cell).agg(*[F.sum(c).alias(f"__in_{o}") for o, c in sums.items()])
    inside = Window.partitionBy(major).orderBy(minor).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, *[F.coalesce(F.sum(f"__in_{o}").over(inside), F.lit(0)).alias(f"__at_{o}") for o in sums],
                         *[f"__in_{o}" for o in sums])
    majors = cells.groupBy(major).agg(*[F.sum(f"__in_{o}").alias(f"__of_{o}") for o in sums])
    before = Window.orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    majors = majors.select(major, *[F.coalesce(F.sum(f"__of_{o}").over(before), F.lit(0)).alias(f"__of_{o}") for o in sums])
    starts = cells.join(majors, major).select(
        *cell, *[(F.col(f"__at_{o}") + F.col(f"__of_{o}")).alias(f"__at_{o}") for o in sums])
    rows = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({f"__run_{o}": F.sum(c).over(rows) - F.col(c) for o, c in sums.items()})
    return df.join(starts, cell).withColumns(
        {o: F.col(f"__run_{o}") + F.col(f"__at_{o}") for o in sums}
    ).drop(*[f"__run_{o}" for o in sums], *[f"__at_{o}" for o in sums])
