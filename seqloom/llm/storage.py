"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid4().hex}"


def store(df: DataFrame, name: str = "table", group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage like a checkpoint, but in columns: later readers fetch
    only what they use. A lost executor costs a re-read, not a recomputation.

    ``group_bytes`` ends a row group, for rows that may be megabytes. Writers
    look at the size of pages and row groups every hundred rows at first, and
    a page or row group is held as a whole; here they look at every row.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sheltered(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with all columns but the used ones under names that an operator's
    own cannot clash with, and what gives a result its names back, followed by
    the new columns named to it."""
    names = {f"column_{i}" if c not in used else c: c for i, c in enumerate(df.columns)}
    return df.toDF(*names), lambda out, *new: out.select(*[F.col(inner).alias(c) for inner, c in names.items()], *new)


#: Bytes of rows that a worker process gets at a time.
BATCH_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of bounded size.

    Spark's default counts rows, and ten thousand long texts are hundreds of
    megabytes in a worker and again in its JVM.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
