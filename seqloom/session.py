"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "seqloom", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partition counts are left to the caller: they depend on the
    cluster. Adaptive execution merges small partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Rows multiply behind a shuffle here (windows, seeds), so merged
        # partitions are kept well below the usual 64 MB.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        # Keys are mostly distinct within a task: a small first-level map in
        # front of the aggregation map would miss nearly always.
        "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so the
    setting is required there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def spread(df: DataFrame) -> DataFrame:
    """Give a table in few files more tasks before a step that multiplies it.

    A large table already has a task per split and is left as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(2 * wanted)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in reliable storage.

    The stage is a table of columns in the shared folder: readers fetch the
    columns they use, and its size is known when a join is planned.
    """
    ensure_checkpoint_dir(df.sparkSession)
    base = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/stage-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
