"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.storage import store


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); the label is the least node reachable.

    Every round, each node points at the least of itself and its neighbours,
    pointers are followed once more, and the graph is contracted to the nodes
    pointed at, so its edges shrink quickly. A hub's neighbours are reduced by
    each task before the shuffle. No edges give no rows.
    """
    left = store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        up = left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        # What a node points at has neighbours itself, so it is in the table.
        further = up.select(F.col("node").alias("up"), F.col("up").alias("label"))
        step = store(up.join(further, "up").select("node", "label"), "step")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("moved"))
            labels = store(labels.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label")), "labels")
        a, b = (step.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        left = store(left.join(a, "a").select("la", "b").distinct().join(b, "b").where("la <> lb")
                     .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels
