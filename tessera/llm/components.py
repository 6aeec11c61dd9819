"""Connected components of an edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in edges (a, b): label is the least node of the component. Neighbour lists are never gathered; each round at
    least halves the components that remain, and its tables are written, so that a lost executor costs one round."""
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        jump = written(hook, "hooks")
        for _ in range(2):
            far = jump.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jump = jump.join(far, "to").select("node", F.col("far").alias("to"))
        jump = written(jump, "jumps")
        if labels is None:
            labels = jump.select("node", F.col("to").alias("label"))
        else:
            moved = jump.select(F.col("node").alias("label"), "to")
            labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        one = jump.select(F.col("node").alias("a"), F.col("to").alias("x"))
        two = jump.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = left.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = written(left, "edges")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
