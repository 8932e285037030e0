"""Reach over a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import staged


def downstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node, steps``: every node reached from each start, with the fewest steps. ``edges``: src, dst;
    ``starts``: start. Cycles end by themselves; only new pairs are followed in each round."""
    edges = edges.select("src", "dst").distinct()
    new = staged(starts.select("start", F.col("start").alias("src")).distinct().join(edges, "src").select("start", F.col("dst").alias("node"), F.lit(1).alias("steps")).distinct(), "reach")
    seen, steps = new, 1
    while not new.isEmpty():
        steps += 1
        more = new.select("start", F.col("node").alias("src")).join(edges, "src").select("start", F.col("dst").alias("node")).distinct()
        new = staged(more.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("steps", F.lit(steps)), "reach")
        seen = seen.union(new)
    return seen
