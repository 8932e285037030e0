"""What several operators share: runs of long texts, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import discard, release, scratch_path, staged  # noqa: F401


def text_slices(texts: pa.Array, limit: int = 500_000):
    """Cut an Arrow string column into runs of rows of about ``limit`` bytes (one row at least)."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(sizes):
        yield start, len(sizes)


def _local_forest(batches):
    """Replace a partition's edges by one edge to the smallest node of each local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])


def _are_stars(e: DataFrame) -> bool:
    """Whether no node has two edges to smaller nodes, or edges both ways."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per.filter("down > 1 or (down = 1 and up = 1)").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph of ``edges`` (two long columns): ``node, component``.

    Every node that has an edge to another gets one row with the smallest node that it reaches;
    nodes without edges have no row; null ends and loops are ignored. Each partition's edges
    first become a forest, then large-star and small-star rounds run until nothing changes.
    Each round is written to the shared folder. Minima are aggregated before they are shuffled,
    and what is joined to them are staged tables, so adaptive execution can split a hub. Edges lead
    from larger to smaller nodes throughout, so nothing is left to do once they are stars.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.filter("u is not null and v is not null and u <> v").mapInArrow(_local_forest, "u long, v long")
    e = staged(e, "edges")
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        both = e.union(e.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "star")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        before, e = e, staged(small.filter("u <> v").distinct(), "edges")
        discard(before, least, large, low)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v"))).distinct()
