"""Exact order statistics by group, whatever a group's size: elements of given ranks, no sort of all rows.

Counts say which rank is wanted. Groups of more than ``DIRECT`` rows are narrowed first: a sketch of bounded
size proposes a bracket about the rank, exact counts below and inside it prove that the element is there,
and only rows inside the bracket go on. What is left becomes a histogram of values, of which running counts
give the element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import staged

DIRECT = 200_000  # rows of a group that are counted by value at once
ACCURACY, ROUNDS = 400, 6  # of a sketch, whose bracket holds about a hundredth of the rows


def nth(share: float) -> Column:
    """The rank, from 0, of the element after ``share`` of ``n`` rows: 0.5 is the upper median."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * share).cast("long"))


def ordered_values(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column], direct: int = DIRECT) -> DataFrame:
    """``groups..., n`` and for each name of ``ranks`` the element of that rank (from 0, worked out from ``n``).

    Null values and NaN are no elements; a group without elements has no row; null groups are groups. Without
    ``groups`` there is one row, or none. An element is always one that occurs; equal values are equal elements.
    """
    keys = [f"_k{i}" for i in range(len(groups))]
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col(value).alias("_v")).filter("_v is not null")
    if dict(rows.dtypes)["_v"] in ("double", "float"):
        rows = rows.filter(~F.isnan("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*(F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks.items()))
    targets = sizes.filter("n > 0").select("*", F.inline(wanted)).select(*keys, "n", "_name", "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_in"))
    targets = staged(targets, "ranks")
    for _ in range(ROUNDS):
        if targets.filter((F.col("_in") > direct) & (F.col("_lo") < F.col("_hi"))).isEmpty():
            break
        targets = staged(_narrower(rows, keys, targets, direct), "ranks")
    done = targets.filter(F.col("_lo") == F.col("_hi")).select(*keys, "n", "_name", F.col("_lo").alias("_v"))
    inside = _inside(rows, keys, targets.filter(F.col("_lo") < F.col("_hi"))).groupBy(*keys, "n", "_name", "_rank", "_below", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
    found = inside.withColumn("_upto", upto).filter("_rank < _upto and _rank >= _upto - _c").select(*keys, "n", "_name", "_v")
    out = done.unionByName(found).groupBy(*keys, "n").agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks))
    return out.select(*(F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)), "n", *ranks)


def _inside(rows: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Rows within the bracket of each target of their group."""
    named = targets.select(*(F.col(k).alias(f"{k}_") for k in keys), *(c for c in targets.columns if c not in keys))
    same = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return (rows.join(named, same) if keys else rows.join(F.broadcast(named), same)).drop(*(f"{k}_" for k in keys))


def _narrower(rows: DataFrame, keys: list[str], targets: DataFrame, direct: int) -> DataFrame:
    """Targets whose bracket holds too many rows get one that a sketch proposes, if counts prove it."""
    wide = (F.col("_in") > direct) & (F.col("_lo") < F.col("_hi"))
    big = targets.filter(wide)
    by = [*keys, "n", "_name", "_rank", "_lo", "_hi", "_below", "_in"]
    sketch = _inside(rows, keys, big).groupBy(*by).agg(F.percentile_approx("_v", [i / ACCURACY for i in range(ACCURACY + 1)], 10 * ACCURACY).alias("_q"))
    place = F.floor((F.col("_rank") - F.col("_below")) * ACCURACY / F.col("_in")).cast("int")
    cut = sketch.select(*by, F.element_at("_q", F.greatest(F.lit(1), place)).alias("_a"), F.element_at("_q", F.least(F.lit(ACCURACY + 1), place + 3)).alias("_z"))
    cut = staged(cut, "brackets")
    counts = _inside(rows, keys, cut).groupBy(*by, "_a", "_z").agg(F.count_if(F.col("_v") < F.col("_a")).alias("_less"), F.count_if(F.col("_v").between(F.col("_a"), F.col("_z"))).alias("_now"))
    held = (F.col("_rank") >= F.col("_below") + F.col("_less")) & (F.col("_rank") < F.col("_below") + F.col("_less") + F.col("_now"))
    moved = counts.select(*keys, "n", "_name", "_rank", F.when(held, F.col("_a")).otherwise(F.col("_lo")).alias("_lo"), F.when(held, F.col("_z")).otherwise(F.col("_hi")).alias("_hi"),
                          F.when(held, F.col("_below") + F.col("_less")).otherwise(F.col("_below")).alias("_below"), F.when(held, F.col("_now")).otherwise(F.col("_in")).alias("_in"))
    return targets.filter(~wide).unionByName(moved)
