"""Sets of rows that findings or rules take, as bitmaps of row positions: which cover others, which are the same.

A bitmap holds 32,768 positions, so rows shuffle as one short string a set and bucket, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import staged

COVERED = 0.9


def row_bitmaps(df: DataFrame, position: str, sets: dict[str, Column]) -> DataFrame:
    """``name, bucket, bits``: the positions of rows for which each set's condition is true.

    ``position`` numbers the rows from 0 or above; a null one is no row, a null condition is false; repeated
    positions are one row. A set without rows has no bitmap. Bitmaps are put together before they are shuffled."""
    at = F.col(position)
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in sets.items()))
    rows = df.filter(at.isNotNull()).select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"), F.inline(named)).filter("hit")
    return rows.groupBy("name", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def overlaps(bitmaps: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b, n_both`` of sets that share a row, each pair once each way. Sets are met bucket by bucket."""
    bitmaps = staged(bitmaps, "bitmaps")
    sizes = bitmaps.groupBy("name").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    x, y = bitmaps.select(F.col("name").alias("a"), "bucket", F.col("bits").alias("p")), bitmaps.select(F.col("name").alias("b"), "bucket", F.col("bits").alias("q"))
    both = x.join(y, "bucket").filter("a < b").select("a", "b", "bucket", F.explode(F.array("p", "q")).alias("bits"))
    both = both.groupBy("a", "b", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n_both")).filter("n_both > 0")
    both = both.union(both.select("b", "a", "n_both"))
    return both.join(sizes.select(F.col("name").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("name").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "n_a", "n_b", "n_both")


def merge_row_sets(df: DataFrame, position: str, sets: dict[str, Column], share: float = COVERED) -> DataFrame:
    """``name, n_rows, kept, covered_by``: which sets stay when each that ``share`` of another kept one covers goes.

    Sets are taken in the order given, which is that of their weight. A set goes if a kept one before it holds
    ``share`` of its rows; sets of the same rows are merged so, and a set without rows is never covered. Sets are as many as
    findings or rules, so their order is settled on the driver; rows are counted where they are."""
    found = row_bitmaps(df, position, sets)
    pairs = {(r["a"], r["b"]): r["n_both"] for r in overlaps(found).collect()}
    sizes = {r["name"]: r["n"] for r in found.groupBy("name").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    kept, out = [], []
    for name in sets:
        n = sizes.get(name, 0)
        by = next((k for k in kept if n and pairs.get((name, k), 0) >= share * n), None)
        out.append((name, n, by is None, by))
        if by is None:
            kept.append(name)
    return df.sparkSession.createDataFrame(out, "name string, n_rows long, kept boolean, covered_by string")


def same_rows(df: DataFrame, position: str, sets: dict[str, Column]) -> DataFrame:
    """``name, n_rows, first``: sets of exactly the same rows share the name that comes first in the order given."""
    place = F.create_map(*(F.lit(x) for i, n in enumerate(sets) for x in (n, i)))
    print_ = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "bucket", F.sha2("bits", 256))))), 256)
    per = row_bitmaps(df, position, sets).groupBy("name").agg(F.sum(F.bitmap_count("bits")).alias("n_rows"), print_.alias("print"))
    every = df.sparkSession.createDataFrame([(n,) for n in sets], "name string").join(per, "name", "left").withColumn("print", F.coalesce("print", F.lit("")))
    first = F.first("name").over(Window.partitionBy("print").orderBy(place[F.col("name")]))
    return every.select("name", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), first.alias("first"))
