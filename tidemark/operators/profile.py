"""Column profiles: one aggregation over all columns, and value histograms as (column, key, count) rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_text, shape


def distinct_counts(df: DataFrame, sets: dict[str, list[Column]], nulls: bool = False) -> DataFrame:
    """``name, n_distinct`` for each named set of values: how many different ones there are, rows with a null in a set left out unless ``nulls`` are values too.

    Values are told apart by 128 bits. All sets share one shuffle, before which equal values are combined; rows
    aren't multiplied with all their columns, as they are by several distinct counts in one aggregation."""
    whole = [F.lit(n) if nulls else F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cols)), F.lit(n)) for n, cols in sets.items()]
    keys = F.array(*(F.struct(w.alias("name"), F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b")) for w, cols in zip(whole, sets.values(), strict=True)))
    tall = df.select(F.inline(keys)).filter("name is not null").groupBy("name", "a", "b").agg(F.lit(1).alias("one"))
    return tall.groupBy("name").agg(F.count("*").alias("n_distinct"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, filled, distinct values, least and greatest (as text), mean length, sum, negatives, zeros.

    Distinct values are counted apart (:func:`distinct_counts`); all else of all columns is one aggregation without a shuffle of rows.
    """
    kinds, aggs = dict(df.dtypes), []
    for c in columns:
        v, number = F.col(c), kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
        text = F.date_format(v, "yyyy-MM-dd") if kinds[c].startswith("timestamp") else v.cast("string")
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count(v).alias("n_filled"),
            (F.min(text) if not number else F.lit(None).cast("string")).alias("least_text"), (F.max(text) if not number else F.lit(None).cast("string")).alias("greatest_text"),
            *((f(v.cast("double")) if number else F.lit(None).cast("double")).alias(n) for f, n in ((F.min, "least"), (F.max, "greatest"))),
            (F.round(F.sum(v.cast("double")), 2) if number else F.lit(None).cast("double")).alias("total"),
            (F.count_if(v < 0) if number else F.lit(0).cast("long")).alias("n_negative"), (F.count_if(v == 0) if number else F.lit(0).cast("long")).alias("n_zero")).alias(f"_{c}"))
    one = df.agg(*aggs)
    rows = one.select(F.inline(F.array(*(F.col(f"_{c}") for c in columns))))
    counts = distinct_counts(df, {c: [F.col(c)] for c in columns})
    return rows.join(F.broadcast(counts.withColumnRenamed("name", "column")), "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))  # a row a column


# Types of which different values are different texts.
_OWN_TEXT = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp_ntz")


def histogram(df: DataFrame, columns: list[str], texts: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``column, k, n``: how often each value occurs; the sketch that joins and keys are found with.

    Values are counted by column as they are, and only different ones become text (``texts``: those that aren't cast);
    a text that several values share is counted again, and so are strings, which the common equality brings together.
    """
    kinds, parts, again = dict(df.dtypes), [], []
    for c in columns:
        text = (texts or {}).get(c, norm_text if kinds[c] == "string" else lambda v: v.cast("string"))
        raw = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        own = kinds[c] in _OWN_TEXT or kinds[c].startswith("decimal")
        # a text that hangs on a count isn't worked out for rows
        (parts if own else again).append(raw.select(F.lit(c).alias("column"), F.when(F.col("n") > 0, text(F.col("v"))).alias("k"), "n"))
    if again:
        parts.append(reduce(DataFrame.union, again).filter("k is not null").groupBy("column", "k").agg(F.sum("n").alias("n")))
    return reduce(DataFrame.union, parts)


def top_values(hist: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column (ties by value)."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "k")
    return hist.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_shapes(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The ``k`` most frequent value shapes (ties by shape)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(shape(F.col(column)).alias("shape")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "shape").limit(k)


def spelling_variants(df: DataFrame, column: str) -> DataFrame:
    """Keys that are spelled in more than one way, with the number of spellings and rows."""
    h = df.groupBy(F.col(column).alias("spelling"), norm_text(F.col(column)).alias("k")).agg(F.count("*").alias("n"))
    return h.filter("k is not null").groupBy("k").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows")).filter("n_spellings > 1")


def pattern_rates(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """The share of filled values that each pattern finds."""
    c = F.col(column)
    one = df.filter(c.isNotNull()).agg(*(F.round(F.avg(c.rlike(p).cast("double")), 6).alias(n) for n, p in patterns.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("share")) for n in patterns))))


def coded_share(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """How many values, and rows, of a column belong to a standard code set."""
    hit = F.upper(F.trim(F.col(column))).isin(codes)
    return df.filter(F.col(column).isNotNull()).agg(F.count("*").alias("n_rows"), F.count_if(hit).alias("n_in_set"), F.count_distinct(F.when(hit, F.col(column))).alias("n_codes"))
