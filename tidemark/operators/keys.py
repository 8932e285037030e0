"""Discovery of keys, functional dependencies and joins."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import discard, staged
from tidemark.operators.profile import histogram

FEW_REPEATED = 1_000_000  # combinations that are sent to every task


def key_candidates(df: DataFrame, columns: list[str], most: int = 2) -> DataFrame:
    """For each set of up to ``most`` columns: rows, distinct combinations, and the share of rows that repeat one.

    A row with a null in the set counts as a combination of its own kind. Sets are counted one by one, smaller ones
    first: of each, only the combinations of more than one row are kept. A row that stands alone in a set stands alone in every
    larger one, so a set is counted over the rows that repeat in the smaller one that has the fewest; if those
    combinations are more than ``FEW_REPEATED``, over all rows.
    """
    n, extra, repeated = df.count(), {}, {}
    for size in range(1, most + 1):
        for s in combinations(columns, size):
            inside = min((t for t in combinations(s, size - 1) if t in repeated), key=lambda t: repeated[t][1], default=None)
            if inside and not repeated[inside][1]:
                extra[s], repeated[s] = 0, repeated[inside]
                continue
            rows = df.select(*s)
            if inside and repeated[inside][1] <= FEW_REPEATED:
                keys = repeated[inside][0]
                rows = rows.join(F.broadcast(keys.select(*(F.col(f"k{i}") for i in range(size - 1)))), reduce(and_, (F.col(c).eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(inside))), "left_semi")
            again = rows.groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(s))).agg(F.count("*").alias("n")).filter("n > 1")
            if size < most:
                again = staged(again, "repeated")
            r = again.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")).first()
            extra[s] = r["extra"]
            if size < most:
                repeated[s] = again, r["groups"]
    discard(*(keys for keys, _ in repeated.values()))
    out = [(",".join(s), n, n - e, not e) for s, e in extra.items()]
    return df.sparkSession.createDataFrame(out, "columns string, n_rows long, n_distinct long, is_key boolean")


def near_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """The groups that keep ``columns`` from being a key: how many there are of each size."""
    return df.groupBy(*columns).count().filter("count > 1").groupBy(F.col("count").alias("size")).agg(F.count("*").alias("n_groups"))


def functional_deps(df: DataFrame, pairs: list[tuple[str, str]], most: float = 0.01) -> DataFrame:
    """For each pair (a, b): groups of a, those with more than one b, and whether a decides b up to ``most``.

    b's values are compared by their least and greatest, so each group is two values and a hot one stays small.
    """
    out = None
    for a, b in pairs:
        g = df.filter(F.col(a).isNotNull()).groupBy(a).agg(F.min(b).alias("lo"), F.max(b).alias("hi"))
        one = g.agg(F.count("*").alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("n_broken"))
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n_groups", "n_broken", (F.col("n_broken") <= most * F.col("n_groups")).alias("holds"))
        out = one if out is None else out.union(one)
    return out


def find_joins(left: DataFrame, right: DataFrame, left_columns: list[str], right_columns: list[str], least: float = 0.2) -> DataFrame:
    """Pairs of columns that share values: shared values, containment both ways, and the share of left rows matched.

    Histograms are joined, not tables: both sides have one row a value.
    """
    a = histogram(left, left_columns).select(F.col("column").alias("from_column"), "k", F.col("n").alias("rows_from"))
    b = histogram(right, right_columns).select(F.col("column").alias("to_column"), "k")
    va = a.groupBy("from_column").agg(F.count("*").alias("da"), F.sum("rows_from").alias("ra"))
    vb = b.groupBy("to_column").agg(F.count("*").alias("db"))
    m = a.join(b, "k").groupBy("from_column", "to_column").agg(F.count("*").alias("n_shared"), F.sum("rows_from").alias("rm"))
    m = m.filter("n_shared >= 3").join(F.broadcast(va), "from_column").join(F.broadcast(vb), "to_column")
    m = m.withColumns({"in_to": F.round(F.col("n_shared") / F.col("da"), 6), "in_from": F.round(F.col("n_shared") / F.col("db"), 6), "rows_matched": F.round(F.col("rm") / F.col("ra"), 6)})
    return m.filter(F.greatest("in_to", "in_from") >= least).select("from_column", "to_column", "n_shared", "in_to", "in_from", "rows_matched")
