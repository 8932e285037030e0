"""Order-sensitive operators: panels, cadences, onsets, successions, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key
from tidemark.functions.scratch import staged


def snapshot_overlap(df: DataFrame, day: Column, key: str) -> DataFrame:
    """Per day: keys, and the Jaccard similarity of its keys with those of the day before it in the table.

    Days are numbered first; (day, key) rows are then joined with the next day's, so no set is collected.
    """
    rows = df.select(day.alias("day"), F.col(key).alias("k")).filter("day is not null and k is not null").distinct()
    sizes = rows.groupBy("day").agg(F.count("*").alias("n_keys")).withColumn("turn", F.row_number().over(Window.orderBy("day")))
    r = rows.join(F.broadcast(sizes), "day")
    both = r.alias("x").join(r.alias("y"), F.expr("x.k = y.k and x.turn = y.turn + 1")).groupBy("x.turn").agg(F.count("*").alias("n_both"))
    before = sizes.select((F.col("turn") + 1).alias("turn"), F.col("n_keys").alias("n_before"))
    out = sizes.join(before, "turn").join(both, "turn", "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_keys", F.round(F.col("n_both") / (F.col("n_keys") + F.col("n_before") - F.col("n_both")), 6).alias("jaccard"))


def cadence(df: DataFrame, day: Column) -> DataFrame:
    """Days between successive dates that have rows, and how often each distance occurs."""
    d = df.select(day.alias("day")).filter("day is not null").distinct()
    gap = F.datediff("day", F.lag("day").over(Window.orderBy("day")))
    return d.select(gap.cast("long").alias("gap_days")).filter("gap_days is not null").groupBy("gap_days").agg(F.count("*").alias("n"))


def onsets(df: DataFrame, group: str, code: str, month: Column, least: int = 3) -> DataFrame:
    """Codes that a group begins to have after at least ``least`` active months without them."""
    m = df.select(F.col(group).alias("g"), F.col(code).alias("c"), month.alias("m")).distinct()
    active = m.select("g", "m").distinct()
    first = m.groupBy("g", "c").agg(F.min("m").alias("start"))
    j = first.join(active, "g").groupBy("g", "c", "start").agg(F.count_if(F.col("m") < F.col("start")).alias("n_before"), F.count_if(F.col("m") >= F.col("start")).alias("n_after"))
    return j.filter(F.col("n_before") >= least).select(F.col("g").alias("grp"), F.col("c").alias("code"), F.date_format("start", "yyyy-MM-dd").alias("start"), "n_before", "n_after")


def value_spans(df: DataFrame, value: str, day: Column) -> DataFrame:
    """First and last day of each value: what successions of one value by another are read from."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n_rows"), F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"))


def switch_day(df: DataFrame, day: Column, old: Column) -> DataFrame:
    """The day that best parts rows that are ``old`` from the others: with fewest rows on the wrong side (the earliest)."""
    d = df.select(day.alias("day"), old.cast("int").alias("o")).filter("day is not null").groupBy("day").agg(F.sum("o").alias("n_old"), F.sum(1 - F.col("o")).alias("n_new"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    w = d.select("day", (F.coalesce(F.sum("n_new").over(upto), F.lit(0)) + F.sum("n_old").over(rest)).alias("n_wrong"))
    return w.agg(F.min(F.struct("n_wrong", "day")).alias("m")).select(F.date_format("m.day", "yyyy-MM-dd").alias("day"), F.col("m.n_wrong").alias("n_wrong"))


def series_facts(df: DataFrame, period: Column, amount: str) -> DataFrame:
    """Least total with its period, last period, and the first period whose total is below zero."""
    s = df.groupBy(period.alias("p")).agg(F.sum(amount).alias("v")).filter("p is not null")
    f = s.agg(F.min(F.struct("v", "p")).alias("lo"), F.max("p").alias("last"), F.min(F.when(F.col("v") < 0, F.col("p"))).alias("neg"), F.count("*").alias("n_periods"))
    return f.select(F.round("lo.v", 2).alias("least"), F.date_format("lo.p", "yyyy-MM").alias("least_period"), F.date_format("last", "yyyy-MM").alias("last_period"), F.date_format("neg", "yyyy-MM").alias("first_below_zero"), "n_periods")


def steady_onsets(df: DataFrame, group: str, code: str, day: str, months: int = 3, rows: int = 5, steady: float = 0.8, chance: float = 0.01) -> DataFrame:
    """``grp, code, month, months_before, n_rows``: codes that start for one group and then carry on.

    The group has ``months`` months with rows before and from the start on, the code ``rows`` rows, and a row in ``steady`` of
    the months since. At its share of all the group's rows it would have been missing before only by a chance of ``chance``, shared
    out over all groups and codes. A code that starts ``months`` months or more into the table and that two groups or more have
    is a change of the whole table and left out. Values are compared by the common equality; rows without one of the three don't count.
    """
    kinds = dict(df.dtypes)
    m = F.year(day) * 12 + F.month(day) - 1
    per = df.select(norm_key(F.col(group), kinds[group]).cast("string").alias("g"), norm_key(F.col(code), kinds[code]).cast("string").alias("c"), m.alias("m")).filter("g is not null and c is not null and m is not null")
    per = staged(per.groupBy("g", "c", "m").agg(F.count("*").alias("n")), "months")
    listed = per.groupBy("g", "m").agg(F.sum("n").alias("r"))
    pairs = per.groupBy("g", "c").agg(F.min("m").alias("onset"), F.sum("n").alias("n_rows"), F.count("*").alias("have"))
    codes = pairs.groupBy("c").agg(F.min("onset").alias("debut"), F.count("*").alias("held"))
    whole = pairs.agg(F.count("*").alias("pairs"), F.min("onset").alias("first"))  # one row
    j = pairs.filter(F.col("n_rows") >= rows).join(listed, "g").groupBy("g", "c", "onset", "n_rows", "have").agg(
        F.count_if(F.col("m") < F.col("onset")).alias("months_before"), F.count_if(F.col("m") >= F.col("onset")).alias("after"), F.sum(F.when(F.col("m") < F.col("onset"), F.col("r")).otherwise(0)).alias("rows_before"), F.sum("r").alias("all_rows"))
    j = j.filter((F.col("months_before") >= months) & (F.col("after") >= months) & (F.col("have") >= steady * F.col("after"))).join(codes, "c").join(F.broadcast(whole))
    late = (F.col("debut") - F.col("first") >= months) & (F.col("held") >= 2)
    likely = F.pow(1 - F.col("n_rows") / F.col("all_rows"), F.col("rows_before")) <= chance / F.col("pairs")
    show = F.format_string("%d-%02d", F.expr("onset div 12"), F.expr("onset % 12 + 1"))
    return j.filter(likely & ~late).select(F.col("g").alias("grp"), F.col("c").alias("code"), show.alias("month"), "months_before", "n_rows")


def off_cycle_code(df: DataFrame, off: Column, columns: list[str]) -> DataFrame:
    """``column, value, n_off, n_on``: the code that rows off a cycle share: the first column of 2 to 6 values of which one is on 90 % of
    the rows off it, and on rows of the cycle a tenth as often at most. ``off`` is true for rows off the cycle; null is neither."""
    kinds = dict(df.dtypes)
    tall = df.select(off.alias("off"), F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), norm_key(F.col(c), kinds[c]).cast("string").alias("value")) for i, c in enumerate(columns)))))
    g = tall.groupBy("i", "column", "value").agg(F.count_if("off").alias("n_off"), F.count_if(~F.col("off")).alias("n_on"))
    few = g.groupBy("i").agg(F.count("value").alias("k"), F.sum("n_off").alias("all_off")).filter("k between 2 and 6")
    found = g.filter("value is not null").join(few, "i").filter("n_off > 0 and n_off >= 0.9 * all_off and n_on <= 0.1 * n_off")
    return found.orderBy("i").limit(1).select("column", "value", "n_off", "n_on")
