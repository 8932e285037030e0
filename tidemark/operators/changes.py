"""Dates at which a table changes: values that take over from others, columns that change together, and who follows whom.

Everything is read from one histogram (column, view, value, day), so rows are counted once and what follows
works on days and values.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.keys import norm_key, written_form
from tidemark.functions.scratch import staged

ROWS, DAYS = 100, 28  # a table of fewer dated rows, or days between the first and the last, shows no change
LEAST, SHARE = 20, 0.02  # rows of a value, and its share of all, to take part
TRIM, SPAN, OVERLAP, GAP = 0.03, 0.10, 0.15, 14
TOGETHER, NEAR = 14, 45  # days within which switches are one date, and within which dates are one change
MANY = 1000  # values of a column, above which rows of one value and day are too few to be combined first
LABELS = 60  # values of a column whose labels are followed
_AMOUNTS = ("double", "float")


def day_number(day: Column) -> Column:
    return F.datediff(F.to_date(day), F.lit("1970-01-01"))


def day_histogram(df: DataFrame, day: str, columns: list[str], amounts: list[str]) -> DataFrame:
    """``column, view, value, day, n`` of dated rows: signs of amounts (zeros apart), forms and labels of the others.

    Labels of columns with more than about twice ``LABELS`` values are left out by a sketch before rows are counted."""
    kinds = dict(df.dtypes)
    others = [c for c in columns if c not in amounts]
    few = df.agg(*(F.approx_count_distinct(c).alias(c) for c in others)).first().asDict() if others else {}
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, view string, value string, day int, n long")
    parts, dated = [], df.filter(F.col(day).isNotNull())
    for c in columns:
        view = lambda name, value, c=c: F.struct(F.lit(c).alias("column"), F.lit(name).alias("view"), value.alias("value"))
        x, alike = F.col("x"), dated.select(F.col(c).alias("x"), day_number(F.col(day)).alias("day"))
        if c in amounts:
            views = [view("sign", F.col("x"))]
            alike = alike.withColumn("x", F.when(x > 0, "positive").when(x < 0, "negative"))
        else:
            views = [view("form", F.col("x"))]
            if few[c] > MANY:  # nearly every row has a value of its own: only its form is counted
                alike = alike.withColumn("x", written_form(x, kinds[c]))
            else:
                views = [view("form", written_form(x, kinds[c]))]
            if 0 < few[c] <= 2 * LABELS:
                views.append(view("label", norm_key(x, kinds[c]).cast("string")))
        # rows of one value and day are combined before it is looked at
        parts.append(alike.groupBy("x", "day").agg(F.count("*").alias("c")).select("day", "c", F.inline(F.array(*views))))
    long = reduce(DataFrame.union, [p.select("column", "view", "value", "day", "c") for p in parts])
    hist = staged(long.filter("value is not null").groupBy("column", "view", "value", "day").agg(F.sum("c").alias("n")), "days")
    many = hist.filter("view = 'label'").groupBy("column", "view").agg(F.count_distinct("value").alias("v")).filter((F.col("v") < 2) | (F.col("v") > LABELS))
    return hist.join(F.broadcast(many), ["column", "view"], "left_anti")  # one row a column at most


def value_terms(hist: DataFrame) -> DataFrame:
    """``column, view, value, n, first, start, finish, last``: rows and days of each value; start and finish leave out 3 % of its rows at each end."""
    by = ["column", "view", "value"]
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*by))
    cut = F.floor(total * TRIM)
    h = hist.withColumns({"upto": upto, "total": total, "cut": cut})
    return h.groupBy(*by).agg(F.max("total").alias("n"), F.min("day").alias("first"), F.min(F.when(F.col("upto") > F.col("cut"), F.col("day"))).alias("start"),
                              F.min(F.when(F.col("upto") > F.col("total") - 1 - F.col("cut"), F.col("day"))).alias("finish"), F.max("day").alias("last"))


def successions(hist: DataFrame, need: float, span: int) -> DataFrame:
    """``column, view, old, new, switch``: values of one view of which the new one takes over from the old.

    Each has ``need`` rows, over a tenth of the span at least; the new one starts and ends after the old, they overlap
    by 15 % of the span at most, and the new one's first row is no more than 14 days after the old one's last.
    Whether two values can meet is an overlap of two intervals of days, so they are joined in buckets of days.
    ``switch`` is the first day of the new value's that leaves the fewest rows on the wrong side.
    """
    slack = OVERLAP * span
    width = max(GAP, int(slack), 1)
    terms = value_terms(hist).filter((F.col("n") >= need) & (F.col("finish") - F.col("start") >= SPAN * span))
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    old = terms.select("column", "view", F.col("value").alias("old"), F.col("start").alias("s"), F.col("finish").alias("e"), F.col("last").alias("l"), bucket(F.col("finish"), F.col("last")).alias("bucket"))
    low, high = F.col("first") - GAP, F.greatest(F.col("first") - GAP, F.col("start") + F.ceil(F.lit(slack)))
    new = terms.select("column", "view", F.col("value").alias("new"), F.col("first").alias("f"), F.col("start").alias("s2"), F.col("finish").alias("e2"), bucket(low, high).alias("bucket"))
    ok = "old <> new and s2 > s and e2 > e and f - l <= {gap} and greatest(0, e - s2) <= {slack!r}".format(gap=GAP, slack=slack)
    pairs = old.join(new, ["column", "view", "bucket"]).filter(ok).select("column", "view", "old", "new").distinct()
    days = hist.select("column", "view", "value", "day", "n")
    side = lambda name: pairs.join(days, (pairs["column"] == days["column"]) & (pairs["view"] == days["view"]) & (pairs[name] == days["value"])).select(pairs["column"], pairs["view"], "old", "new", "day", F.when(F.lit(name == "old"), F.col("n")).otherwise(0).alias("o"), F.when(F.lit(name == "new"), F.col("n")).otherwise(0).alias("w"))
    by = ["column", "view", "old", "new"]
    both = side("old").union(side("new")).groupBy(*by, "day").agg(F.sum("o").alias("o"), F.sum("w").alias("w"))
    run = Window.partitionBy(*by).orderBy("day")
    cost = F.sum("o").over(run.rowsBetween(0, Window.unboundedFollowing)) + F.coalesce(F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = both.withColumn("cost", cost).filter("w > 0").groupBy(*by).agg(F.min(F.struct("cost", "day")).alias("m"))
    return best.select(*by, F.col("m.day").alias("switch"))


def dated_extent(df: DataFrame, day: str) -> tuple[int, int]:
    """Dated rows, and days from the first to the last."""
    r = df.agg(F.count(day).alias("n"), F.datediff(F.max(day), F.min(day)).alias("span")).first()
    return r["n"], r["span"] or 0


def take_overs(df: DataFrame, day: str, columns: list[str] | None = None, amounts: list[str] | None = None) -> DataFrame:
    """``column, view, old, new, day``: see :func:`successions`; none in a table of fewer than 100 dated rows or of under 28 days.

    ``columns`` are all but ``day`` unless given; ``amounts`` those of doubles, of which signs are followed; of the
    others forms and, if there are 2 to 60, labels. Null values and rows without a day don't count.
    """
    n, span = dated_extent(df, day)
    columns = [c for c in columns or df.columns if c != day]
    found = _take_overs(df, day, columns, _amounts(df, columns, amounts), n, span)
    return found.select("column", "view", "old", "new", F.date_format(F.date_add(F.lit("1970-01-01"), F.col("switch")), "yyyy-MM-dd").alias("day"))


def _amounts(df: DataFrame, columns: list[str], amounts: list[str] | None) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in columns if kinds[c] in _AMOUNTS or kinds[c].startswith("decimal")] if amounts is None else amounts


def _take_overs(df, day, columns, amounts, n, span):
    if n < ROWS or span < DAYS:
        return df.sparkSession.createDataFrame([], "column string, view string, old string, new string, switch int")
    return successions(day_histogram(df, day, columns, amounts), max(LEAST, SHARE * n), span)


def profile_changes(df: DataFrame, day: str, dates: DataFrame, amounts: list[str], need: float) -> DataFrame:
    """``at, column, kind`` where an amount is written another way from a date (``at``, a day number) on.

    whole: 95 % whole numbers on one side, at most half on the other; few: at most 6 values on one side, over 12 on the
    other; scale: the upper medians of sizes that aren't zero differ five times. Both sides need ``need`` values.
    """
    if not amounts:
        return df.sparkSession.createDataFrame([], "at int, column string, kind string")
    tall = df.filter(F.col(day).isNotNull()).select(day_number(F.col(day)).alias("d"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in amounts))))
    tall = tall.filter("v is not null and not isnan(v)").groupBy("column", "d", F.round("v", 6).alias("v")).agg(F.count("*").alias("c"))
    sided = tall.join(F.broadcast(dates.select("at")), how="cross").withColumn("after", F.col("d") >= F.col("at"))  # dates are few: two can't be nearer than two weeks
    per = staged(sided.groupBy("at", "column", "after", "v").agg(F.sum("c").alias("c")), "sides")
    facts = per.groupBy("at", "column", "after").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v") == F.floor("v"), F.col("c")).otherwise(0)).alias("whole"), F.count("*").alias("kinds"))
    weights = per.filter("v <> 0").select("at", "column", "after", F.abs("v").alias("size"), "c")
    middle = _weighted_upper_median(weights, ["at", "column", "after"], "size", "c")
    facts = facts.join(middle, ["at", "column", "after"], "left").withColumn("share", F.col("whole") / F.col("n"))
    cols = ["n", "share", "kinds", "size"]
    x = facts.filter("not after").select("at", "column", *(F.col(c).alias(f"{c}_x") for c in cols))
    y = facts.filter("after").select("at", "column", *(F.col(c).alias(f"{c}_y") for c in cols))
    both = x.join(y, ["at", "column"]).filter((F.col("n_x") >= need) & (F.col("n_y") >= need))
    tests = {"whole": "(share_x >= 0.95 and share_y <= 0.5) or (share_y >= 0.95 and share_x <= 0.5)", "few": "(kinds_x <= 6 and kinds_y > 12) or (kinds_y <= 6 and kinds_x > 12)",
             "scale": "greatest(size_x, size_y) >= 5 * least(size_x, size_y)"}
    kinds = F.array(*(F.when(F.coalesce(F.expr(t), F.lit(False)), k) for k, t in tests.items()))
    return both.select("at", "column", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def _weighted_upper_median(df: DataFrame, groups: list[str], value: str, weight: str) -> DataFrame:
    """The upper median of values that stand for ``weight`` rows each: running sums within parts of a group that a sketch bounds."""
    total = df.groupBy(*groups).agg(F.sum(weight).alias("_n"), F.percentile_approx(value, [i / 16 for i in range(1, 16)], 400).alias("_cuts"))
    parted = df.groupBy(*groups, value).agg(F.sum(weight).alias(weight)).join(total, groups).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    sums = parted.groupBy(*groups, "_part").agg(F.sum(weight).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = parted.join(sums.select(*groups, "_part", before.alias("_before"), "_s"), [*groups, "_part"]).filter("_n div 2 >= _before and _n div 2 < _before + _s")
    upto = F.col("_before") + F.sum(weight).over(Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("_upto", upto).filter(F.expr(f"_n div 2 < _upto and _n div 2 >= _upto - {weight}")).select(*groups, value)


def switch_dates(found: DataFrame) -> DataFrame:
    """``at, cluster``: switches within 14 days of the first of them are one date: the day on which most columns first switch, the earliest of those."""
    fold = f"""aggregate(sort_array(collect_set(switch)), cast(array() as array<struct<cluster: int, switch: int>>), (acc, d) ->
        concat(acc, array(struct(if(size(acc) > 0 and d - element_at(acc, -1).cluster <= {TOGETHER}, element_at(acc, -1).cluster, d) as cluster, d as switch))))"""
    days = found.agg(F.expr(fold).alias("x")).select(F.inline("x"))  # at most one entry a day of the table
    first = found.join(F.broadcast(days), "switch").groupBy("cluster", "column").agg(F.min("switch").alias("day"))
    votes = first.groupBy("cluster", "day").agg(F.count("*").alias("k"))
    return votes.groupBy("cluster").agg(F.max(F.struct("k", (-F.col("day")).alias("early"))).alias("m")).select((-F.col("m.early")).alias("at"), "cluster")


def boundaries(df: DataFrame, day: str, columns: list[str] | None = None, amounts: list[str] | None = None) -> DataFrame:
    """``boundary, column, kind, before, after, day, n_before, n_after``: dates from which a table is written another way.

    At a date two columns or more change (the form or the labels of their values), or an amount does (its sign, or
    see :func:`profile_changes`); labels of one column alone are a handoff, no boundary. Both sides need 20
    rows and 2 % of all. Dates at most 45 days after the one before are one boundary, that with the most columns
    (then the more even sides, then the earlier); what else changes keeps its own ``day``. ``before`` and ``after``
    are null for kinds without values. Defaults and what doesn't count are those of :func:`take_overs`.
    """
    n, span = dated_extent(df, day)
    columns = [c for c in columns or df.columns if c != day]
    amounts = _amounts(df, columns, amounts)
    need = max(LEAST, SHARE * n)
    found = staged(_take_overs(df, day, columns, amounts, n, span), "found")
    dates = staged(switch_dates(found), "dates")
    per_day = df.filter(F.col(day).isNotNull()).groupBy(day_number(F.col(day)).alias("d")).agg(F.count("*").alias("c"))
    sides = per_day.join(F.broadcast(dates), how="cross").groupBy("at", "cluster").agg(F.sum(F.when(F.col("d") < F.col("at"), F.col("c")).otherwise(0)).alias("n_before"), F.sum(F.when(F.col("d") >= F.col("at"), F.col("c")).otherwise(0)).alias("n_after"))
    sides = staged(sides.filter((F.col("n_before") >= need) & (F.col("n_after") >= need)), "sides")
    members = found.withColumn("switch", F.col("switch").cast("int")).join(F.broadcast(sides), (F.col("switch") >= F.col("cluster")) & (F.col("switch") <= F.col("cluster") + TOGETHER))
    named = members.select("at", "n_before", "n_after", "column", F.col("view").alias("kind"), F.col("old").alias("before"), F.col("new").alias("after"))
    number = profile_changes(df, day, sides, amounts, need).join(F.broadcast(sides), "at").select("at", "n_before", "n_after", "column", "kind", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    changes = staged(named.union(number), "changes")
    amount = F.max(F.col("kind").isin("sign", "whole", "few", "scale"))
    kept = changes.groupBy("at", "n_before", "n_after").agg(F.count_distinct("column").alias("k"), amount.alias("amount")).filter("amount or k >= 2")
    # sessions: a gap of more than 45 days to the date before begins a new one
    order = Window.orderBy("at")
    session = F.sum(F.when(F.col("at") - F.lag("at").over(order) <= NEAR, 0).otherwise(1)).over(order)
    kept = kept.withColumn("session", session)
    best = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("k"), F.desc(F.least("n_before", "n_after")), "at"))
    kept = kept.withColumn("place", best)
    base = kept.filter("place = 1").select("session", F.col("at").alias("boundary"), F.col("n_before").alias("nb"), F.col("n_after").alias("na"))
    rows = changes.join(F.broadcast(kept.select("at", "session")), "at").join(F.broadcast(base), "session")
    own = Window.partitionBy("session", "column")
    rows = rows.withColumn("first", F.min(F.when(F.col("at") == F.col("boundary"), F.lit(-1)).otherwise(F.col("at"))).over(own))
    rows = rows.filter(F.col("first") == F.when(F.col("at") == F.col("boundary"), F.lit(-1)).otherwise(F.col("at")))
    show = lambda c: F.date_format(F.date_add(F.lit("1970-01-01"), F.col(c)), "yyyy-MM-dd")
    return rows.select(show("boundary").alias("boundary"), "column", "kind", "before", "after", show("at").alias("day"), F.col("nb").alias("n_before"), F.col("na").alias("n_after"))


def label_sides(df: DataFrame, column: str, day: str, at: str) -> DataFrame:
    """``value, side, n, first, last, rate`` for values of a column that stop (old) or start (new) around a date.

    Five rows or more, nine tenths of them on one side, the last (or first) within 15 % of the table's days of the date."""
    _, span = dated_extent(df, day)
    cut = F.datediff(F.lit(at).cast("date"), F.lit("1970-01-01"))
    g = df.filter(F.col(day).isNotNull()).select(norm_key(F.col(column), dict(df.dtypes)[column]).cast("string").alias("value"), day_number(F.col(day)).alias("d")).filter("value is not null")
    g = g.groupBy("value").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.count_if(F.col("d") < cut).alias("b")).filter("n >= 5")
    old = (F.col("b") >= 0.9 * F.col("n")) & (F.col("last") >= cut - OVERLAP * span)
    new = (F.col("b") <= 0.1 * F.col("n")) & (F.col("first") <= cut + OVERLAP * span)
    g = g.withColumn("side", F.when(old, "old").when(new, "new")).filter("side is not null")
    return g.select("value", "side", "n", "first", "last", (F.col("n") / (F.col("last") - F.col("first") + 1)).alias("rate"))


def mutual_best(scored: DataFrame) -> DataFrame:
    """``a, b, score``: the pairs that greedy choice by (score, then a, then b) takes, each ``a`` and ``b`` once.

    In each round the pairs that are the best left of both their ends are taken at once, and all others of their ends
    go; that is what taking one pair after another gives. A pair is dropped at the end if its ``a`` has another
    partner of the same score or more that no better pair took: then nothing tells them apart. Pairs are distinct.
    """
    left, rounds, scored = staged(scored.select("a", "b", "score").distinct(), "left"), [], None
    every = left
    while not left.isEmpty():
        order = [F.desc("score"), "a", "b"]
        place = left.withColumn("_a", F.row_number().over(Window.partitionBy("a").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("b").orderBy(*order)))
        taken = staged(place.filter("_a = 1 and _b = 1").select("a", "b", "score"), "taken")
        rounds.append(taken)
        left = staged(left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"), "left")
    if not rounds:
        return every
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    rival = every.join(out.select(F.col("b"), F.col("score").alias("got")), "b", "left").select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("score").alias("rs"), "got")
    return out.join(rival, (F.col("a") == F.col("ra")) & (F.col("b") != F.col("rb")) & (F.col("rs") >= F.col("score")) & (F.col("got").isNull() | (F.col("got") <= F.col("score"))), "left_anti")


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.expr(f"regexp_extract_all(lower({c}), '[a-z]+', 0)")))


def handoffs(df: DataFrame, column: str, day: str, at: str, others: list[str]) -> DataFrame:
    """``old, new, via, jaccard, shared``: which new value of ``column`` takes over from which old one around a date.

    By the values of another column that their rows share: the column with the largest mean lead of the best new value
    over all other values; a partner needs a Jaccard of 0.5 and 0.3 more than any other value. Old values that no
    column tells apart are paired by when they run (overlapping a month at most), rows a day (half to twice) and the
    mix of another column of 2 to 30 values (cosine 0.9) or spelling (0.6), each once (:func:`mutual_best`); those have
    a jaccard of 0. A new value of the same words is the same value. ``others`` are columns to read; null values don't count.
    """
    kinds = dict(df.dtypes)
    sides = staged(label_sides(df, column, day, at), "labels")
    old, new = sides.filter("side = 'old'"), sides.filter("side = 'new'")
    tall = df.select(norm_key(F.col(column), kinds[column]).cast("string").alias("value"), F.inline(F.array(*(F.struct(F.lit(c).alias("via"), norm_key(F.col(c), kinds[c]).cast("string").alias("x")) for c in others))))
    mix = staged(tall.filter("value is not null and x is not null").groupBy("value", "via", "x").agg(F.count("*").alias("c")), "mix")
    sizes = mix.groupBy("value", "via").agg(F.count("*").alias("size"))
    share = mix.join(old.select("value"), "value").select(F.col("value").alias("a"), "via", "x").join(mix.select(F.col("value").alias("v"), "via", "x"), ["via", "x"]).filter("a <> v")
    share = share.groupBy("via", "a", "v").agg(F.count("*").alias("shared"))
    share = share.join(sizes.select(F.col("value").alias("a"), "via", F.col("size").alias("sa")), ["a", "via"]).join(sizes.select(F.col("value").alias("v"), "via", F.col("size").alias("sv")), ["v", "via"])
    jac = staged(share.withColumn("jaccard", F.col("shared") / (F.col("sa") + F.col("sv") - F.col("shared"))).join(new.select(F.col("value").alias("v"), F.lit(True).alias("is_new")), "v", "left"), "jaccard")
    top = jac.filter("is_new").groupBy("via", "a").agg(F.max(F.struct("jaccard", F.col("v").alias("b"))).alias("m"))
    lead = top.join(jac, ["via", "a"], "left").groupBy("via", "a", "m").agg(F.coalesce(F.max(F.when(F.col("v") != F.col("m.b"), F.col("jaccard"))), F.lit(0.0)).alias("rest"))
    lead = staged(lead.select("via", "a", F.col("m.b").alias("b"), F.col("m.jaccard").alias("jaccard"), (F.col("m.jaccard") - F.col("rest")).alias("lead")), "leads")
    n_old = old.count()
    place = F.create_map(*(F.lit(v) for i, c in enumerate(others) for v in (c, i))) if others else F.lit(None)
    best = lead.groupBy("via").agg((F.sum("lead") / n_old).alias("score")).orderBy(F.desc("score"), F.element_at(place, F.col("via"))).limit(1).select("via") if others else lead.select("via").limit(0)
    fit = lead.join(F.broadcast(best), "via").filter("jaccard >= 0.5 and lead >= 0.3").filter(~(_words("a") == _words("b")))
    fit = fit.join(jac.select("via", "a", F.col("v").alias("b"), "shared"), ["via", "a", "b"])
    fit = staged(fit.select(F.col("a").alias("old"), F.col("b").alias("new"), "via", F.round("jaccard", 3).alias("jaccard"), "shared"), "fits")
    # what is left: by when values run, their pace, and their mix or spelling
    x = old.join(fit.select(F.col("old").alias("value")), "value", "left_anti").select(F.col("value").alias("a"), F.col("last").alias("la"), F.col("rate").alias("ra"))
    y = new.join(fit.select(F.col("new").alias("value")), "value", "left_anti").select(F.col("value").alias("b"), F.col("first").alias("fb"), F.col("rate").alias("rb"))
    meet = x.join(y, (F.col("la") <= F.col("fb") + 31) & (F.least("ra", "rb") >= 0.5 * F.greatest("ra", "rb"))).filter(~(_words("a") == _words("b"))).select("a", "b")  # labels of one column: at most 60 a side
    meet = staged(meet, "meet")
    mixes = mix.groupBy("via").agg(F.count_distinct("x").alias("k")).filter("k between 2 and 30").select("via")
    some = mix.join(F.broadcast(mixes), "via")
    norm = some.groupBy("value", "via").agg(F.sqrt(F.sum(F.col("c").cast("double") * F.col("c"))).alias("norm"))
    dots = meet.join(some.select(F.col("value").alias("a"), "via", "x", F.col("c").alias("ca")), "a").join(some.select(F.col("value").alias("b"), "via", "x", F.col("c").alias("cb")), ["b", "via", "x"])
    dots = dots.groupBy("a", "b", "via").agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("dot"))
    cos = dots.join(norm.select(F.col("value").alias("a"), "via", F.col("norm").alias("na")), ["a", "via"]).join(norm.select(F.col("value").alias("b"), "via", F.col("norm").alias("nb")), ["b", "via"])
    cos = cos.groupBy("a", "b").agg(F.max(F.struct((F.col("dot") / (F.col("na") * F.col("nb"))).alias("cos"), "via")).alias("m"))
    scored = meet.join(cos, ["a", "b"], "left").withColumn("spell", _likeness("a", "b")).select("a", "b", F.coalesce("m.cos", F.lit(0.0)).alias("cos"), "m.via", "spell")
    scored = staged(scored.filter("cos >= 0.9 or spell >= 0.6").withColumn("score", F.col("cos") + F.col("spell")), "scored")
    rest = mutual_best(scored).join(scored.select("a", "b", "via"), ["a", "b"])
    return fit.unionByName(rest.select(F.col("a").alias("old"), F.col("b").alias("new"), F.coalesce("via", F.lit(column)).alias("via"), F.lit(0.0).alias("jaccard"), F.lit(0).cast("long").alias("shared")))
