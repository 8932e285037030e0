"""Groups that behave unlike the others: weighted evidence about every value of every grouping column.

Counts by day, by the values of other columns and by amounts are aggregated for each grouping column, one row
each, and every kind of evidence is a comparison of a group with its peers, the
other groups of its column with 20 rows or more; a grouping has at most 30 values, so peers fit one array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key
from tidemark.functions.order_stats import nth, ordered_values
from tidemark.functions.scratch import staged
from tidemark.operators.changes import day_number

# Fixed values of the rule: rows of a group, weights that ask, how far peers agree, and how far a group is off.
ROWS, ASK, STRONG, AGREE, FAR = 20, 4, 3, 2.5, 5
EXPECT, MISSING, MISSING_EXPECT, COVERED = 5, 2, 8, 0.9
_EVIDENCE = "grouping string, value string, kind string, weight int, about string"
_KEY = ["grouping", "value"]


def grouped_rows(df: DataFrame, groupings: list[str], *keep: Column) -> DataFrame:
    """Each row once for every grouping column that it has a value of."""
    kinds = dict(df.dtypes)
    sets = F.array(*(F.struct(F.lit(g).alias("grouping"), norm_key(F.col(g), kinds[g]).cast("string").alias("value")) for g in groupings))
    return df.select(*keep, F.inline(sets)).filter("value is not null")


def grouped_counts(df: DataFrame, groupings: list[str], by: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """``grouping, value``, ``by`` and ``sums`` over the rows of each group.

    Rows are combined by the grouping columns as they are written, and only what that leaves gets the common equality:
    a value that hangs on a count can't be filtered before it, which would bring every row to the equality."""
    kinds, parts = dict(df.dtypes), []
    for g in groupings:
        raw = df.groupBy(F.col(g).alias("_g"), *(c.alias(name) for name, c in by.items())).agg(F.count("*").alias("_n"), *(F.sum(c).alias(name) for name, c in sums.items()))
        parts.append(raw.select(F.lit(g).alias("grouping"), F.when(F.col("_n") > 0, norm_key(F.col("_g"), kinds[g]).cast("string")).alias("value"), *by, *sums))
    every = reduce(DataFrame.union, parts).filter("value is not null")  # one column at least
    return every.groupBy(*_KEY, *by).agg(*(F.sum(name).alias(name) for name in sums))


def _others(rows: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """``facts`` with the sorted ``column`` of each group's peers as ``peers``; null facts are no peers. Groups without two peers go."""
    every = facts.groupBy("grouping").agg(F.collect_list(F.struct(F.col(column).alias("x"), F.col("value").alias("v"))).alias("every"))
    own = facts.join(every, "grouping").withColumn("peers", F.expr("transform(array_sort(filter(every, e -> e.v <> value and e.x is not null)), e -> e.x)")).drop("every")
    return own.filter("size(peers) >= 2")


_MIDDLE = "element_at(peers, cast(size(peers) div 2 + 1 as int))"
_LEAST, _MOST = "peers[0]", "element_at(peers, -1)"


def _rows_of(kind: str, weight: Column | int, about: Column, df: DataFrame) -> DataFrame:
    weight = F.lit(weight) if isinstance(weight, int) else weight
    return df.select("grouping", "value", F.lit(kind).alias("kind"), weight.cast("int").alias("weight"), about.cast("string").alias("about"))


def _first_about(df: DataFrame, order: list[str]) -> DataFrame:
    """One row a group: that whose ``about`` comes first in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("about")) if order else F.lit(0)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*_KEY).orderBy(place))).filter("_r = 1").drop("_r")


def _dated(df: DataFrame, groupings: list[str], day: str, cuts: list[str], title_end: str | None) -> list[DataFrame]:
    """presence: rows of a part of the days only while others go on; late: first rows in the last tenth of the days, or after the title's end."""
    days = grouped_counts(df.filter(F.col(day).isNotNull()), groupings, {"day": day_number(F.col(day))}, {"c": F.lit(1)})
    days = staged(days, "days")
    every = df.filter(F.col(day).isNotNull()).groupBy(day_number(F.col(day)).alias("day")).agg(F.count("*").alias("c"))
    every = every.withColumn("upto", F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))  # one row a day
    every = staged(every, "calendar")
    ends = every.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.sum("c").alias("dated"))
    run = F.sum("c").over(Window.partitionBy(*_KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(*_KEY))
    d = days.withColumns({"run": run, "total": total}).withColumn("cut", F.floor(F.col("total") * 0.02))
    terms = d.groupBy(*_KEY).agg(F.max("total").alias("n"), F.min("day").alias("first"), F.min(F.when(F.col("run") > F.col("cut"), F.col("day"))).alias("s"), F.min(F.when(F.col("run") > F.col("total") - 1 - F.col("cut"), F.col("day"))).alias("e"))
    inside = d.join(terms.select(*_KEY, "s", "e"), _KEY).groupBy(*_KEY).agg(F.sum(F.when((F.col("day") < F.col("s")) | (F.col("day") > F.col("e")), F.col("c")).otherwise(0)).alias("own_out"))
    t = terms.filter(F.col("n") >= ROWS).join(inside, _KEY).join(F.broadcast(ends)).withColumn("span", F.col("hi") - F.col("lo")).filter("span >= 28")
    at_s = every.select(F.col("day").alias("s"), (F.col("upto") - F.col("c")).alias("before_s"))
    at_e = every.select(F.col("day").alias("e"), F.col("upto").alias("upto_e"))
    t = t.join(at_s, "s").join(at_e, "e")
    outside = F.col("before_s") + F.col("dated") - F.col("upto_e") - F.col("own_out")
    near = F.greatest(F.lit(14.0), 0.1 * F.col("span"))
    numbers = [F.datediff(F.lit(c).cast("date"), F.lit("1970-01-01")) for c in cuts]
    by_cut = F.lit(False)
    for c in numbers:
        by_cut = by_cut | (F.abs(F.col("s") - c) <= near) | (F.abs(F.col("e") - c) <= near)
    part = t.filter((F.col("e") - F.col("s") < 0.6 * F.col("span")) & (outside >= F.greatest(F.lit(5.0), 0.1 * (F.col("dated") - F.col("n")))) & ~by_cut)
    late = F.col("first") - F.col("lo") >= F.floor(0.9 * F.col("span"))
    if title_end is not None:
        late = late | (F.col("first") > F.datediff(F.lit(title_end).cast("date"), F.lit("1970-01-01")))
    return [_rows_of("presence", 3, F.lit(day), part), _rows_of("late", 3, F.lit(day), t.filter(late))]


def _private(have: DataFrame, sets: DataFrame, order: list[str]) -> DataFrame:
    """All of a group's values of a column are nobody else's, where at least half of the others' are shared."""
    held = have.withColumn("holders", F.count("*").over(Window.partitionBy("grouping", "column", "x")))
    own = held.groupBy(*_KEY, "column").agg(F.max("holders").alias("most"), F.count("*").alias("k"))
    every = held.groupBy("grouping", "column", "x").agg(F.max("holders").alias("h")).groupBy("grouping", "column").agg(F.count("*").alias("every"), F.count_if(F.col("h") >= 2).alias("shared"))
    alone = own.filter("most = 1").join(every, ["grouping", "column"]).filter("every >= 3 and every > k and shared >= 0.5 * (every - k)")
    return _first_about(_rows_of("private", 3, F.col("column"), alone.join(sets, _KEY)), order)


def _shares(sums: DataFrame, df_total: DataFrame, money: str | None, measures: list[str]) -> list[DataFrame]:
    """share: far more of the money than of the rows; measure: a fifth or more of another amount, three times the group's share of rows."""
    out, big = [], sums.filter(F.col("n") >= ROWS).join(F.broadcast(df_total))
    if money is not None:
        m = big.filter(F.col(f"all_{money}") > 0).withColumn("part", F.coalesce(F.col(f"abs_{money}"), F.lit(0.0)) / F.col(f"all_{money}"))
        m = _others(big, m.withColumn("ratio", F.col("part") / (F.col("n") / F.col("rows"))), "ratio")
        agree = F.expr(f"{_LEAST} > 0 and {_MOST} <= {AGREE} * {_LEAST}")
        x = F.col("ratio") / F.expr(_MIDDLE)
        weight = F.when(agree, F.when((x >= 5) & (F.col("part") >= 0.2), 4).when((x >= 3) & (F.col("part") >= 0.1), 2)).when(F.expr(f"{_MOST} > 0 and ratio >= {FAR} * {_MOST} and part >= 0.2"), 4)
        out.append(_rows_of("share", F.col("weight"), F.lit(money), m.withColumn("weight", weight).filter("weight is not null")))
    found = []
    for c in measures:
        s = big.filter((F.col(f"all_{c}") > 0) & (F.col(f"minus_{c}") == 0)).withColumn("part", F.coalesce(F.col(f"abs_{c}"), F.lit(0.0)) / F.col(f"all_{c}"))
        s = _others(big, s.withColumn("ratio", F.col("part") / (F.col("n") / F.col("rows"))), "ratio")
        found.append(_rows_of("measure", 3, F.lit(c), s.filter(F.expr(f"part >= 0.2 and ratio >= 3 and {_MOST} < 2"))))
    if found:
        tall = found[0]
        for f in found[1:]:
            tall = tall.union(f)
        out.append(_first_about(tall, measures))
    return out


def _prices(df: DataFrame, groupings: list[str], price: str) -> DataFrame:
    """The median price is five times every peer's, the peers agree (or it is ten times), and peers have more than one price each."""
    rows = staged(grouped_rows(df.filter(F.col(price) > 0), groupings, F.col(price).cast("double").alias("p")), "prices")
    middle = ordered_values(rows, _KEY, "p", {"middle": nth(0.5)}).filter("n >= 5")
    kinds = rows.groupBy(*_KEY, F.round("p", 4).alias("p")).agg(F.lit(1).alias("one")).groupBy(*_KEY).agg(F.count("*").alias("kinds"))
    sizes = grouped_rows(df, groupings).groupBy(*_KEY).agg(F.count("*").alias("of")).filter(F.col("of") >= ROWS)
    facts = staged(middle.join(kinds, _KEY).join(sizes, _KEY), "medians")
    m = _others(facts, facts, "middle")
    k = _others(facts, facts, "kinds").select(*_KEY, F.expr(_MIDDLE).alias("peer_kinds"))
    agree = f"{_MOST} <= {AGREE} * {_LEAST}"
    return _rows_of("price", 3, F.lit(price), m.join(k, _KEY).filter(F.expr(f"peer_kinds >= 2 and {_LEAST} > 0 and middle >= {FAR} * {_MOST} and ({agree} or middle >= {2 * FAR} * {_MOST})")))


def _absent(have: DataFrame, sizes: DataFrame, distinct: DataFrame, private: DataFrame, order: list[str]) -> list[DataFrame]:
    """missing: values that every peer has; lifecycle: a status that peers often have; items: far fewer values than peers."""
    big = sizes.filter(F.col("n") >= ROWS)
    of = big.groupBy("grouping").agg(F.sum("n").alias("big_rows"), F.count("*").alias("big_groups"))
    big = big.join(of, "grouping").filter("big_groups >= 3")
    h = have.join(big.select(*_KEY), _KEY)
    per = h.groupBy("grouping", "column", "x").agg(F.sum("c").alias("m"), F.count("*").alias("holders"))
    absent = big.join(per, "grouping").join(h.select(*_KEY, "column", "x"), [*_KEY, "column", "x"], "left_anti").join(distinct, "column")  # groups of at most 30 by columns of at most 30 values
    absent = absent.withColumn("expected", F.col("m") / (F.col("big_rows") - F.col("n")) * F.col("n"))
    gone = absent.filter((F.col("k") <= 30) & (F.col("holders") == F.col("big_groups") - 1) & (F.col("expected") >= MISSING_EXPECT))
    gone = gone.join(private.select(*_KEY, F.col("about").alias("column")), [*_KEY, "column"], "left_anti")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("column"))
    two = gone.withColumn("_r", F.row_number().over(Window.partitionBy(*_KEY).orderBy(place, F.desc("m"), "x"))).filter(F.col("_r") <= MISSING)
    status = absent.filter((F.col("k") <= 8) & (F.col("m") >= 0.05 * (F.col("big_rows") - F.col("n"))) & (F.col("holders") * 3 >= 2 * (F.col("big_groups") - 1)) & (F.col("expected") >= EXPECT))
    status = status.withColumn("_r", F.row_number().over(Window.partitionBy(*_KEY).orderBy(place, F.desc("m"), "x"))).filter("_r = 1")
    counts = h.groupBy(*_KEY, "column").agg(F.count("*").alias("items")).join(distinct.filter("k >= 10").select("column"), "column")
    every = counts.groupBy("grouping", "column").agg(F.collect_list(F.struct(F.col("items").alias("x"), F.col("value").alias("v"))).alias("every"))
    few = counts.join(every, ["grouping", "column"]).withColumn("peers", F.expr("transform(array_sort(filter(every, e -> e.v <> value)), e -> e.x)")).filter(F.expr(f"size(peers) >= 2 and items <= 0.34 * {_MIDDLE}"))
    named = F.concat_ws("=", "column", "x")
    return [_rows_of("missing", 1, named, two), _rows_of("lifecycle", 1, named, status), _first_about(_rows_of("items", 1, F.col("column"), few), order)]


def group_evidence(df: DataFrame, groupings: list[str], day: str | None = None, money: str | None = None, price: str | None = None, measures: list[str] = (), categories: list[str] = (),
                   cuts: list[str] = (), title_end: str | None = None) -> DataFrame:
    """``grouping, value, kind, weight, about``: all evidence about groups of 20 rows or more.

    Values are compared by the common equality; null and blank ones are no group. ``groupings`` have 2 to 30 values;
    ``categories`` are columns whose values may be private, missing or few; ``measures`` and ``money`` are amounts;
    ``cuts`` are days at which the table changes, near which no presence is odd. Evidence by amounts, prices and
    values needs two peers. Nulls don't count; an empty table gives no evidence.
    """
    kinds = dict(df.dtypes)
    amounts = list(dict.fromkeys([*([money] if money else []), *measures]))
    cast = lambda c: F.col(c).cast("double")
    ones = lambda hit: F.when(hit, 1).otherwise(0)
    facts = {name: x for c in amounts for name, x in ((f"abs_{c}", F.abs(cast(c))), (f"minus_{c}", ones(cast(c) < 0)), (f"on_{c}", ones(cast(c) != 0)))}
    sums = staged(grouped_counts(df, groupings, {}, {"n": F.lit(1)} | facts), "sums")
    total = df.agg(F.count("*").alias("rows"), *(f for c in amounts for f in (F.sum(F.abs(cast(c))).alias(f"all_{c}"), F.count_if(cast(c) != 0).alias(f"all_on_{c}"))))
    sums_clean = sums.drop(*(f"minus_{c}" for c in amounts)).join(sums.groupBy("grouping").agg(F.lit(1).alias("_one"), *(F.sum(f"minus_{c}").alias(f"minus_{c}") for c in amounts)), "grouping").drop("_one")
    parts = _dated(df, groupings, day, list(cuts), title_end) if day else []
    parts += _shares(sums_clean, total, money, [m for m in measures if m not in (money, price)])
    if price:
        parts.append(_prices(df, groupings, price))
    # no adjustment on any row, where peers have one on a tenth of theirs
    on = sums.filter(F.col("n") >= ROWS).join(F.broadcast(total))
    for c in [m for m in measures if m not in (money, price)]:
        w = Window.partitionBy("grouping")
        x = on.withColumns({"peer_n": F.sum("n").over(w) - F.col("n"), "peer_on": F.sum(f"on_{c}").over(w) - F.col(f"on_{c}"), "peers": F.count("*").over(w) - 1})
        parts.append(_rows_of("adjust", 1, F.lit(c), x.filter((F.col("peers") >= 2) & (F.col("peer_on") >= 0.1 * F.col("peer_n")) & (F.col(f"on_{c}") == 0) & (F.col("rows") - F.col(f"all_on_{c}") >= 0.3 * F.col("rows")) & (F.col("peer_on") / F.col("peer_n") * F.col("n") >= EXPECT))))
    if categories:
        have = staged(_values_of(df, groupings, categories), "values")
        big = sums.filter(F.col("n") >= ROWS).select(*_KEY)
        distinct = staged(have.groupBy("column", "x").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("k")).filter("k >= 2"), "distinct")
        private = staged(_private(have, big, list(categories)), "private")
        parts += [private, *_absent(have, sums.select(*_KEY, "n"), distinct, private, list(categories))]
    out = df.sparkSession.createDataFrame([], _EVIDENCE)
    for p in parts:
        out = out.unionByName(p)
    once = Window.partitionBy(*_KEY, "kind").orderBy("about")  # of one kind one piece counts, but for missing values
    return out.withColumn("_r", F.row_number().over(once)).filter("_r = 1 or kind = 'missing'").drop("_r")


def _values_of(df: DataFrame, groupings: list[str], categories: list[str]) -> DataFrame:
    """``grouping, value, column, x, c``: the values of categories within each group, with their rows."""
    kinds, parts = dict(df.dtypes), []
    for c in categories:
        others = [g for g in groupings if g != c]
        if others:
            raw = grouped_counts(df.filter(F.col(c).isNotNull()), others, {"x": F.col(c)}, {"c": F.lit(1)})
            parts.append(raw.select(*_KEY, F.lit(c).alias("column"), F.when(F.col("c") > 0, norm_key(F.col("x"), kinds[c]).cast("string")).alias("x"), "c"))
    if not parts:
        return df.sparkSession.createDataFrame([], "grouping string, value string, column string, x string, c long")
    return reduce(DataFrame.union, parts).filter("x is not null").groupBy(*_KEY, "column", "x").agg(F.sum("c").alias("c"))


def odd_groups(df: DataFrame, groupings: list[str], evidence: DataFrame) -> DataFrame:
    """``grouping, value, n_rows, weight, kinds`` of groups with a weight of 4 or more, one piece of it 3 or more.

    A group is left out if nine tenths of its rows belong to one that is kept: the heavier goes first, then that of
    the column with fewer values, then the larger, then by name. Groups that ask are few (groupings times 30 at most), so
    the order is settled on the driver; their rows are counted where they are.
    """
    asking = evidence.groupBy(*_KEY).agg(F.sum("weight").alias("weight"), F.max("weight").alias("strong"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))
    asking = staged(asking.filter((F.col("weight") >= ASK) & (F.col("strong") >= STRONG)).drop("strong"), "asking")
    values = grouped_counts(df, groupings, {}, {"n_rows": F.lit(1)})
    found = asking.join(values, _KEY).join(values.groupBy("grouping").agg(F.count("*").alias("k")), "grouping").collect()
    kinds, names = dict(df.dtypes), [(r["grouping"], r["value"]) for r in found]
    asked = list(dict.fromkeys(g for g, _ in names))
    at = {g: f"_g{i}" for i, g in enumerate(asked)}
    # rows that are written alike are combined, then brought to the common equality once
    alike = df.groupBy(*(F.col(g).alias(at[g]) for g in asked)).agg(F.count("*").alias("_c")).select("_c", *(norm_key(F.col(at[g]), kinds[g]).cast("string").alias(at[g]) for g in asked))
    hit = [F.coalesce(F.col(at[g]) == F.lit(v), F.lit(False)) for g, v in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names)) if i < j]
    both = alike.groupBy(*at.values()).agg(F.sum("_c").alias("_c")).agg(*(F.sum(F.when(hit[i] & hit[j], F.col("_c")).otherwise(0)).alias(f"b{i}_{j}") for i, j in pairs)).first() if pairs else None
    order, kept = sorted(range(len(found)), key=lambda i: (-found[i]["weight"], found[i]["k"], -found[i]["n_rows"], names[i])), []
    for i in order:
        if not any(both[f"b{min(i, j)}_{max(i, j)}"] >= COVERED * found[i]["n_rows"] for j in kept):
            kept.append(i)
    return df.sparkSession.createDataFrame([(*names[i], found[i]["n_rows"], int(found[i]["weight"]), found[i]["kinds"]) for i in kept], "grouping string, value string, n_rows long, weight int, kinds string")
