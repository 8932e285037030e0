"""Analytic recipes: one small result each, from aggregations that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key
from tidemark.functions.order_stats import nth, ordered_values
from tidemark.functions.scratch import staged
from tidemark.operators.profile import distinct_counts

CENT = 0.0051


def _ranked_totals(totals: DataFrame, value: str, parts: int = 16) -> DataFrame:
    """``totals`` with ``before``: the sum of all larger values. Sums run within value ranges whose bounds are
    quantiles, then over the ranges, so no task sees all rows."""
    bounds = sorted(set(totals.approxQuantile(value, [i / parts for i in range(1, parts)], 0.01)))
    part = sum((F.when(F.col(value) >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    t = totals.withColumn("_part", part)
    own = Window.partitionBy("_part").orderBy(F.desc(value), *[c for c in totals.columns if c != value]).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy("_part").agg(F.sum(value).alias("_s")).select("_part", F.coalesce(F.sum("_s").over(down), F.lit(0.0)).alias("_base"))
    return t.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0.0))).join(F.broadcast(base), "_part").withColumn("before", F.col("_own") + F.col("_base")).drop("_part", "_own", "_base")


def pareto(df: DataFrame, entity: str, amount: str, share: float = 0.8) -> DataFrame:
    """The fewest entities that cover ``share`` of the positive total, and how many there are, those without a
    positive total included; no row below five entities or without a positive total. Rows without an entity or an
    amount don't count."""
    rows = df.filter(F.col(entity).isNotNull() & F.col(amount).isNotNull())
    t = staged(rows.groupBy(entity).agg(F.sum(amount).cast("double").alias("amount")), "entities")
    all_ = t.agg(F.count("*").alias("n"), F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("total")).first()
    if all_["n"] < 5 or not all_["total"]:
        return df.sparkSession.createDataFrame([], "n_covering long, n_entities long")
    ranked = _ranked_totals(t.filter("amount > 0"), "amount")
    return ranked.agg(F.count_if(F.col("before") < share * all_["total"]).alias("n_covering"), F.lit(all_["n"]).cast("long").alias("n_entities"))


def top_share(df: DataFrame, entity: str, amount: str) -> DataFrame:
    """The largest entity and its share of the positive total (ties: the greatest name)."""
    t = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.sum(amount).cast("double").alias("a"))
    r = t.agg(F.max(F.struct("a", F.col(entity).alias("e"))).alias("m"), F.sum(F.when(F.col("a") > 0, F.col("a"))).alias("s"))
    return r.select(F.col("m.e").cast("string").alias("entity"), F.round("m.a", 2).alias("amount"), F.round(F.col("m.a") / F.col("s"), 6).alias("share"))


def product_check(df: DataFrame, quantity: Column, price: Column, total: Column) -> DataFrame:
    """Rows whose quantity times price is the total to a cent."""
    ok = F.abs(quantity * price - total) <= CENT
    return df.filter(quantity.isNotNull() & price.isNotNull() & total.isNotNull()).agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_equal"), F.round(F.avg(ok.cast("double")), 6).alias("share"))


def negatives(df: DataFrame, amount: str) -> DataFrame:
    """How many amounts are below zero, and their sum (null if none is); nulls don't count."""
    return df.agg(F.count_if(F.col(amount) < 0).alias("n_negative"), F.round(F.sum(F.when(F.col(amount) < 0, F.col(amount))), 2).alias("sum_negative"))


def mixed(df: DataFrame, column: str, k: int = 4) -> DataFrame:
    """The ``k`` most frequent values with their shares (ties by value)."""
    h = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("t"))
    return h.orderBy(F.desc("n"), "value").limit(k).join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def date_range(df: DataFrame, column: str) -> DataFrame:
    """The first and the last day and how many months they span; nulls don't count, an empty column gives nulls."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("z"))
    months = (F.year("z") - F.year("a")) * 12 + F.month("z") - F.month("a") + 1
    return r.select(F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("z", "yyyy-MM-dd").alias("last_day"), months.cast("long").alias("n_months"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values are repeated, and how many rows are more than the first."""
    g = df.groupBy(*columns).count().filter("count > 1")
    return g.agg(F.count("*").alias("n_values"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_extra"))


def blank_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """The share of nulls of each column (null for an empty table)."""
    one = df.agg(*(F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("blank_rate")) for c in columns))))


def count_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many different values each column has, nulls apart."""
    counts = distinct_counts(df, {c: [F.col(c)] for c in columns}).withColumnRenamed("name", "column")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(F.broadcast(counts), "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def _priced(df: DataFrame, item: str, entity: str, period: Column, price: Column, quantity: Column) -> DataFrame:
    return df.select(F.col(item).alias("item"), F.col(entity).alias("entity"), period.alias("period"), price.alias("price"), quantity.alias("quantity")).filter("item is not null and price > 0 and quantity > 0")


def spread(df: DataFrame, item: str, entity: str, period: Column, price: Column, quantity: Column, gap: float = 0.05) -> DataFrame:
    """Items with prices over ``gap`` apart between entities in one period: their number of periods and what was
    paid above the lowest price. Sums of quantity and money replace a join back to the lines."""
    x = _priced(df, item, entity, period, price, quantity)
    g = x.groupBy("item", "period").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.min("entity").alias("e1"), F.max("entity").alias("e2"),
                                        F.sum(F.col("price") * F.col("quantity")).alias("paid"), F.sum("quantity").alias("q"))
    g = g.filter((F.col("e1") != F.col("e2")) & (F.col("hi") > F.col("lo") * (1 + gap)))
    return g.groupBy("item").agg(F.count("*").alias("n_periods"), F.round(F.sum(F.col("paid") - F.col("lo") * F.col("q")) + 1e-6, 2).alias("excess"))  # half cents go up whatever the order of the sum


def price_trend(df: DataFrame, item: str, entity: str, period: Column, price: Column, quantity: Column) -> DataFrame:
    """Items whose price is one for all entities in each period and moves in time."""
    x = _priced(df, item, entity, period, price, quantity)
    g = x.groupBy("item", "period").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    i = g.groupBy("item").agg(F.count("*").alias("n_periods"), F.max(F.col("hi") - F.col("lo")).alias("width"), F.min("lo").alias("low"), F.max("hi").alias("high"))
    return i.filter("n_periods >= 2 and width <= 0.005 and high - low > 0.005").select("item", "n_periods", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


def balanced_groups(df: DataFrame, group: str, net: Column) -> DataFrame:
    """How many groups of two rows or more there are, and how many net to zero to a cent."""
    g = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(net).alias("s")).filter("n >= 2")
    return g.agg(F.count("*").alias("n_groups"), F.count_if(F.abs("s") <= CENT).alias("n_balanced"))


def co_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns: rows where both, only the first and only the second are blank; one aggregation for all."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    n = lambda c: F.col(c).isNull()
    one = df.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(n(a) & n(b)).alias("n_both"), F.count_if(n(a) & ~n(b)).alias("n_a"), F.count_if(~n(a) & n(b)).alias("n_b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.col(f"p{i}") for i in range(len(pairs))))))


def group_blank_rate(df: DataFrame, group: str, column: str) -> DataFrame:
    """For each group (null is one) its rows and the share of nulls."""
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.round(F.avg(F.col(column).isNull().cast("double")), 6).alias("blank_rate"))


def entity_outliers(df: DataFrame, entity: str, amount: str) -> DataFrame:
    """Entities whose total lies beyond the third quartile by three times the quartiles' distance.

    Quartiles are elements: those after a quarter and three quarters of the sorted totals. Rows without an entity don't count."""
    t = staged(df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.sum(amount).cast("double").alias("total")), "totals")
    q = ordered_values(t, [], "total", {"q1": nth(0.25), "q3": nth(0.75)}).drop("n")
    return t.join(F.broadcast(q)).filter(F.col("total") > F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).select(entity, F.round("total", 2).alias("total"))


def ratio_outliers(df: DataFrame, key: list[str], base: str, other: str, z: float = 5.0) -> DataFrame:
    """``key..., ratio``: rows whose ratio ``other`` / ``base`` is over ``z`` robust deviations (1.4826 times the median distance) from the median.

    Nothing is said of fewer than 30 rows (with a base above zero and another of zero or more), where the 5th and the
    95th of 100 ratios are more than 2.5 times apart or not above zero, where half the ratios are one, or where more than
    one row in a hundred, or three, would be named (one may always be). Medians are upper elements.
    """
    r = df.filter((F.col(base) > 0) & (F.col(other) >= 0)).select(*(F.col(k).alias(f"_{k}") for k in key), (F.col(other).cast("double") / F.col(base)).alias("ratio"))
    r = staged(r, "ratios")
    facts = ordered_values(r, [], "ratio", {"lo": F.floor(F.col("n") * 0.05), "hi": F.greatest(F.lit(0), F.floor(F.col("n") * 0.95) - 1), "med": nth(0.5)}).filter("n >= 30 and lo > 0 and hi <= 2.5 * lo")
    d = r.join(F.broadcast(facts)).withColumn("dist", F.abs(F.col("ratio") - F.col("med")))
    mad = ordered_values(d, [], "dist", {"mad": nth(0.5)}).drop("n").filter("mad > 0")
    far = d.join(F.broadcast(mad)).filter(F.col("dist") / (F.col("mad") * 1.4826) > z)
    few = far.agg(F.count("*").alias("_far"), F.max("n").alias("_all")).filter("_far <= greatest(1, least(3, 0.01 * _all))")
    return far.join(F.broadcast(few.select("_far"))).select(*(F.col(f"_{k}").alias(k) for k in key), F.round("ratio", 4).alias("ratio"))


def numbered_ids(df: DataFrame, column: str) -> DataFrame:
    """``id, why``: ids whose number stands out: a test word in it (word), all nines or all zeros of three digits or more
    (digits), or a number beyond the third quartile of its letter prefix by three times the quartiles' distance, in
    a prefix of ten ids or more (far). Ids are told apart by the common equality and shown as the least spelling; blank ones don't count."""
    kind = dict(df.dtypes)[column]
    ids = df.groupBy(norm_key(F.col(column), kind).cast("string").alias("k")).agg(F.min(F.trim(F.col(column).cast("string"))).alias("id")).filter("k is not null")
    form = r"^([A-Za-z]*)[-_ ]?([0-9]+)$"
    digits = F.regexp_extract("id", form, 2)
    p = staged(ids.select("id", F.upper(F.regexp_extract("id", form, 1)).alias("prefix"), F.when(digits != "", digits).alias("digits")).withColumn("number", F.expr("try_cast(digits as decimal(38, 0))")), "ids")
    quarters = ordered_values(p.filter("number is not null"), ["prefix"], "number", {"q1": nth(0.25), "q3": F.floor(F.col("n") * 3 / 4)}).filter("n >= 10")
    j = p.join(quarters.select("prefix", (F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).alias("limit")), "prefix", "left")
    why = F.when(F.col("id").rlike("(?i)test|dummy|xxx"), "word").when(F.col("digits").rlike("^(000+|999+)$"), "digits").when(F.col("number") > F.col("limit"), "far")
    return j.select("id", why.alias("why")).filter("why is not null")


def idle_amounts(df: DataFrame, entity: str, amounts: list[str]) -> DataFrame:
    """``entity, amount, n_rows, n_zero, share``: entities with an amount of zero (or none) on half their rows or more, six at least, where
    95 % of the others' rows have it; ``share`` is that of the others. One aggregation; others are all rows less the own."""
    kind = dict(df.dtypes)[entity]
    zero = [F.count_if(F.coalesce(F.col(a) == 0, F.lit(True))).alias(f"z{i}") for i, a in enumerate(amounts)]
    per = staged(df.groupBy(norm_key(F.col(entity), kind).alias("entity")).agg(F.count("*").alias("n_rows"), *zero).filter("entity is not null"), "zeros")
    every = per.agg(F.sum("n_rows").alias("rows"), *(F.sum(f"z{i}").alias(f"a{i}") for i in range(len(amounts))))
    tall = per.join(F.broadcast(every)).select("entity", "n_rows", "rows", F.inline(F.array(*(F.struct(F.lit(a).alias("amount"), F.col(f"z{i}").alias("n_zero"), F.col(f"a{i}").alias("zeros")) for i, a in enumerate(amounts)))))
    rest, live = F.col("rows") - F.col("n_rows"), F.col("rows") - F.col("n_rows") - (F.col("zeros") - F.col("n_zero"))
    hit = (F.col("n_zero") >= 6) & (2 * F.col("n_zero") >= F.col("n_rows")) & (rest > 0) & (live >= 0.95 * rest)
    return tall.filter(hit).select("entity", "amount", "n_rows", "n_zero", F.round(live / rest, 6).alias("share"))


def placeholder_ids(df: DataFrame, column: str, amount: str, day: str | None = None, cuts: list[str] = ()) -> DataFrame:
    """``id, why, sign``: ids of :func:`numbered_ids` with one more sign: all rows on one side of a day at which the
    table changes (side), or one amount on three rows or more where under 5 % of the others have that (constant)."""
    kind = dict(df.dtypes)[column]
    days = [F.min(F.to_date(day)).alias("first"), F.max(F.to_date(day)).alias("last")] if day else [F.lit(None).cast("date").alias("first"), F.lit(None).cast("date").alias("last")]
    per = df.groupBy(norm_key(F.col(column), kind).cast("string").alias("k")).agg(F.min(F.trim(F.col(column).cast("string"))).alias("id"), F.count("*").alias("n"), F.count(amount).alias("f"), F.min(amount).alias("lo"), F.max(amount).alias("hi"), *days)
    per = staged(per.filter("k is not null").withColumn("steady", F.expr("n >= 3 and f = n and lo = hi")), "entities")
    every = per.agg(F.count("*").alias("all_ids"), F.count_if("steady").alias("all_steady"))
    side = F.lit(False)
    for c in cuts:
        side = side | (F.col("last") < F.lit(c).cast("date")) | (F.col("first") >= F.lit(c).cast("date"))
    sign = F.when(F.coalesce(side, F.lit(False)), "side").when(F.col("steady") & (F.col("all_steady") - 1 < 0.05 * (F.col("all_ids") - 1)), "constant")
    return numbered_ids(df, column).join(per.join(F.broadcast(every)).select("id", sign.alias("sign")), "id").filter("sign is not null")


def exclusive_prefixes(df: DataFrame, group: str, prefix: Column) -> DataFrame:
    """Prefixes that only one group has, with that group and the rows."""
    g = df.groupBy(prefix.alias("prefix")).agg(F.min(group).alias("only"), F.max(group).alias("hi"), F.count("*").alias("n_rows"))
    return g.filter("only = hi").select("prefix", F.col("only").cast("string").alias("only"), "n_rows")


def minority_codes(df: DataFrame, group: str, code: str, share: float = 0.2) -> DataFrame:
    """Groups that mostly keep to one code, with the rows that don't (at most ``share``)."""
    c = df.groupBy(group, code).agg(F.count("*").alias("n"))
    g = c.groupBy(group).agg(F.sum("n").alias("n_rows"), F.max(F.struct("n", code)).alias("m"))
    g = g.select(group, "n_rows", F.col(f"m.{code}").alias("main_code"), (F.col("n_rows") - F.col("m.n")).alias("n_other"))
    return g.filter((F.col("n_other") > 0) & (F.col("n_other") <= share * F.col("n_rows")))


def relation_links(df: DataFrame, a: str, b: str, amount: str, k: int = 4) -> DataFrame:
    """The ``k`` heaviest partners of each ``a`` (ties by partner)."""
    g = df.groupBy(a, b).agg(F.round(F.sum(amount), 2).alias("weight"))
    w = Window.partitionBy(a).orderBy(F.desc("weight"), b)
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
