"""Evidence about columns: what values carry, which columns belong together, what changes at a date."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_text
from tidemark.functions.order_stats import nth, ordered_values

NUMBER_TEXT = r"^\s*[-+]?[0-9][0-9,]*(\.[0-9]+)?\s*$"


def _unfold(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One aggregation for all ``structs``, then a row for each."""
    one = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(structs)))
    return one.select(F.inline(F.array(*(f"s{i}" for i in range(len(structs))))))


def value_stats(df: DataFrame, column: str, amount: str, day: str) -> DataFrame:
    """For each value its rows, money, money without signs, and first and last day."""
    return df.groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n_rows"), F.round(F.sum(amount), 2).alias("amount"), F.round(F.sum(F.abs(amount)), 2).alias("absolute"),
        F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"))


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct values of two columns and distinct pairs; one to one if all three are equal."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    n = pairs.agg(F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"), F.count("*").alias("n_pairs"))
    return n.withColumn("is_one_to_one", F.expr("n_pairs = n_a AND n_pairs = n_b"))


def row_stake(df: DataFrame, hit: Column, amount: str) -> DataFrame:
    """How many rows are hit and what share of the money without signs they carry."""
    return df.agg(F.count_if(hit).alias("n_hit"), F.round(F.sum(F.when(hit, F.abs(amount)).otherwise(0)) / F.sum(F.abs(amount)), 6).alias("stake"))


def monthly_totals(df: DataFrame, day: str, amount: Column) -> DataFrame:
    """An amount that is worked out in each row, by month."""
    return df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n_rows"), F.round(F.sum(amount), 2).alias("amount"))


def products_of(df: DataFrame, columns: list[str], cent: float = 0.0051) -> DataFrame:
    """For each column and two others: rows where it is their product to a cent."""
    out = []
    for whole in columns:
        for a, b in combinations([c for c in columns if c != whole], 2):
            near = F.abs(F.col(a) * F.col(b) - F.col(whole)) <= cent
            out.append(F.struct(F.lit(whole).alias("product"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(near).alias("n_equal")))
    return _unfold(df, out)


def prefix_families(df: DataFrame, column: str, least: int = 3) -> DataFrame:
    """Leading letters that ``least`` rows or more share, with their rows and distinct values."""
    prefix = F.regexp_extract(F.col(column), "^[A-Za-z]+", 0)
    g = df.filter(F.col(column).isNotNull()).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n_rows"), F.count_distinct(column).alias("n_values"))
    return g.filter((F.col("prefix") != "") & (F.col("n_rows") >= least))


def profile_change(df: DataFrame, day: str, at: str, amount: str) -> DataFrame:
    """Before and from a date on: rows, share of whole numbers, distinct values and median."""
    side = F.when(F.col(day) < F.lit(at).cast("timestamp_ntz"), "before").otherwise("after")
    rows = df.filter(F.col(amount).isNotNull() & F.col(day).isNotNull()).select(side.alias("side"), F.col(amount).alias("x"))
    per = rows.groupBy("side", "x").agg(F.count("*").alias("c"))
    facts = per.groupBy("side").agg(F.sum("c").alias("n_rows"), F.round(F.sum(F.when(F.col("x") == F.floor("x"), F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("whole_share"), F.count("*").alias("n_values"))
    return facts.join(F.broadcast(ordered_values(rows, ["side"], "x", {"median": nth(0.5)}).drop("n")), "side")  # two rows


def weekday_rows(df: DataFrame, day: str) -> DataFrame:
    """Days and rows of each weekday (Monday is 0) and its share of the rows."""
    per_day = df.filter(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("d")).agg(F.count("*").alias("n"))
    g = per_day.groupBy(F.weekday("d").alias("weekday")).agg(F.count("*").alias("n_days"), F.sum("n").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())  # seven rows at most
    return g.withColumn("share", F.round(F.col("n_rows") / total, 6))


def double_blocks(df: DataFrame, block: Column, times: float = 1.8) -> DataFrame:
    """Blocks of at least ``times`` as many rows as the median block."""
    n = df.groupBy(block.alias("block")).agg(F.count("*").alias("n_rows"))
    middle = ordered_values(n, [], "n_rows", {"median": nth(0.5)}).drop("n")
    return n.join(F.broadcast(middle)).filter(F.col("n_rows") >= times * F.col("median")).select("block", "n_rows")


def side_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns: negative rows, rows where both are filled (not null or zero) and where one is."""
    full = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    return _unfold(df, [F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if((F.col(a) < 0) | (F.col(b) < 0)).alias("n_negative"),
        F.count_if(full(a) & full(b)).alias("n_both"), F.count_if(full(a) | full(b)).alias("n_either")) for a, b in combinations(columns, 2)])


def join_variants(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Values of ``a`` that match ``b`` only once case and white space are evened out, with their rows."""
    n = left.filter(F.col(a).isNotNull()).groupBy(F.col(a).alias("value")).agg(F.count("*").alias("n_rows"))
    ref = right.select(F.col(b).alias("value")).filter("value is not null").distinct()
    loose = ref.select(norm_text(F.col("value")).alias("k")).distinct()
    return n.join(ref, "value", "left_anti").withColumn("k", norm_text(F.col("value"))).join(loose, "k", "left_semi").select("value", "n_rows")


def numbers_as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled rows of text columns, and those that hold a number."""
    return _unfold(df, [F.struct(F.lit(c).alias("column"), F.count(c).alias("n_filled"), F.count_if(F.col(c).rlike(NUMBER_TEXT)).alias("n_numbers")) for c in columns])


def latest_totals(df: DataFrame, day: str, group: str, amount: str) -> DataFrame:
    """Totals of a stock amount by group on the last day alone."""
    last = df.agg(F.max(F.to_date(day)).alias("last"))
    rows = df.join(F.broadcast(last), F.to_date(day) == F.col("last"))
    return rows.groupBy(group).agg(F.count("*").alias("n_rows"), F.round(F.sum(amount), 2).alias("amount"))


def window_columns(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """Ordered pairs of date columns of which the second isn't before the first on ``share`` of their rows."""
    pairs = _unfold(df, [F.struct(F.lit(a).alias("start"), F.lit(z).alias("end"), F.count_if(F.col(a).isNotNull() & F.col(z).isNotNull()).alias("n_rows"),
                                  F.count_if(F.col(z) >= F.col(a)).alias("n_ordered")) for a, z in permutations(columns, 2)])
    return pairs.filter((F.col("n_rows") > 0) & (F.col("n_ordered") >= share * F.col("n_rows")))


def status_lines_up(df: DataFrame, status: str, column: str) -> DataFrame:
    """For each status value its rows and how many of them lack ``column``; equal sets if both are all blank rows."""
    g = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_blank"))
    blank = F.sum("n_blank").over(Window.partitionBy())  # one row for each status
    return g.withColumn("lines_up", (F.col("n_rows") == F.col("n_blank")) & (F.col("n_blank") == blank) & (F.col("n_rows") >= 5))


def never_credited(df: DataFrame, entity: str, period: Column, credit: Column, least: int = 3) -> DataFrame:
    """Entities that are active in ``least`` periods or more and have no credit row."""
    g = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count_distinct(period).alias("n_periods"), F.count("*").alias("n_rows"), F.count_if(credit).alias("n_credits"))
    return g.filter((F.col("n_periods") >= least) & (F.col("n_credits") == 0)).drop("n_credits")


def unit_groups(df: DataFrame, group: str, quantity: str, price: str) -> DataFrame:
    """Median quantity and price of each group, and whether its unit differs: at most a third of every other
    group's quantity and at least one and a half times every other group's price."""
    q, p = (ordered_values(df, [group], c, {name: nth(0.5)}).drop("n") for c, name in ((quantity, "quantity"), (price, "price")))
    named = p.select(F.col(group).alias("_group"), "price")
    m = q.join(named, F.col(group).eqNullSafe(F.col("_group")), "full").select(F.coalesce(group, "_group").alias(group), "quantity", "price")
    # the two least and the two greatest medians are enough to leave each group out
    low = m.orderBy("quantity").limit(2).agg(F.sort_array(F.collect_list("quantity")).alias("q"))
    high = m.orderBy(F.desc("price")).limit(2).agg(F.sort_array(F.collect_list("price"), asc=False).alias("p"))
    j = m.join(F.broadcast(low)).join(F.broadcast(high))
    other_q = F.when(F.col("quantity") == F.col("q")[0], F.try_element_at("q", F.lit(2))).otherwise(F.col("q")[0])
    other_p = F.when(F.col("price") == F.col("p")[0], F.try_element_at("p", F.lit(2))).otherwise(F.col("p")[0])
    odd = (F.col("quantity") * 3 <= other_q) & (F.col("price") >= 1.5 * other_p)
    return j.select(group, "quantity", "price", F.coalesce(odd, F.lit(False)).alias("other_unit"))


def stale_codes(codes: DataFrame, lines: DataFrame, code: str, text: str, used: str) -> DataFrame:
    """Codes without lines whose description a code with lines has too (the least such code). One code
    stands for each description, so equal descriptions don't make pairs."""
    live = codes.join(lines.select(F.col(used).alias(code)).distinct(), code, "left_semi")
    stand = live.groupBy(text).agg(F.min(code).alias("live_code"))
    idle = codes.join(lines.select(F.col(used).alias(code)).distinct(), code, "left_anti")
    return idle.join(stand, text).select(F.col(code).alias("code"), "live_code")
