"""Join-shaped checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key

_NEVER = 2_000_000_000  # a day number that no date has


def unmatched(df: DataFrame, ref: DataFrame, key: str, ref_key: str) -> DataFrame:
    """Rows whose key has no partner, and how many different values are missing. Null and blank keys aren't counted.

    Texts are compared by the common equality (case, outer and repeated white space, end marks and leading zeros aside),
    numbers and dates as they are; a text key and a number are compared as texts."""
    kinds = dict(df.dtypes)[key], dict(ref.dtypes)[ref_key]
    own, other = norm_key(F.col(key), kinds[0]), norm_key(F.col(ref_key), kinds[1])
    if ("string" in kinds) and kinds[0] != kinds[1]:
        own, other = own.cast("string"), other.cast("string")
    counts = df.select(own.alias("_k")).filter("_k is not null").groupBy("_k").agg(F.count("*").alias("n"))
    rows = counts.join(ref.select(other.alias("_k")).distinct(), "_k", "left_anti")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_values"))


def outside_windows(lines: DataFrame, windows: DataFrame, key: str, day: str, start: str, end: str, least: int = 5, share: float = 0.05) -> DataFrame:
    """Keys with at least ``least`` lines, and ``share`` of their lines, outside all their [start, end] ranges.
    A null start or end is open; keys without a range aren't judged.

    The ranges of a key and the gaps between them are laid out as stretches of days that cover all days once, so a
    line is matched to one stretch of its key (an equi join with a range condition), and is added up at once.
    """
    bound = lambda c, open_: F.unix_date(F.coalesce(F.col(c).cast("date"), F.lit(open_).cast("date")))
    w = windows.filter(F.col(key).isNotNull()).select(key, bound(start, "0001-01-01").alias("_a"), bound(end, "9999-12-31").alias("_z"))
    w = w.filter("_a <= _z").union(w.select(key, F.lit(_NEVER).alias("_a"), F.lit(_NEVER).alias("_z")).distinct())  # a range after all days closes the last gap
    order = Window.partitionBy(key).orderBy("_a", "_z")
    w = w.withColumn("_upto", F.max("_z").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.struct(F.coalesce(F.col("_upto") + 1, F.lit(-_NEVER)).alias("_from"), (F.col("_a") - 1).alias("_to"), F.lit(0).alias("inside"))
    new = F.struct(F.greatest(F.col("_a"), F.coalesce(F.col("_upto") + 1, F.col("_a"))).alias("_from"), F.col("_z").alias("_to"), F.lit(1).alias("inside"))
    stretches = w.select(key, F.inline(F.array(gap, new))).filter("_from <= _to")
    rows = lines.filter(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, F.unix_date(F.col(day).cast("date")).alias("_d"))
    per = rows.groupBy(key, "_d").agg(F.count("*").alias("n")).withColumnRenamed(key, "_k")
    hit = per.join(stretches, (F.col("_k") == F.col(key)) & F.col("_d").between(F.col("_from"), F.col("_to")))
    out = hit.groupBy(key).agg(F.sum("n").alias("n_lines"), F.sum(F.when(F.col("inside") == 0, F.col("n")).otherwise(0)).alias("n_outside"))
    return out.filter((F.col("n_outside") >= least) & (F.col("n_outside") >= share * F.col("n_lines")))


def version_overlaps(versions: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Keys with more than one dated row, and how many rows begin before some earlier one ends. A null start or end
    is open; a null key is no key."""
    a = F.coalesce(F.col(start).cast("date"), F.lit("0001-01-01").cast("date"))
    z = F.coalesce(F.col(end).cast("date"), F.lit("9999-12-31").cast("date"))
    v = versions.select(F.col(key).alias("k"), a.alias("a"), z.alias("z")).filter("k is not null")
    before = F.max("z").over(Window.partitionBy("k").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1))
    v = v.withColumn("before", before).groupBy(F.col("k").alias(key))
    return v.agg(F.count("*").alias("n_versions"), F.count_if(F.col("a") <= F.col("before")).alias("n_overlaps")).filter("n_versions > 1")


def reference_price(lines: DataFrame, ref: DataFrame, key: str, day: str, start: str, end: str, price: str) -> DataFrame:
    """Lines with ``reference``: the price of the key's only row, else of the row that covers the day, else null.

    Rows without a price don't count; a null start or end is open. Of several rows that cover a day the one that
    starts first is taken, then the one that ends first, then the lowest price. It is chosen once for each key and
    day, so no line is repeated. A column ``reference`` of the lines gives way to the new one.
    """
    r = ref.filter(F.col(price).isNotNull()).select(F.col(key).alias("_k"), F.coalesce(F.col(start).cast("date"), F.lit("0001-01-01").cast("date")).alias("_a"),
                                                    F.coalesce(F.col(end).cast("date"), F.lit("9999-12-31").cast("date")).alias("_z"), F.col(price).alias("_price"))
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy("_k")))
    days = lines.select(F.col(key).alias("_k"), F.col(day).cast("date").alias("_d")).distinct()
    covering = days.join(r, "_k").filter((F.col("_n") == 1) | F.col("_d").between(F.col("_a"), F.col("_z")))
    y = covering.groupBy("_k", "_d").agg(F.min(F.struct("_a", "_z", "_price")).alias("_first")).select("_k", "_d", F.col("_first._price").alias("reference"))
    x, y = lines.drop("reference").alias("x"), y.alias("y")
    return x.join(y, (F.col(f"x.{key}") == F.col("y._k")) & F.col(f"x.{day}").cast("date").eqNullSafe(F.col("y._d")), "left").select("x.*", "y.reference")


def document_copies(df: DataFrame, content: list[str], key: str) -> DataFrame:
    """Rows of equal content under different keys: each content's copies and the smallest key."""
    g = df.groupBy(*content).agg(F.count("*").alias("n_copies"), F.min(key).alias("first_key"))
    return g.filter("n_copies > 1").select("first_key", "n_copies")


def twin_pairs(df: DataFrame, document: list[str], amount: str) -> DataFrame:
    """Documents that appear exactly twice, by whether their amounts are equal, opposite or other."""
    g = df.groupBy(*document).agg(F.count("*").alias("n"), F.min(amount).alias("lo"), F.max(amount).alias("hi")).filter("n = 2")
    kind = F.when(F.abs(F.col("lo") - F.col("hi")) <= 0.005, "equal").when(F.abs(F.col("lo") + F.col("hi")) <= 0.005, "opposite").otherwise("other")
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_documents"))
