"""What columns are for: codes, document numbers, groupings, money; and the key that a table has.

All roles come from one histogram (column, value, count) or one aggregation, so a table is read once
however many columns it has; only rows of a column each reach the driver where a choice is made there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key
from tidemark.operators.profile import histogram

# Words of a header that name an amount or a count, and those that name a code.
AMOUNT_WORDS = ["amount", "balance", "cost", "count", "discount", "price", "qty", "quantity", "rate", "size", "tax", "total"]
RATE_WORDS = ["count", "discount", "qty", "quantity", "rate", "size", "tax"]
CODE_WORDS = ["code", "id", "key", "no", "number"]

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")

def _names(header: Column, words: list[str]) -> Column:
    """Whether the header ends with one of the words; one of two letters must stand alone."""
    return F.lower(header).rlike("|".join((r"(^|[^a-z])" if len(w) < 3 else "") + w + "$" for w in words))


def column_roles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: filled rows, distinct values, and whether it groups (2 to 30 values on 10 rows each or more),
    holds integer codes (so many whole numbers that aren't negative under a header of a code, or all of one width
    of 3 digits or more under one that names no amount), or document numbers (whole numbers, 90 % of them
    different, under a header that names no amount). A column without values has no role."""
    kinds = dict(df.dtypes)
    number = F.col("column").isin([c for c in columns if kinds[c] in _NUMBERS])
    whole = F.col("k").rlike(r"^-?[0-9]+(\.0)?$")
    per = histogram(df, columns).groupBy("column").agg(
        F.sum("n").alias("n_filled"), F.count("*").alias("n_distinct"), (F.min(whole) & F.max(number)).alias("whole"), F.max(F.col("k").startswith("-")).alias("minus"),
        F.min(F.length("k")).alias("narrow"), F.max(F.length("k")).alias("wide"), F.max(number).alias("number"))
    name, few = F.col("column"), F.col("n_distinct").between(2, 30) & (F.col("n_filled") >= 10 * F.col("n_distinct"))
    amount = _names(name, AMOUNT_WORDS)
    fixed = (F.col("narrow") == F.col("wide")) & (F.col("narrow") >= 3) & ~amount
    codes = few & F.col("whole") & ~F.col("minus") & (_names(name, CODE_WORDS) | fixed)
    ids = F.col("whole") & (F.col("n_distinct") >= 0.9 * F.col("n_filled")) & ~amount
    return per.select("column", "n_filled", "n_distinct", (few & (~F.col("number") | codes)).alias("groups"), codes.alias("codes"), ids.alias("document_numbers"))


def money_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """The column that money is added up from, one row or none: of the numeric columns whose header names no code,
    rate or count, those with cents come first, then that whose sum is the largest, whichever its sign, then the first name."""
    kinds = dict(df.dtypes)
    held = [c for c in columns if kinds[c] in _NUMBERS or kinds[c].startswith("decimal")]
    sums = [F.struct(F.lit(c).alias("column"), F.max(F.col(c).cast("double") % 1 != 0).alias("cents"), F.round(F.abs(F.sum(F.col(c).cast("double"))), 2).alias("total")) for c in held]
    none = "array<struct<column:string,cents:boolean,total:double>>"
    rows = df.agg(F.array(*sums).cast(none).alias("x")).select(F.inline("x"))
    fits = ~_names(F.col("column"), CODE_WORDS) & ~_names(F.col("column"), RATE_WORDS) & F.col("total").isNotNull()
    return rows.filter(fits).orderBy(F.desc("cents"), F.desc("total"), "column").limit(1).select("column", "total")


def conformity_runs(lines: DataFrame, group: str, day: str, price: str, reference: str, least_months: int = 3, least_lines: int = 10) -> DataFrame:
    """Groups whose prices follow the reference from some month on: ``group, since, n_months, n_lines, n_at``.

    A line is at the reference within half a cent. The run starts at the earliest month with half its lines at it
    from which nine tenths of all lines to the end are. It needs three months and ten lines. Lines without a group,
    day, reference or a price above zero don't count.
    """
    at = (F.abs(F.col(price) - F.col(reference)) <= 0.005).cast("long")
    months = lines.select(norm_key(F.col(group), dict(lines.dtypes)[group]).alias("g"), F.date_format(day, "yyyy-MM").alias("m"), at.alias("at"), F.col(price).alias("p"))
    months = months.filter("g is not null and m is not null and at is not null and p > 0").groupBy("g", "m").agg(F.count("*").alias("n"), F.sum("at").alias("at"))
    rest = Window.partitionBy("g").orderBy(F.desc("m"))  # a group has as many rows as months
    after = months.withColumns({"n_lines": F.sum("n").over(rest), "n_at": F.sum("at").over(rest), "n_months": F.count("*").over(rest)})
    starts = after.filter("2 * at >= n and 10 * n_at >= 9 * n_lines")
    first = starts.groupBy("g").agg(F.min(F.struct("m", "n_months", "n_lines", "n_at")).alias("x"))
    out = first.select(F.col("g").alias("group"), F.col("x.m").alias("since"), "x.n_months", "x.n_lines", "x.n_at")
    return out.filter((F.col("n_months") >= least_months) & (F.col("n_lines") >= least_lines))
