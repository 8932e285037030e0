"""What changed since a table was last seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import staged
from tidemark.operators.profile import distinct_counts


def value_changes(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Values that are new and values that are gone, counted by kind."""
    a, b = old.select(F.col(column).alias("v")).distinct(), new.select(F.col(column).alias("v")).distinct()
    gone = a.join(b, "v", "left_anti").select(F.lit("gone").alias("kind"))
    fresh = b.join(a, "v", "left_anti").select(F.lit("new").alias("kind"))
    return gone.union(fresh).groupBy("kind").agg(F.count("*").alias("n_values"))


def column_fingerprints(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column a sum of value hashes: the same for the same bag of values in any order and partitioning."""
    def summed(c):
        h = F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))), 1, 12), 16, 10).cast("decimal(38,0)")
        return F.sum(h).cast("string")

    one = df.agg(F.count("*").alias("_n"), *(summed(c).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(c).alias("fingerprint")) for c in columns))))


def schema_changes(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    """Added, removed and retyped columns, from the schemas alone."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    return {"added": sorted(set(b) - set(a)), "removed": sorted(set(a) - set(b)), "retyped": sorted(c for c in a if c in b and a[c] != b[c])}


FEW, OVERLAP = 60, 0.9  # values that a column may have to be compared value by value, and the share that a rename keeps
_TYPES = {"tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "float": "number", "double": "number", "boolean": "bool", "date": "date", "string": "text"}


def _type(kind: str) -> str:
    return "number" if kind.startswith("decimal") else "date" if kind.startswith("timestamp") else _TYPES.get(kind, kind)


def _few_valued(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that may have at most ``FEW`` values. A sketch leaves out the others: so few values never make it say twice as many, as each sets
    one of its hundreds of registers at most."""
    if not columns:
        return []
    r = df.agg(*(F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if r[f"c{i}"] <= 2 * FEW]


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, v``: the different values of columns, written as text. They are brought to one row each before they are written."""
    kinds = dict(df.dtypes)
    raw = {c: F.col(c).cast("string") if kinds[c] in ("float", "double") else F.col(c) for c in columns}  # 0.0 and -0.0 are two texts
    parts = [df.filter(F.col(c).isNotNull()).groupBy(raw[c].alias("v")).agg(F.count("*").alias("_n")).select(F.lit(c).alias("column"), F.col("v").cast("string").alias("v")) for c in columns]
    return reduce(DataFrame.union, parts).distinct() if parts else df.sparkSession.createDataFrame([], "column string, v string")


def renamed_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """``from, to, shared``: columns that are gone, each with the first new column of its type and shape, which no other takes.

    The shape is the same if nine tenths of the old values (written as text) are among the new ones, where both have at most 60; else if
    the numbers of different values differ by a tenth of the new at most, or by two. ``shared`` counts the values of both. Columns
    without values are no candidates; columns are taken in their order, which settles ties."""
    spark = old.sparkSession
    gone, fresh = [c for c in old.columns if c not in new.columns], [c for c in new.columns if c not in old.columns]
    none = spark.createDataFrame([], "`from` string, `to` string, shared long")
    if not gone or not fresh:
        return none
    n, sides = {}, []
    for df, columns, side in ((old, gone, "old"), (new, fresh, "new")):
        few = _few_valued(df, columns)
        many = [c for c in columns if c not in few]
        if many:  # only counted
            n |= {(side, r["name"]): r["n_distinct"] for r in distinct_counts(df, {c: [F.col(c).cast("string")] for c in many}).collect()}
        sides.append(_texts(df, few).withColumn("side", F.lit(side)))
    values = staged(sides[0].union(sides[1]), "values")
    n |= {(r["side"], r["column"]): r["n"] for r in values.groupBy("side", "column").agg(F.count("*").alias("n")).collect()}  # a row a column
    small = values.join(F.broadcast(values.groupBy("side", "column").agg(F.count("*").alias("n")).filter(f"n <= {FEW}").select("side", "column")), ["side", "column"], "left_semi")  # a row a column
    both = small.filter("side = 'old'").select(F.col("column").alias("a"), "v").join(small.filter("side = 'new'").select(F.col("column").alias("b"), "v"), "v").groupBy("a", "b").agg(F.count("*").alias("n")).collect()
    shared = {(r["a"], r["b"]): r["n"] for r in both}
    kinds, out = (dict(old.dtypes), dict(new.dtypes)), []
    for a in gone:
        for b in [b for b in fresh if b not in {x[1] for x in out}]:
            x, y = n.get(("old", a), 0), n.get(("new", b), 0)
            if not x or not y or _type(kinds[0][a]) != _type(kinds[1][b]):
                continue
            same = shared.get((a, b), 0) >= OVERLAP * x if x <= FEW and y <= FEW else abs(x - y) <= max(2, 0.1 * y)
            if same:
                out.append((a, b, shared.get((a, b), 0)))
                break
    return spark.createDataFrame(out, none.schema)


def freshness(old: DataFrame, new: DataFrame, shown: int = 5) -> DataFrame:
    """``kind, column, detail, n``: all that changed since a table was last seen, as one report; no row if nothing did.

    rows: by how many there are more (or fewer); added, removed, renamed (``detail``: the new name) and retyped columns; new and gone: values
    of columns with at most 60 (``detail``: up to ``shown`` of them, sorted); changed: columns with other values, told by their
    fingerprints; moved: the same columns and values in another order of columns. A renamed column's values are compared under its new name.
    """
    spark = old.sparkSession
    names = {r["from"]: r["to"] for r in renamed_columns(old, new).collect()}
    was = old.select(*(F.col(c).alias(names.get(c, c)) for c in old.columns))
    both = [c for c in was.columns if c in new.columns]
    prints = [{r["column"]: (r["n_rows"], r["fingerprint"]) for r in column_fingerprints(d, both).collect()} if both else {} for d in (was, new)]
    rows = [d.count() for d in (was, new)]
    kinds = [dict(d.dtypes) for d in (was, new)]
    changed = [c for c in both if prints[0][c] != prints[1][c]]
    out = [("rows", None, None, rows[1] - rows[0])] if rows[0] != rows[1] else []
    out += [("added", c, None, None) for c in new.columns if c not in was.columns] + [("removed", c, None, None) for c in was.columns if c not in new.columns]
    out += [("renamed", a, b, None) for a, b in names.items()] + [("retyped", c, f"{kinds[0][c]} to {kinds[1][c]}", None) for c in both if kinds[0][c] != kinds[1][c]]
    out += [("changed", c, None, None) for c in changed]
    if not out and list(old.columns) != list(new.columns):
        out.append(("moved", None, None, None))
    report = spark.createDataFrame(out, "kind string, column string, detail string, n long")
    if not changed:
        return report
    asked = _few_valued(was, changed)
    asked = _few_valued(new, asked)
    if not asked:
        return report
    tall = [_texts(d, asked) for d in (was, new)]
    values = tall[0].withColumn("w", F.lit(1)).union(tall[1].withColumn("w", F.lit(2))).groupBy("column", "v").agg(F.sum("w").alias("w"))
    values = staged(values, "values")
    few = values.groupBy("column").agg(F.count_if(F.expr("w % 2 = 1")).alias("x"), F.count_if(F.expr("w >= 2")).alias("y")).filter(f"x between 1 and {FEW} and y between 1 and {FEW}").select("column")
    lists = values.filter("w < 3").join(F.broadcast(few), "column").groupBy("column", "w").agg(F.array_sort(F.collect_list("v")).alias("v"))  # at most 60 a column
    return report.union(lists.select(F.when(F.col("w") == 2, "new").otherwise("gone"), "column", F.array_join(F.slice("v", 1, shown), ", "), F.size("v").cast("long")))


def aged_notes(notes: DataFrame, on: str) -> DataFrame:
    """Notes (columns ``as_of, stale_after``) that are to be looked at again on a day: ``+30d`` counts from ``as_of`` (the day itself
    if it is null), a date stands for itself; null, blank, ``on-change`` and what can't be read never age."""
    rule, today = F.trim("stale_after"), F.lit(on).cast("date")
    days = F.expr("try_cast(regexp_extract(trim(stale_after), '^[+]([0-9]+)d$', 1) as int)")
    base = F.coalesce(F.expr("try_cast(substring(as_of, 1, 10) as date)"), today)
    end = F.when(rule.rlike(r"^\+[0-9]+d$"), F.date_add(base, days)).when(rule.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.expr("try_cast(substring(trim(stale_after), 1, 10) as date)"))
    return notes.filter(F.coalesce(today > end, F.lit(False)))
