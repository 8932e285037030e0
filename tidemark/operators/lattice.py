"""What a table's columns are, its key, its near key and what determines what, found without being told where to look.

Column facts come from one histogram. Sets of columns are taken level by level: a sketch of each set's distinct
values, all sets of a level in one pass without a shuffle, rules out those that can't come close; what is
left is counted exactly, and only rows that share their values in every smaller set are counted again.
"""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key
from tidemark.functions.scratch import staged
from tidemark.operators.profile import histogram
from tidemark.operators.roles import AMOUNT_WORDS, CODE_WORDS, _names

# Words of a header that says when a row was written.
AUDIT_WORDS = ["created", "entered", "exported", "imported", "loaded", "modified", "submitted", "synced", "timestamp", "updated", "uploaded"]
KEY_SHARE, NEAR_SHARE, DEP_SHARE = 0.99, 0.15, 0.01
KEY_COLUMNS, NEAR_COLUMNS, LEFT, RIGHT = 6, 8, 8, 14  # candidates, those of the most values
RSD = 0.02  # of the sketches; five of them are allowed for
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _type(kind: str) -> str:
    return "number" if kind in _NUMBERS or kind.startswith("decimal") else "date" if kind == "date" or kind.startswith("timestamp") else "bool" if kind == "boolean" else "text"


def column_semantics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, type, semantic, audit, codes, n_filled, n_distinct``: what each column is, from one histogram.

    temporal: dates, and whole numbers from 1990 to 2100 of at most 60 values; flag: booleans; identifier: integer
    codes, whole numbers that aren't negative and texts of 30 characters or less under a header of an id, and texts of
    24 or less of which 90 % differ; metric: other numbers; dimension: short texts, or of at most 60 values or a
    twentieth of the rows; text: the rest, and columns without values. ``audit``: says when a row was written, by its
    header or by a time of day on half its rows.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    types = F.create_map(*(F.lit(x) for c in columns for x in (c, _type(kinds[c]))))
    # timestamps whole, so a time of day shows
    hist = histogram(df, columns, {c: lambda v: F.date_format(v, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns if kinds[c].startswith("timestamp")})
    whole, number = F.col("k").rlike(r"^-?[0-9]+(\.0)?(E[0-9]+)?$"), F.expr("try_cast(k as double)")
    upper = F.col("k").rlike("[0-9]") | (F.length("k") <= 3)
    per = hist.groupBy("column").agg(F.sum("n").alias("n_filled"), F.count("*").alias("n_distinct"), F.min(whole).alias("whole"), F.min(number).alias("low"), F.max(number).alias("high"),
                                     (F.sum(F.length("k") * F.col("n")) / F.sum("n")).alias("width"), F.min(F.length("k")).alias("narrow"), F.max(F.length("k")).alias("wide"),
                                     (F.sum(F.when((F.length("k") > 10) & ~F.col("k").endswith(" 00:00:00.000000"), F.col("n")).otherwise(0)) / F.sum("n")).alias("timed"), F.avg(upper.cast("double")).alias("upper"))
    every = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, place int")
    per = every.join(per, "column", "left").crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows")))).withColumn("type", types[F.col("column")])  # one row
    name, t = F.col("column"), F.col("type")
    code, amount = _names(name, CODE_WORDS), _names(name, AMOUNT_WORDS)
    few = F.col("n_distinct").between(2, 30) & (F.col("n_filled") >= 10 * F.col("n_distinct"))
    codes = F.coalesce(F.when(t == "number", F.col("whole") & (F.col("low") >= 0) & few & (code | ((F.col("narrow") == F.col("wide")) & (F.col("narrow") >= 3) & ~amount)))
                       .when(t == "text", F.col("n_distinct").between(2, 60) & (F.col("width") <= 6) & (F.col("upper") >= 0.6)), F.lit(False))
    year = F.col("whole") & (F.col("low") >= 1990) & (F.col("high") <= 2100) & (F.col("n_distinct") <= 60)
    plain = F.when(F.col("n_filled").isNull(), "text").when(t == "date", "temporal").when(t == "bool", "flag")
    semantic = plain.when((t == "number") & year, "temporal").when((t == "number") & (codes | (F.col("whole") & code & (F.col("low") >= 0))), "identifier").when(t == "number", "metric")
    semantic = semantic.when(code & (F.col("width") <= 30), "identifier").when((F.col("n_distinct") >= 0.9 * F.col("n_filled")) & (F.col("n_filled") >= 20) & (F.col("width") <= 24), "identifier")
    semantic = semantic.when(F.col("width") > 40, "text").when(F.col("n_distinct") <= F.greatest(F.lit(60.0), F.floor(0.05 * F.col("n_rows"))), "dimension").when(F.col("width") > 24, "text").otherwise("dimension")
    audit = F.lower(name).rlike(f"^(date_?|time_?)?({'|'.join(AUDIT_WORDS)})(_?(at|on|date|time|timestamp|ts))?$") | ((t == "date") & F.coalesce((F.col("timed") >= 0.5) & (F.col("n_filled") >= 5), F.lit(False)))
    zero = F.lit(0).cast("long")
    return per.select("column", "place", "type", semantic.alias("semantic"), audit.alias("audit"), codes.alias("codes"), F.coalesce("n_filled", zero).alias("n_filled"), F.coalesce("n_distinct", zero).alias("n_distinct"), "n_rows",
                      F.coalesce((t == "number") & F.col("whole") & (F.col("n_distinct") >= 0.9 * F.col("n_filled")) & ~amount, F.lit(False)).alias("documents"))


def date_axis(facts: DataFrame) -> DataFrame:
    """The first date column that doesn't say when a row was written; none if there is none."""
    return facts.filter("type = 'date' and not audit and n_filled > 0").orderBy("place").limit(1).select("column")


def _key_of(df: DataFrame, columns) -> tuple[Column, Column]:
    kinds = dict(df.dtypes)
    keys = [norm_key(F.col(c), kinds[c]) for c in columns]
    return F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)


def _extras(df: DataFrame, sets: list[tuple], n: int, most: float) -> dict[tuple, tuple[int, int]]:
    """Rows over one a key of each set, and its keys of more than one row; sets that a sketch shows to have more than ``most`` are left out.

    Sketches of all sets share a pass; each set left is counted on its own, by its values as they are, but for texts, which two hashes stand for."""
    if not sets:
        return {}
    sketch = df.agg(*(F.approx_count_distinct(F.struct(*_key_of(df, s)), RSD).alias(f"s{i}") for i, s in enumerate(sets))).first()
    left, out, kinds = [s for i, s in enumerate(sets) if n - sketch[f"s{i}"] * (1 + 5 * RSD) <= most], {}, dict(df.dtypes)
    for s in left:
        keys = _key_of(df, s) if any(_type(kinds[c]) == "text" for c in s) else [norm_key(F.col(c), kinds[c]) for c in s]
        counts = df.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("n"))
        r = counts.agg(F.count("*").alias("d"), F.count_if(F.col("n") > 1).alias("groups")).first()
        if n - r["d"] <= most:
            out[s] = n - r["d"], r["groups"]
    return out


def _repeating(df: DataFrame, column: str) -> DataFrame:
    """Rows that share their value of a column with another one: no others can share a set that holds it."""
    a, b = _key_of(df, [column])
    keyed = df.withColumns({"_a": a, "_b": b})
    repeated = keyed.groupBy("_a", "_b").agg(F.count("*").alias("_n")).filter("_n > 1").select("_a", "_b")
    return keyed.join(repeated, ["_a", "_b"], "left_semi").drop("_a", "_b")


def table_key(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns, extra``: the smallest set of one to three columns that is a key (extra 0), or nearly one (``KEY_SHARE``).

    A single column comes first if it is unique and no amount, ids before others; then an id of which 99 % of rows have
    a value of their own; then sets of two and three of the six columns without blanks of the most values. Amounts and
    columns that say when a row was written are never part. None if nothing comes close, or of a table of one column.
    """
    spark, columns = df.sparkSession, columns or df.columns
    facts = [r for r in column_semantics(df, columns).orderBy("place").collect() if not r["audit"]]  # a row a column
    n = facts[0]["n_rows"] if facts else 0
    none = spark.createDataFrame([], "columns string, extra long")
    if len(columns) < 2 or not n:
        return none
    full = [r for r in facts if r["n_filled"] == n]
    unique = [r for r in full if r["n_distinct"] == n and r["semantic"] != "metric" and r["type"] != "bool"]
    if unique:
        return spark.createDataFrame([(min(unique, key=lambda r: (r["semantic"] != "identifier", r["place"]))["column"], 0)], "columns string, extra long")
    most = int((1 - KEY_SHARE) * n + 1e-9)
    near = [r for r in full if n - r["n_distinct"] <= most and r["type"] in ("text", "number") and (r["semantic"] == "identifier" or r["documents"])]
    if near:
        best = max(near, key=lambda r: (r["semantic"] == "identifier", r["n_distinct"], -r["place"]))
        return spark.createDataFrame([(best["column"], n - best["n_distinct"])], "columns string, extra long")
    able = sorted((r for r in full if r["semantic"] != "metric" and r["type"] != "bool" and r["n_distinct"] >= 2), key=lambda r: (-r["n_distinct"], r["place"]))[:KEY_COLUMNS]
    found = _level(df, able, n, most, (2, 3))
    return spark.createDataFrame([(",".join(found[0]), found[1][0])], "columns string, extra long") if found else none


def _level(df: DataFrame, able: list, n: int, most: float, sizes: tuple) -> tuple[tuple, tuple[int, int]] | None:
    """The set of the fewest rows over one a key, with those and its keys of more than one row, at the first size that has one of at most ``most``; ties go to the earlier columns."""
    names, distinct = [r["column"] for r in able], {r["column"]: r["n_distinct"] for r in able}
    for size in sizes:
        sets = [s for s in combinations(names, size) if prod(distinct[c] for c in s) >= n - most]
        extras = _extras(df, sets, n, most)
        if extras:
            best = min(extras, key=lambda s: (extras[s][0], [names.index(c) for c in s]))
            return best, extras[best]
    return None


def near_key(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns, extra, groups``: the fewest columns that are one a row but for at most 15 % of rows over one a key.

    None in a table of under 20 rows, one that has a unique column, or one where the set found is a key. Candidates
    are the eight columns without blanks of the most values, no amounts (but document numbers) and none that says when a
    row was written: 92 sets. ``groups`` counts the keys of more than one row; see :func:`repeated_groups`.
    """
    spark, columns = df.sparkSession, columns or df.columns
    facts = [r for r in column_semantics(df, columns).orderBy("place").collect() if not r["audit"]]
    n = facts[0]["n_rows"] if facts else 0
    none = spark.createDataFrame([], "columns string, extra long, groups long")
    if n < 20 or len(columns) < 2 or any(r["n_distinct"] == n and r["n_filled"] == n and r["semantic"] != "metric" and r["type"] != "bool" for r in facts):
        return none
    able = sorted((r for r in facts if r["n_filled"] == n and r["n_distinct"] >= 2 and r["type"] != "bool" and (r["semantic"] != "metric" or r["documents"])), key=lambda r: (-r["n_distinct"], r["place"]))[:NEAR_COLUMNS]
    single = [r for r in able if n - r["n_distinct"] <= NEAR_SHARE * n]
    if single:
        name, extra = single[0]["column"], n - single[0]["n_distinct"]
        return spark.createDataFrame([(name, extra, repeated_groups(df, [name]).count())], "columns string, extra long, groups long") if extra else none
    found = _level(df, able, n, NEAR_SHARE * n, (2, 3))
    if not found or not found[1][0]:
        return none
    return spark.createDataFrame([(",".join(found[0]), *found[1])], "columns string, extra long, groups long")


def repeated_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys of more than one row with their rows. Rows that stand alone in the column of the most values are left out first."""
    kinds = dict(df.dtypes)
    rows = _repeating(df.select(*columns), columns[0])
    return rows.groupBy(*(norm_key(F.col(c), kinds[c]).alias(c) for c in columns)).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def dependencies(df: DataFrame, columns: list[str] | None = None, most_values: int = 100_000) -> DataFrame:
    """``from, to, exceptions, groups``: columns of which a value goes with one value of another, but for 1 % of the values.

    From: ids and dimensions that repeat, of 2 to ``most_values`` values, the eight of the most; to: the first fourteen
    texts, dimensions and ids written as text, of fewer values than there are groups. Rows without one of the two don't
    count. All pairs share one shuffle: for each value the least and the greatest hash of every other column.
    """
    kinds, columns = dict(df.dtypes), columns or df.columns
    facts = column_semantics(df, columns).orderBy("place").collect()
    left = sorted((r for r in facts if r["semantic"] in ("identifier", "dimension") and 2 <= r["n_distinct"] <= most_values and not (r["n_distinct"] == r["n_filled"] == r["n_rows"])), key=lambda r: (-r["n_distinct"], r["place"]))[:LEFT]
    right = [r for r in facts if r["type"] == "text" and r["semantic"] in ("dimension", "text", "identifier") and r["n_distinct"] >= 2][:RIGHT]
    pairs = [(a["column"], b["column"], b["n_distinct"]) for a in left for b in right if a["column"] != b["column"] and b["n_distinct"] <= a["n_distinct"]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "from string, to string, exceptions long, groups long")
    key = {c: norm_key(F.col(c), kinds[c]) for p in pairs for c in p[:2]}
    to = list(dict.fromkeys(b for _, b, _ in pairs))
    at = {c: F.col(f"_{i}") for i, c in enumerate(key)}  # each key is worked out once a row
    hashed = [F.when(at[b].isNotNull(), F.xxhash64(at[b])).alias(f"t{i}") for i, b in enumerate(to)]
    sides = F.array(*(F.struct(F.lit(a).alias("from"), F.when(at[a].isNotNull(), F.xxhash64(at[a])).alias("k")) for a in dict.fromkeys(a for a, _, _ in pairs)))
    rows = df.select(*(k.alias(f"_{i}") for i, k in enumerate(key.values()))).select(*hashed, F.inline(sides)).filter("k is not null")
    per = rows.groupBy("from", "k").agg(*(f(f"t{i}").alias(f"{x}{i}") for i in range(len(to)) for f, x in ((F.min, "lo"), (F.max, "hi"))))
    facts = per.groupBy("from").agg(*(x for i in range(len(to)) for x in (F.count(f"lo{i}").alias(f"g{i}"), F.count_if(F.col(f"lo{i}") < F.col(f"hi{i}")).alias(f"x{i}"))))
    tall = facts.select("from", F.inline(F.array(*(F.struct(F.lit(b).alias("to"), F.col(f"x{i}").alias("exceptions"), F.col(f"g{i}").alias("groups")) for i, b in enumerate(to)))))
    asked = df.sparkSession.createDataFrame(pairs, "from string, to string, d long")
    out = tall.join(F.broadcast(asked), ["from", "to"]).filter(f"groups > 0 and exceptions <= {DEP_SHARE} * groups and groups > d")
    return staged(out.select("from", "to", "exceptions", "groups"), "dependencies")
