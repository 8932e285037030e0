"""Which columns of which tables are one thing: joins with their direction and how sure they are, references, codes written as names.

All columns of all tables become one histogram (table, column, value, rows), which is joined with itself on the
value; a value meets as many rows as columns hold it, so hot values cost nothing. Everything after that is a row a pair of columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key
from tidemark.functions.scratch import staged
from tidemark.operators.lattice import column_semantics, date_axis

# Words of headers that stand for another word, and words that say nothing.
SYNONYMS = {
    "sku": "item", "product": "item", "item number": "item", "item no": "item", "item #": "item", "item code": "item", "product code": "item", "supplier": "vendor", "distributor": "vendor", "e-mail": "email",
    "email address": "email", "contact email": "email", "customer": "client", "acct": "account", "gl": "account", "store": "location", "site": "location", "property": "location",
}
EMPTY_WORDS = {"the", "of", "name", "no", "number", "#", "id", "code"}
SHARED, LEAST, SURE = 3, 0.2, 0.5  # values, and shares of them, that two columns have in common
ALIKE, SAME = 0.3, 0.8  # likeness of headers
AUTO, MOSTLY = 0.95, 0.6  # rows that find a partner
REFERENCE_ROWS = 50  # lines of a table that looks things up
_FOUND = "from_table string, from_column string, to_table string, to_column string, n_shared long, values_matched double, rows_matched double, to_unique boolean, header_similarity double, band string"


def header_words(header: str) -> set[str]:
    """The words of a header, camel case apart, with synonyms as one and empty words left out if others remain."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", header).lower().strip()
    words = {SYNONYMS.get(w, w) for w in re.findall(r"[a-z0-9]+|#", SYNONYMS.get(text, text))}
    return words - EMPTY_WORDS or words


def header_similarity(a: str, b: str) -> float:
    """Shared words by all words of two headers; equal headers, or equal words, are 1."""
    x, y = header_words(a), header_words(b)
    if not x or not y:
        return 0.0
    return 1.0 if a.strip().lower() == b.strip().lower() or x == y else len(x & y) / len(x | y)


def key_text(c: Column, kind: str) -> Column:
    """A value as the text under which it is compared across tables: whole numbers alike whatever their type, dates as days."""
    k = norm_key(c, kind)
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.when(k == F.floor(k), k.cast("decimal(38,0)").cast("string")).otherwise(k.cast("string"))
    return k.cast("string")


def value_histogram(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """``table, column, k, n`` of the named columns, a row a value."""
    out = None
    for name, df in tables.items():
        if columns.get(name):
            kinds = dict(df.dtypes)
            tall = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), key_text(F.col(c), kinds[c]).alias("k")) for c in columns[name])))).filter("k is not null")
            one = tall.groupBy("column", "k").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "column", "k", "n")
            out = one if out is None else out.union(one)
    return out


def table_facts(tables: dict[str, DataFrame]) -> dict[str, list]:
    """What the columns of each table are: a row a column, by table."""
    return {name: column_semantics(df).orderBy("place").collect() for name, df in tables.items()}


def discover_joins(tables: dict[str, DataFrame], facts: dict[str, list] | None = None) -> DataFrame:
    """``from_table, from_column, to_table, to_column, n_shared, values_matched, rows_matched, to_unique, header_similarity, band``.

    Columns may join if they have three values or more and are ids, or short texts that group; a number joins a text only
    if both are ids. They share three values and a fifth of one side's, half if their headers are unlike. A join leads
    to the unique side if one is and it covers three fifths of the other's rows (or both sides' values nearly agree), else from
    the side of which more values are found. auto: 95 % of rows find a partner, and the header, uniqueness or
    nearly all values speak for it; or the headers are the same, the other side is unique and 60 % do. ask: 20 % do; others are
    left out. Null and blank values don't count.
    """
    spark = next(iter(tables.values())).sparkSession
    facts = facts or table_facts(tables)
    able = {(t, r["column"]): r for t, rows in facts.items() for r in rows
            if r["n_distinct"] >= SHARED and (r["semantic"] == "identifier" if r["type"] == "number" else r["type"] == "text" and r["semantic"] in ("identifier", "dimension"))}
    columns = {t: [c for u, c in able if u == t] for t in tables}
    hist = value_histogram(tables, columns)
    if hist is None or sum(map(bool, columns.values())) < 2:
        return spark.createDataFrame([], _FOUND)
    hist = staged(hist, "values")
    sizes = {(r["table"], r["column"]): (r["d"], r["n"]) for r in hist.groupBy("table", "column").agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()}
    place = {key: i for i, key in enumerate(able)}
    number = F.create_map(*(F.lit(x) for (t, c), i in place.items() for x in (f"{t}\x00{c}", i)))
    h = hist.select(number[F.concat_ws("\x00", "table", "column")].alias("i"), "table", "k", "n")
    x, y = h.select(F.col("i").alias("a"), F.col("table").alias("ta"), "k", F.col("n").alias("na")), h.select(F.col("i").alias("b"), F.col("table").alias("tb"), "k", F.col("n").alias("nb"))
    met = x.join(y, "k").filter("a < b and ta <> tb").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("na").alias("ra"), F.sum("nb").alias("rb")).filter(f"shared >= {SHARED}").collect()  # columns squared at most
    keys, out = list(able), []
    for m in met:
        one = _oriented(keys[m["a"]], keys[m["b"]], able, sizes, m["shared"], m["ra"], m["rb"])
        if one:
            out.append(one)
    return spark.createDataFrame(out, _FOUND)


def _oriented(a: tuple, b: tuple, able: dict, sizes: dict, shared: int, rows_a: int, rows_b: int) -> tuple | None:
    fa, fb = able[a], able[b]
    if (fa["type"] == "number") != (fb["type"] == "number") and not fa["semantic"] == fb["semantic"] == "identifier":
        return None
    (da, na), (db, nb) = sizes[a], sizes[b]
    in_b, in_a, like = shared / da, shared / db, header_similarity(a[1], b[1])
    best = max(in_b, in_a)
    if best < LEAST or (like < ALIKE and best < SURE):
        return None
    unique_a, unique_b = da == na == fa["n_rows"], db == nb == fb["n_rows"]
    first = in_b >= in_a
    if unique_a != unique_b and ((rows_a / na if unique_b else rows_b / nb) >= MOSTLY or (in_b >= 0.8 and in_a >= 0.8)):
        first = unique_b
    src, dst, covered, contained, unique = (a, b, rows_a / na, in_b, unique_b) if first else (b, a, rows_b / nb, in_a, unique_a)
    if (covered >= AUTO and (like >= ALIKE or unique or contained >= 0.98)) or (like >= SAME and unique and covered >= MOSTLY):
        band = "auto"
    elif covered >= LEAST:
        band = "ask"
    else:
        return None
    return (*src, *dst, shared, round(contained, 4), round(covered, 4), unique, round(like, 2), band)


def reference_links(tables: dict[str, DataFrame], joins: DataFrame, facts: dict[str, list] | None = None) -> DataFrame:
    """``lines, reference, line_key, reference_key``: sure joins whose larger side is a dated table of 50 lines or more, that with the most rows matched for each pair of tables."""
    facts = facts or table_facts(tables)
    sizes = {t: rows[0]["n_rows"] for t, rows in facts.items()}
    dated = {t for t, df in tables.items() if not date_axis(column_semantics(df)).isEmpty()}
    ids = {(t, r["column"]) for t, rows in facts.items() for r in rows if r["semantic"] == "identifier"}
    found = joins.filter("band = 'auto'").collect()  # a row a pair of columns
    out, seen = [], set()
    for j in sorted(found, key=lambda j: (not {(j["from_table"], j["from_column"]), (j["to_table"], j["to_column"])} <= ids, -j["rows_matched"], j["from_column"], j["to_column"])):
        a, b = (j["from_table"], j["from_column"]), (j["to_table"], j["to_column"])
        if sizes[a[0]] < sizes[b[0]]:
            a, b = b, a
        if a[0] in dated and sizes[a[0]] >= REFERENCE_ROWS and (a[0], b[0]) not in seen:
            seen.add((a[0], b[0]))
            out.append((a[0], b[0], a[1], b[1]))
    return joins.sparkSession.createDataFrame(out, "lines string, reference string, line_key string, reference_key string")


def code_or_name(df: DataFrame, column: str, lookup: DataFrame, code: str, name: str, covered: float = AUTO, least: float = 0.02) -> DataFrame:
    """``n_rows, n_codes, n_names, n_other, mixed``: whether a column holds a lookup's codes on some rows and its names on others.

    Mixed if 95 % of its filled rows are one or the other and each is on three rows and 2 % of them; a value that is both counts
    as a code. Values are compared by the common equality; repeated or blank codes and names of the lookup count once or not at all."""
    kinds, own = dict(lookup.dtypes), dict(df.dtypes)[column]
    code_keys = lookup.select(key_text(F.col(code), kinds[code]).alias("k"), F.lit(0).alias("what"))
    name_keys = lookup.select(key_text(F.col(name), kinds[name]).alias("k"), F.lit(1).alias("what"))
    keys = code_keys.union(name_keys).filter("k is not null").groupBy("k").agg(F.min("what").alias("what"))
    rows = df.select(key_text(F.col(column), own).alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).join(keys, "k", "left")
    part = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0))
    g = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), part(0).alias("n_codes"), part(1).alias("n_names"))
    floor = F.greatest(F.lit(3.0), least * F.col("n_rows"))
    mixed = (F.col("n_codes") + F.col("n_names") >= covered * F.col("n_rows")) & (F.col("n_codes") >= floor) & (F.col("n_names") >= floor)
    return g.select("n_rows", "n_codes", "n_names", (F.col("n_rows") - F.col("n_codes") - F.col("n_names")).alias("n_other"), mixed.alias("mixed"))


def as_codes(df: DataFrame, column: str, lookup: DataFrame, code: str, name: str) -> DataFrame:
    """``df`` with names in ``column`` written as the lookup's codes; of several codes of a name the least stands for it; other values stay."""
    kinds, own = dict(lookup.dtypes), dict(df.dtypes)[column]
    names = lookup.select(key_text(F.col(name), kinds[name]).alias("_k"), F.col(code).cast("string").alias("_code")).filter("_k is not null and _code is not null").groupBy("_k").agg(F.min("_code").alias("_code"))
    codes = lookup.select(key_text(F.col(code), kinds[code]).alias("_k")).filter("_k is not null").distinct()
    names = names.join(codes, "_k", "left_anti")
    out = df.withColumn("_own", key_text(F.col(column), own)).join(names, F.col("_own") == F.col("_k"), "left")
    return out.withColumn(column, F.coalesce("_code", F.col(column).cast("string"))).select(*df.columns)
