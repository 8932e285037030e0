"""Queries of what a table's columns are, its keys and dependencies, its total rows and sets of rows, each with its SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fresh, lattice, ranges, relations, rowsets, totals
from tidemark.operators.roles import AMOUNT_WORDS, CODE_WORDS
from tidemark.plans.catalogue import query


def _ends(name, words):
    """Whether a header ends with one of the words, those of two letters standing alone."""
    return any(name.endswith(w) and (len(w) > 2 or not name[: -len(w)][-1:].isalpha()) for w in words)


def _semantics_sql(table, columns):
    parts = []
    for name, kind in columns.items():
        code, amount = _ends(name, CODE_WORDS), _ends(name, AMOUNT_WORDS)
        text = f"strftime({name}, '%Y-%m-%d %H:%M:%S')" if kind == "date" else f"CAST({name} AS VARCHAR)"
        wide = f"max(length({text})) = min(length({text})) AND min(length({text})) >= 3 AND NOT {amount}"
        whole = f"min(CAST({name} % 1 = 0 AS INT)) = 1" if kind == "number" else "false"
        few = f"count(DISTINCT {name}) BETWEEN 2 AND 30 AND count({name}) >= 10 * count(DISTINCT {name})"
        codes = f"{whole} AND min({name}) >= 0 AND {few} AND ({code} OR ({wide}))" if kind == "number" else "false" if kind == "date" else \
            f"count(DISTINCT {name}) BETWEEN 2 AND 60 AND avg(length({name})) <= 6 AND (SELECT avg(CAST(length(x) <= 3 OR regexp_matches(x, '[0-9]') AS INT)) FROM (SELECT DISTINCT lower(trim({name})) AS x FROM {table})) >= 0.6"
        if kind == "date":
            semantic, audit = "'temporal'", f"count(*) FILTER (CAST({name} AS TIME) <> TIME '00:00:00') >= 0.5 * count({name}) AND count({name}) >= 5"
        elif kind == "number":
            semantic, audit = f"CASE WHEN {whole} AND min({name}) >= 1990 AND max({name}) <= 2100 AND count(DISTINCT {name}) <= 60 THEN 'temporal' WHEN ({codes}) OR ({whole} AND {code} AND min({name}) >= 0) THEN 'identifier' ELSE 'metric' END", "false"
        else:
            semantic = (f"CASE WHEN {code} AND avg(length({name})) <= 30 THEN 'identifier' WHEN count(DISTINCT {name}) >= 0.9 * count({name}) AND count({name}) >= 20 AND avg(length({name})) <= 24 THEN 'identifier'"
                        f" WHEN avg(length({name})) > 40 THEN 'text' WHEN count(DISTINCT {name}) <= greatest(60, floor(0.05 * count(*))) THEN 'dimension' WHEN avg(length({name})) > 24 THEN 'text' ELSE 'dimension' END")
            audit = "false"
        parts.append(f"SELECT '{name}' AS \"column\", '{kind}' AS type, {semantic} AS semantic, {audit} AS audit, {codes} AS codes, count({name}) AS n_filled, count(DISTINCT {name}) AS n_distinct FROM {table}")
    return " UNION ALL ".join(parts)


_LINE = {"l_orderkey": "number", "l_partkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date"}
_EVENT = {"event_id": "number", "ts": "date", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}


@query(_semantics_sql("lineitem", _LINE))
def semantics_lineitem(t):
    return lattice.column_semantics(t("lineitem"), list(_LINE)).drop("place", "n_rows", "documents")


@query(_semantics_sql("events", _EVENT))
def semantics_events(t):
    """The time stamp has a time of day on nearly all rows: it says when a row was written."""
    return lattice.column_semantics(t("events"), list(_EVENT)).drop("place", "n_rows", "documents")


@query("""SELECT 'o_orderdate' AS "column" WHERE (SELECT count(o_orderdate) FROM orders) > 0""")
def date_axis_orders(t):
    """The entry time stands before the order date and is no axis."""
    o = t("orders").select((F.col("o_orderdate") + F.expr("make_dt_interval(0, 7, 5)")).alias("entered_at"), "o_orderkey", "o_orderdate")
    return lattice.date_axis(lattice.column_semantics(o))


_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_linenumber"]


def _near_sql(columns, table, share):
    sets = " UNION ALL ".join(f"SELECT '{','.join(s)}' AS columns, count(*) - count(DISTINCT ({', '.join(s)})) AS extra, count(*) AS n FROM {table}" for s in combinations(columns, 2))
    return f"WITH s AS ({sets}) SELECT columns, extra FROM s WHERE extra <= {share} * n ORDER BY extra LIMIT 1"


def _ordered(found):
    """The set's columns in the table's order, so that ties of distinct values don't matter to a comparison."""
    place = F.create_map(*(F.lit(x) for i, c in enumerate(_KEYS) for x in (c, i)))
    return found.withColumn("columns", F.array_join(F.transform(F.array_sort(F.transform(F.split("columns", ","), lambda c: F.struct(place[c].alias("p"), c.alias("c")))), lambda s: s["c"]), ","))


@query(_near_sql(_KEYS, "lineitem", 0.15))
def near_key_found_lineitem(t):
    """Found among all columns; amounts, which differ more, are no candidates."""
    return _ordered(lattice.near_key(t("lineitem"), [*_KEYS, "l_extendedprice", "l_quantity"])).select("columns", "extra")


@query("SELECT l_orderkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_groups_lineitem(t):
    return lattice.repeated_groups(t("lineitem"), ["l_orderkey", "l_partkey"])


_PLACES = "p AS (SELECT c_mktsegment AS segment, n_name AS nation, CASE WHEN c_custkey = 7 THEN 'NOWHERE' ELSE r_name END AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 'site ' || (c_custkey % 60) AS site, 'zone ' || (c_custkey % 60 % 9) AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_PAIRS = [(a, b) for a in ("segment", "nation", "region", "parity", "site", "zone") for b in ("segment", "nation", "region", "parity", "site", "zone") if a != b]


@query(f"WITH {_PLACES}, x AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"from\", '{b}' AS \"to\", count(*) FILTER (k > 1) AS exceptions, count(*) AS groups, (SELECT count(DISTINCT {b}) FROM p) AS d, (SELECT count(DISTINCT {a}) FROM p) AS e FROM (SELECT {a}, count(DISTINCT {b}) AS k FROM p GROUP BY 1)" for a, b in _PAIRS)
    + """) SELECT "from", "to", exceptions, groups FROM x WHERE d >= 2 AND d <= e AND e < (SELECT count(*) FROM p) AND exceptions <= 0.01 * groups AND groups > d""")
def dependencies_customer(t):
    """A nation has one region (but for one customer, so one nation in 25), a site one zone."""
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    site = F.col("c_custkey") % 60
    p = j.select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.when(F.col("c_custkey") == 7, "NOWHERE").otherwise(F.col("r_name")).alias("region"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("parity"),
                 F.concat(F.lit("site "), site).alias("site"), F.concat(F.lit("zone "), site % 9).alias("zone"))
    return lattice.dependencies(p)


@query("""WITH o AS (SELECT o_orderpriority AS sheet, o_totalprice AS amount, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey, o_custkey, o_totalprice) - 1 AS i FROM orders),
b AS (SELECT sheet, i // 40 AS b, count(*) AS n FROM o GROUP BY 1, 2)
SELECT sheet, CAST(41 * b + n AS BIGINT) AS pos, 'part' AS kind FROM b WHERE n >= 3""")
def sum_totals_orders(t):
    """Each 40 orders of a priority are followed by a row without an id that is their sum."""
    o = t("orders").withColumn("i", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey", "o_custkey", "o_totalprice")) - 1)
    rows = o.select(F.col("o_orderpriority").alias("sheet"), (F.col("i") + F.expr("i div 40")).alias("pos"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    sums = o.groupBy(F.col("o_orderpriority").alias("sheet"), F.expr("i div 40").alias("b")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"), F.count("*").alias("n"))
    sums = sums.select("sheet", (F.col("b") * 41 + F.col("n")).alias("pos"), F.lit(None).cast("long").alias("id"), "amount")
    return totals.sum_totals(rows.union(sums), ["sheet"], "pos", ["id"], ["amount"])


_SETS = {"urgent": "o_orderpriority = '1-URGENT'", "urgent or low": "o_orderpriority IN ('1-URGENT', '5-LOW')", "large": "o_totalprice > 400000", "very large": "o_totalprice > 410000", "large again": "o_totalprice >= 400000.01", "negative": "o_totalprice < 0", "finished": "o_orderstatus = 'F'"}


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, o_orderkey AS k FROM orders WHERE {c}" for n, c in _SETS.items()) + """), d AS (SELECT DISTINCT * FROM s)
SELECT x.name AS a, y.name AS b, (SELECT count(*) FROM d WHERE name = x.name) AS n_a, (SELECT count(*) FROM d WHERE name = y.name) AS n_b, count(*) AS n_both FROM d x JOIN d y ON x.k = y.k AND x.name <> y.name GROUP BY 1, 2""")
def row_set_overlaps_orders(t):
    return rowsets.overlaps(rowsets.row_bitmaps(t("orders"), "o_orderkey", {n: F.expr(c) for n, c in _SETS.items()}))


def _merged_sql():
    """Each set in turn against those kept before it."""
    sql = ["s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, o_orderkey AS k FROM orders WHERE {c}" for n, c in _SETS.items()) + "), d AS (SELECT DISTINCT * FROM s)",
           "n AS (SELECT name, count(*) AS n FROM d GROUP BY 1)", "b AS (SELECT x.name AS a, y.name AS b, count(*) AS both_ FROM d x JOIN d y ON x.k = y.k GROUP BY 1, 2)"]
    names, done = list(_SETS), "k0 AS (SELECT '' AS name, NULL AS covered_by, 0 AS place WHERE false)"
    sql.append(done)
    for i, name in enumerate(names):
        by = f"(SELECT arg_min(k.name, k.place) FROM k{i} k JOIN b ON b.a = '{name}' AND b.b = k.name JOIN n ON n.name = '{name}' WHERE k.covered_by IS NULL AND b.both_ >= 0.9 * n.n)"
        sql.append(f"k{i + 1} AS (SELECT * FROM k{i} UNION ALL SELECT '{name}', {by}, {i})")
    return "WITH " + ",\n".join(sql) + f" SELECT k.name, coalesce(n.n, 0) AS n_rows, covered_by IS NULL AS kept, covered_by FROM k{len(names)} k LEFT JOIN n ON n.name = k.name"


@query(_merged_sql())
def merged_row_sets_orders(t):
    return rowsets.merge_row_sets(t("orders"), "o_orderkey", {n: F.expr(c) for n, c in _SETS.items()})


_JOINED = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"], "supplier": ["s_suppkey", "s_name", "s_acctbal"]}


def _joins_sql():
    """Every pair of id columns of two tables by the rule, in the direction that it says."""
    ids = {t: [c for c in cs if c.endswith("key")] for t, cs in _JOINED.items()}
    pairs = [(t, a, u, b) for i, t in enumerate(_JOINED) for u in list(_JOINED)[i + 1 :] for a in ids[t] for b in ids[u]]
    side = "SELECT '{t}' AS t, '{c}' AS c, {c} AS k, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 3"
    sql = ["h AS (" + " UNION ALL ".join(side.format(t=t, c=c) for t, cs in ids.items() for c in cs) + ")", "z AS (SELECT t, c, count(*) AS d, sum(n) AS n FROM h GROUP BY 1, 2)",
           "m AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS s, sum(a.n) AS ra, sum(b.n) AS rb FROM h a JOIN h b USING (k) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)",
           "l(ta, ca, tb, cb, hs) AS (VALUES " + ", ".join(f"('{t}', '{a}', '{u}', '{b}', {relations.header_similarity(a, b)})" for t, a, u, b in pairs) + ")",
           """p AS (SELECT m.*, l.hs, s / x.d AS ab, s / y.d AS ba, x.d = x.n AS ua, y.d = y.n AS ub, ra / x.n AS cova, rb / y.n AS covb FROM m JOIN l USING (ta, ca, tb, cb) JOIN z x ON x.t = ta AND x.c = ca JOIN z y ON y.t = tb AND y.c = cb)""",
           """o AS (SELECT *, CASE WHEN ua <> ub AND ((CASE WHEN ub THEN cova ELSE covb END) >= 0.6 OR (ab >= 0.8 AND ba >= 0.8)) THEN ub ELSE ab >= ba END AS f FROM p WHERE greatest(ab, ba) >= CASE WHEN hs < 0.3 THEN 0.5 ELSE 0.2 END)""",
           """r AS (SELECT CASE WHEN f THEN ta ELSE tb END AS from_table, CASE WHEN f THEN ca ELSE cb END AS from_column, CASE WHEN f THEN tb ELSE ta END AS to_table, CASE WHEN f THEN cb ELSE ca END AS to_column, s AS n_shared,
CASE WHEN f THEN ab ELSE ba END AS cont, CASE WHEN f THEN cova ELSE covb END AS cov, CASE WHEN f THEN ub ELSE ua END AS to_unique, hs FROM o)"""]
    return "WITH " + ",\n".join(sql) + """ SELECT from_table, from_column, to_table, to_column, n_shared, round(cont, 4) AS values_matched, round(cov, 4) AS rows_matched, to_unique, round(hs, 2) AS header_similarity,
CASE WHEN (cov >= 0.95 AND (hs >= 0.3 OR to_unique OR cont >= 0.98)) OR (hs >= 0.8 AND to_unique AND cov >= 0.6) THEN 'auto' ELSE 'ask' END AS band FROM r WHERE cov >= 0.2"""


@query(_joins_sql())
def join_bands(t):
    """Amounts, dates and names of one table alone are no candidates, whatever values they share."""
    return relations.discover_joins({name: t(name).select(*columns) for name, columns in _JOINED.items()})


_MIXED = "CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) WHEN c_custkey % 50 = 1 THEN 'elsewhere' ELSE 'K' || n_nationkey END"


@query(f"""WITH m AS (SELECT {_MIXED} AS place FROM customer JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT count(*) AS n_rows, count(*) FILTER (place LIKE 'K%') AS n_codes, count(*) FILTER (place LIKE 'NATION%') AS n_names FROM m)
SELECT n_rows, n_codes, n_names, n_rows - n_codes - n_names AS n_other, n_codes + n_names >= 0.95 * n_rows AND least(n_codes, n_names) >= greatest(3, 0.02 * n_rows) AS mixed FROM w""")
def code_or_name_customer(t):
    """Nations written by code on some rows and by name on others."""
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.expr(_MIXED).alias("place"))
    return relations.code_or_name(j, "place", t("nation").withColumn("code", F.concat(F.lit("K"), F.col("n_nationkey"))), "code", "n_name")


_LATER = "o_orderkey % 97 <> 0"


@query(f"""WITH o AS (SELECT count(*) AS n FROM orders), w AS (SELECT count(*) AS n FROM orders WHERE {_LATER})
SELECT 'rows' AS kind, NULL AS "column", NULL AS detail, w.n - o.n AS n FROM o, w UNION ALL SELECT 'renamed', 'o_orderstatus', 'state', NULL UNION ALL SELECT 'added', 'channel', NULL, NULL
UNION ALL SELECT 'changed', c, NULL, NULL FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderdate'), ('state'), ('o_orderpriority')) v(c)
UNION ALL SELECT 'new', 'o_orderpriority', '9-NONE', 1 UNION ALL SELECT 'gone', 'o_orderpriority', '5-LOW', 1""")
def freshness_orders(t):
    """Orders seen again with rows gone, a column renamed, one added, and a priority written another way."""
    old = t("orders")
    new = old.filter(_LATER).withColumnRenamed("o_orderstatus", "state").withColumn("channel", F.lit("web")).withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "5-LOW", "9-NONE").otherwise(F.col("o_orderpriority")))
    return fresh.freshness(old, new)


def _book(t):
    """Orders as sheets by status: an amount a row, and every 50 rows a formula that adds up the block above it."""
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey", "o_custkey", "o_totalprice")
    o = t("orders").withColumn("r", F.row_number().over(w)).select(F.lit("book").alias("file"), F.col("o_orderstatus").alias("sheet"), "r", F.col("o_totalprice").alias("n"))
    amounts = o.select("file", "sheet", "r", F.lit(2).alias("c"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("s"), "n", F.lit(None).cast("string").alias("formula"))
    end = F.col("r") * 1
    sums = o.filter("r % 50 = 0").select("file", "sheet", "r", F.lit(5).alias("c"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.concat(F.lit("=SUM($B$"), end - 49, F.lit(":B"), end, F.lit(")"), F.when(F.col("r") > 50, F.concat(F.lit("+E"), end - 50)).otherwise("")).alias("formula"))
    return amounts.union(sums)


@query("""WITH o AS (SELECT o_orderstatus AS sheet, o_totalprice AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey, o_custkey, o_totalprice) AS r FROM orders)
SELECT sheet, CAST((r + 49) // 50 * 50 AS INTEGER) AS formula_row, count(*) AS n_cells, round(sum(n), 2) AS total FROM o WHERE (r + 49) // 50 * 50 <= (SELECT max(r) FROM o p WHERE p.sheet = o.sheet) GROUP BY 1, 2""")
def range_sums_orders(t):
    """What each formula's range adds up to, by containment of cells in ranges."""
    book = _book(t)
    boxes = ranges.read_boxes(book).filter("c1 = 2").select(F.col("file"), "to_sheet", "r1", "c1", "r2", "c2", F.col("r").alias("formula_row"))
    return ranges.contained(book, boxes).groupBy("sheet", "formula_row").agg(F.count("*").alias("n_cells"), F.round(F.sum("n"), 2).alias("total"))


@query("""WITH o AS (SELECT o_orderstatus AS sheet, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey, o_custkey, o_totalprice) AS r FROM orders)
SELECT 'book|' || sheet || '|' || (r - 50) || '|5' AS src, 'book|' || sheet || '|' || r || '|5' AS dst FROM o WHERE r % 50 = 0 AND r > 50""")
def formula_edges_orders(t):
    return ranges.formula_edges(_book(t))
