"""Queries over the test tables, one for each implemented operator, and their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.functions.keys import norm_text, parse_date, parse_number
from tidemark.operators import evidence, fresh, graph, joins, keys, lattice, ledger, profile, recipes, roles, timeline
from tidemark.operators.rules import Rule, apply_rules, rule_effect

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(t)``, where ``t(name)`` reads a table, under its own name."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


LANGUAGES = ["EN", "FR", "DE", "ES", "IT"]


# profiles
_PROFILE_NUMBER = "SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_filled, count(DISTINCT {c}) AS n_distinct, NULL AS least_text, NULL AS greatest_text, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, round(sum(CAST({c} AS DOUBLE)), 2) AS total, CAST(count(*) FILTER ({c} < 0) AS BIGINT) AS n_negative, CAST(count(*) FILTER ({c} = 0) AS BIGINT) AS n_zero FROM {t}"
_PROFILE_TEXT = "SELECT '{c}', count(*), count({c}), count(DISTINCT {c}), {lo}, {hi}, NULL, NULL, NULL, 0, 0 FROM {t}"


def _profile_sql(table, numbers, texts, days):
    parts = [_PROFILE_NUMBER.format(c=c, t=table) for c in numbers]
    parts += [_PROFILE_TEXT.format(c=c, t=table, lo=f"min({c})", hi=f"max({c})") for c in texts]
    parts += [_PROFILE_TEXT.format(c=c, t=table, lo=f"strftime(min({c}), '%Y-%m-%d')", hi=f"strftime(max({c}), '%Y-%m-%d')") for c in days]
    return " UNION ALL ".join(parts)


@query(_profile_sql("lineitem", ["l_orderkey", "l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"], ["l_shipdate"]))
def profile_lineitem(t):
    return profile.column_profile(t("lineitem"), ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"])


@query(_profile_sql("orders", ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]))
def profile_orders(t):
    return profile.column_profile(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])


@query(_profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"], []))
def profile_customer(t):
    return profile.column_profile(t("customer"), ["c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment"])


@query("""SELECT * FROM (SELECT c AS "column", k, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, k) AS rank FROM (
  SELECT 'event_type' AS c, lower(trim(event_type)) AS k, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2) WHERE k <> '') WHERE rank <= 10""")
def top_values_events(t):
    return profile.top_values(profile.histogram(t("events"), ["event_type", "user_id"]))


@query("""SELECT regexp_replace(regexp_replace(regexp_replace(substr(c_name, 1, 24), '[0-9]+', '9', 'g'), '\\p{Lu}+', 'A', 'g'), '\\p{Ll}+', 'a', 'g') AS shape, count(*) AS n
FROM customer WHERE c_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, shape LIMIT 3""")
def value_shapes(t):
    return profile.top_shapes(t("customer"), "c_name")


@query("""SELECT lower(trim(s)) AS k, count(*) AS n_spellings, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS s, count(*) AS n FROM part GROUP BY 1) GROUP BY 1 HAVING count(*) > 1""")
def spelling_variants(t):
    return profile.spelling_variants(t("part").withColumn("brand", F.expr("CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END")), "brand")


@query(r"""SELECT 'email' AS pattern, round(avg(CAST(regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+') AS INT)), 6) AS share FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'phone', round(avg(CAST(regexp_matches(text, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}') AS INT)), 6) FROM documents WHERE text IS NOT NULL""")
def email_phone_rate(t):
    return profile.pattern_rates(t("documents"), "text", {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+", "phone": r"[0-9]{3}-[0-9]{3,4}-[0-9]{4}"})


@query("SELECT count(*) AS n_rows, count(*) FILTER (upper(trim(lang)) IN ('EN','FR','DE','ES','IT')) AS n_in_set, count(DISTINCT lang) FILTER (upper(trim(lang)) IN ('EN','FR','DE','ES','IT')) AS n_codes FROM documents WHERE lang IS NOT NULL")
def standard_codes(t):
    return profile.coded_share(t("documents"), "lang", LANGUAGES)


@query("""SELECT raw, n, CAST(d AS VARCHAR) AS day FROM (VALUES ('12%', 0.12, NULL), ('(42.10)', -42.10, NULL), ('1,234.5', 1234.5, NULL), ('007', NULL, NULL), ('12345678901234567', NULL, NULL),
('2024-03-05', NULL, DATE '2024-03-05'), ('13/04/2024', NULL, DATE '2024-04-13'), ('04/13/2024', NULL, DATE '2024-04-13'), ('04/05/2024', NULL, NULL), ('abc', NULL, NULL)) x(raw, n, d)""")
def parse_scalars(t):
    raw = ["12%", "(42.10)", "1,234.5", "007", "12345678901234567", "2024-03-05", "13/04/2024", "04/13/2024", "04/05/2024", "abc"]
    one = t("region").filter("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, raw))).alias("raw"))
    return one.select("raw", parse_number(F.col("raw")).alias("n"), F.date_format(parse_date(F.col("raw")), "yyyy-MM-dd").alias("day"))


# keys, dependencies, joins
def _key_sql(table, sets):
    return " UNION ALL ".join(f"SELECT '{','.join(s)}' AS columns, (SELECT count(*) FROM {table}) AS n_rows, count(*) AS n_distinct, (SELECT count(*) FROM {table}) = count(*) AS is_key FROM (SELECT DISTINCT {', '.join(s)} FROM {table})" for s in sets)


@query(_key_sql("orders", [["o_orderkey"], ["o_custkey"], ["o_orderdate"], ["o_orderkey", "o_custkey"], ["o_orderkey", "o_orderdate"], ["o_custkey", "o_orderdate"]]))
def key_candidates_orders(t):
    return keys.key_candidates(t("orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]


@query(_key_sql("lineitem", [s for n in (1, 2, 3) for s in combinations(_LINE_KEYS, n)]))
def key_candidates_lineitem(t):
    return keys.key_candidates(t("lineitem"), _LINE_KEYS, most=3)


@query("SELECT n AS size, count(*) AS n_groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY 1")
def near_key_lineitem(t):
    return keys.near_key(t("lineitem"), ["l_orderkey", "l_linenumber"])


def _fd_sql(table, pairs):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_groups, count(*) FILTER (n > 1) AS n_broken, count(*) FILTER (n > 1) <= 0.01 * count(*) AS holds FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM {table} WHERE {a} IS NOT NULL GROUP BY 1)" for a, b in pairs)


@query(_fd_sql("nation", [("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey")]))
def fd_nation_region(t):
    return keys.functional_deps(t("nation"), [("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey")])


@query(_fd_sql("part", [("p_brand", "p_type"), ("p_name", "p_brand"), ("p_partkey", "p_name")]))
def fd_part(t):
    return keys.functional_deps(t("part"), [("p_brand", "p_type"), ("p_name", "p_brand"), ("p_partkey", "p_name")])


def _join_sql(left, right, pairs):
    return " UNION ALL ".join(f"""SELECT '{a}' AS from_column, '{b}' AS to_column, count(*) AS n_shared, round(count(*) / (SELECT count(DISTINCT {a}) FROM {left}), 6) AS in_to, round(count(*) / (SELECT count(DISTINCT {b}) FROM {right}), 6) AS in_from, round(sum(n) / (SELECT count({a}) FROM {left}), 6) AS rows_matched
FROM (SELECT {a} AS k, count(*) AS n FROM {left} GROUP BY 1) x JOIN (SELECT DISTINCT {b} AS k FROM {right}) y USING (k)
HAVING count(*) >= 3 AND greatest(count(*) / (SELECT count(DISTINCT {a}) FROM {left}), count(*) / (SELECT count(DISTINCT {b}) FROM {right})) >= 0.2""" for a, b in pairs)


@query(_join_sql("lineitem", "orders", [("l_orderkey", "o_orderkey"), ("l_orderkey", "o_custkey"), ("l_suppkey", "o_orderkey"), ("l_suppkey", "o_custkey")]))
def join_discovery(t):
    return keys.find_joins(t("lineitem"), t("orders"), ["l_orderkey", "l_suppkey"], ["o_orderkey", "o_custkey"])


@query("SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_values FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_rows(t):
    return joins.unmatched(t("documents"), t("labels"), "doc_id", "doc_id")


@query("""SELECT count(*) AS n_lines, CAST(round(sum(l_extendedprice), 2) AS DOUBLE) AS amount FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))""")
def semi_join_category(t):
    part = t("part")
    first = part.agg(F.min("p_brand").alias("p_brand"))
    chosen = part.join(F.broadcast(first), "p_brand", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").join(chosen, "l_partkey", "left_semi").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


def _windows(t):
    """A dated reference made from ``part``: two versions of each even part, one of each odd one."""
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    a = p.select("l_partkey", F.lit("1993-01-01").cast("date").alias("start"), F.when(F.col("l_partkey") % 2 == 0, F.lit("1995-06-30").cast("date")).alias("end"), F.col("p_retailprice").alias("price"))
    b = p.filter("l_partkey % 2 = 0").select("l_partkey", F.when(F.col("l_partkey") % 4 == 0, F.lit("1995-06-01")).otherwise(F.lit("1995-09-01")).cast("date").alias("start"), F.lit("1996-12-31").cast("date").alias("end"), (F.col("p_retailprice") * 2).alias("price"))
    return a.union(b)


_WINDOWS = """w AS (SELECT p_partkey AS k, DATE '1993-01-01' AS a, CASE WHEN p_partkey % 2 = 0 THEN DATE '1995-06-30' END AS z, p_retailprice AS price FROM part
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN DATE '1995-06-01' ELSE DATE '1995-09-01' END, DATE '1996-12-31', p_retailprice * 2 FROM part WHERE p_partkey % 2 = 0)"""


@query(f"""WITH {_WINDOWS}, l AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem),
x AS (SELECT k, d, NOT EXISTS (SELECT 1 FROM w WHERE w.k = l.k AND l.d BETWEEN w.a AND coalesce(w.z, DATE '9999-12-31')) AS o FROM l WHERE k IN (SELECT k FROM w))
SELECT k AS l_partkey, count(*) AS n_lines, count(*) FILTER (o) AS n_outside FROM x GROUP BY 1 HAVING count(*) FILTER (o) >= 5 AND count(*) FILTER (o) >= 0.05 * count(*)""")
def interval_windows(t):
    return joins.outside_windows(t("lineitem"), _windows(t), "l_partkey", "l_shipdate", "start", "end")


# with an open row and a long one over all others
@query(f"""WITH {_WINDOWS}, v AS (SELECT k, a, z FROM w UNION ALL SELECT k, DATE '1995-10-01', NULL FROM w WHERE k % 6 = 0 UNION ALL SELECT k, NULL, DATE '1997-01-01' FROM w WHERE k % 10 = 0),
o AS (SELECT k, coalesce(a, DATE '0001-01-01') AS a, coalesce(z, DATE '9999-12-31') AS z FROM v)
SELECT k AS l_partkey, count(*) AS n_versions, count(*) FILTER (a <= b) AS n_overlaps
FROM (SELECT *, max(z) OVER (PARTITION BY k ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o) GROUP BY 1 HAVING count(*) > 1""")
def versions(t):
    w = _windows(t).select("l_partkey", "start", "end")
    late = w.filter("l_partkey % 6 = 0").select("l_partkey", F.lit("1995-10-01").cast("date"), F.lit(None).cast("date"))
    long = w.filter("l_partkey % 10 = 0").select("l_partkey", F.lit(None).cast("date"), F.lit("1997-01-01").cast("date"))
    return joins.version_overlaps(w.union(late).union(long), "l_partkey", "start", "end")


@query(f"""WITH {_WINDOWS}, n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM w WHERE k % 4 <> 0)
SELECT count(*) AS n_lines, count(n.price) AS n_priced, round(sum(n.price), 2) AS total FROM lineitem l LEFT JOIN n ON n.k = l.l_partkey AND (n.n = 1 OR CAST(l.l_shipdate AS DATE) BETWEEN n.a AND n.z)""")
def asof_price(t):
    lines = t("lineitem").withColumn("day", F.to_date("l_shipdate"))
    ref = _windows(t).withColumn("price", F.when(F.col("l_partkey") % 4 != 0, F.col("price")))  # each fourth part has no price
    priced = joins.reference_price(lines, ref, "l_partkey", "day", "start", "end", "price")
    return priced.agg(F.count("*").alias("n_lines"), F.count("reference").alias("n_priced"), F.round(F.sum("reference"), 2).alias("total"))


def _price_versions(t):
    """``_windows`` of all parts, with an open-ended current version of each even part and an open start for each sixth."""
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    current = p.filter("l_partkey % 2 = 0").select("l_partkey", F.lit("1997-01-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end"), (F.col("p_retailprice") * 3).alias("price"))
    first = p.filter("l_partkey % 6 = 0").select("l_partkey", F.lit(None).cast("date").alias("start"), F.lit("1992-12-31").cast("date").alias("end"), (F.col("p_retailprice") * 4).alias("price"))
    return _windows(t).union(current).union(first)


@query(f"""WITH {_WINDOWS}, v AS (SELECT k, coalesce(a, DATE '0001-01-01') AS a, coalesce(z, DATE '9999-12-31') AS z, price, count(*) OVER (PARTITION BY k) AS n FROM (
SELECT * FROM w UNION ALL SELECT p_partkey, DATE '1997-01-01', NULL, p_retailprice * 3 FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, NULL, DATE '1992-12-31', p_retailprice * 4 FROM part WHERE p_partkey % 6 = 0)),
l AS (SELECT row_number() OVER () AS i, l_partkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem),
x AS (SELECT v.price, row_number() OVER (PARTITION BY l.i ORDER BY v.a, v.z, v.price) AS r FROM l LEFT JOIN v ON v.k = l.k AND (v.n = 1 OR l.d BETWEEN v.a AND v.z))
SELECT count(*) AS n_lines, count(price) AS n_priced, round(sum(price), 2) AS total FROM x WHERE r = 1""")
def asof_price_whole(t):
    lines = t("lineitem").withColumn("day", F.to_date("l_shipdate"))
    priced = joins.reference_price(lines, _price_versions(t), "l_partkey", "day", "start", "end", "price")
    return priced.agg(F.count("*").alias("n_lines"), F.count("reference").alias("n_priced"), F.round(F.sum("reference"), 2).alias("total"))


@query("SELECT count(*) AS n_lines, count(*) FILTER (l_shipdate < o_orderdate) AS n_before FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def ship_before_order(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_before"))


@query("SELECT min(doc_id) AS first_key, count(*) AS n_copies FROM documents GROUP BY text HAVING count(*) > 1")
def copies_detect(t):
    return joins.document_copies(t("documents"), ["text"], "doc_id")


@query("""SELECT CASE WHEN abs(lo - hi) <= 0.005 THEN 'equal' WHEN abs(lo + hi) <= 0.005 THEN 'opposite' ELSE 'other' END AS kind, count(*) AS n_documents
FROM (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 2) GROUP BY 1""")
def twin_pairs(t):
    return joins.twin_pairs(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


# recipes
def _pareto_sql(entity, table, amount):
    return f"""WITH g AS (SELECT {entity} AS e, sum({amount}) AS a FROM {table} WHERE {entity} IS NOT NULL AND {amount} IS NOT NULL GROUP BY 1), p AS (SELECT * FROM g WHERE a > 0),
r AS (SELECT coalesce(sum(a) OVER (ORDER BY a DESC, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT count(*) FILTER (b < 0.8 * (SELECT sum(a) FROM p)) AS n_covering, (SELECT count(*) FROM g) AS n_entities FROM r HAVING count(*) > 0 AND (SELECT count(*) FROM g) >= 5"""


def _top_sql(entity, table, amount):
    return f"""WITH g AS (SELECT {entity} AS e, sum({amount}) AS a FROM {table} WHERE {entity} IS NOT NULL GROUP BY 1)
SELECT CAST(e AS VARCHAR) AS entity, round(a, 2) AS amount, round(a / (SELECT sum(a) FROM g WHERE a > 0), 6) AS share FROM g ORDER BY a DESC, e DESC LIMIT 1"""


for _name, _entity, _table, _amount in (("supplier_revenue", "l_suppkey", "lineitem", "l_extendedprice"), ("part_revenue", "l_partkey", "lineitem", "l_extendedprice"),
                                        ("customer_orders", "o_custkey", "orders", "o_totalprice"), ("customer_balance", "c_custkey", "customer", "c_acctbal"), ("user_value", "user_id", "events", "value")):
    QUERIES[f"pareto_{_name}"] = lambda spark, d, e=_entity, t=_table, a=_amount: recipes.pareto(spark.read.parquet(f"{d}/{t}.parquet"), e, a)
    ORACLE_SQL[f"pareto_{_name}"] = _pareto_sql(_entity, _table, _amount)
    QUERIES[f"top_share_{_name}"] = lambda spark, d, e=_entity, t=_table, a=_amount: recipes.top_share(spark.read.parquet(f"{d}/{t}.parquet"), e, a)
    ORACLE_SQL[f"top_share_{_name}"] = _top_sql(_entity, _table, _amount)

for _table, _column in (("orders", "o_orderpriority"), ("part", "p_type"), ("events", "event_type"), ("customer", "c_mktsegment")):
    QUERIES[f"mixed_{_column}"] = lambda spark, d, t=_table, c=_column: recipes.mixed(spark.read.parquet(f"{d}/{t}.parquet"), c)
    ORACLE_SQL[f"mixed_{_column}"] = f"SELECT {_column} AS value, count(*) AS n, round(count(*) / (SELECT count({_column}) FROM {_table}), 6) AS share FROM {_table} WHERE {_column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 4"

for _table, _column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
    QUERIES[f"date_range_{_table}"] = lambda spark, d, t=_table, c=_column: recipes.date_range(spark.read.parquet(f"{d}/{t}.parquet"), c)
    ORACLE_SQL[f"date_range_{_table}"] = f"SELECT strftime(min({_column}), '%Y-%m-%d') AS first_day, strftime(max({_column}), '%Y-%m-%d') AS last_day, CAST((year(max({_column})) - year(min({_column}))) * 12 + month(max({_column})) - month(min({_column})) + 1 AS BIGINT) AS n_months FROM {_table}"


@query("SELECT count(*) FILTER (c_acctbal < 0) AS n_negative, round(sum(c_acctbal) FILTER (c_acctbal < 0), 2) AS sum_negative FROM customer")
def negatives_customer(t):
    return recipes.negatives(t("customer"), "c_acctbal")


@query("SELECT count(*) AS n_values, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_extra FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicates_lineitem(t):
    return recipes.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


def _labelled(t):
    return t("documents").select("doc_id", "source", "lang").join(t("labels"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"""SELECT 'quality' AS "column", round(avg(CAST(quality IS NULL AS INT)), 6) AS blank_rate FROM {_LABELLED} UNION ALL SELECT 'lang', round(avg(CAST(lang IS NULL AS INT)), 6) FROM {_LABELLED}""")
def blank_rate_documents(t):
    return recipes.blank_rates(_labelled(t), ["quality", "lang"])


@query("""SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_distinct FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem""")
def count_distinct_lineitem(t):
    return recipes.count_distinct(t("lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT count(*) AS n_rows, count(*) FILTER (ok) AS n_equal, round(avg(CAST(ok AS INT)), 6) AS share FROM (SELECT abs(l_quantity * p_retailprice - l_extendedprice) <= 0.0051 AS ok FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def product_check(t):
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return recipes.product_check(j, F.col("l_quantity"), F.col("p_retailprice"), F.col("l_extendedprice"))


_PRICED = "(SELECT l_partkey AS item, l_suppkey AS e, date_trunc('month', l_shipdate) AS m, l_extendedprice / l_quantity AS p, l_quantity AS q FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)"


@query(f"""SELECT item, count(*) AS n_periods, round(sum(paid - lo * q) + 1e-6, 2) AS excess FROM (SELECT item, m, min(p) AS lo, max(p) AS hi, sum(p * q) AS paid, sum(q) AS q FROM {_PRICED} GROUP BY 1, 2 HAVING count(DISTINCT e) > 1 AND max(p) > min(p) * 1.05) GROUP BY 1""")
def spread_part_supplier(t):
    return recipes.spread(t("lineitem"), "l_partkey", "l_suppkey", F.trunc("l_shipdate", "month"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"))


@query(f"""SELECT item, count(*) AS n_periods, round(min(lo), 2) AS low, round(max(hi), 2) AS high FROM (SELECT item, m, min(p) AS lo, max(p) AS hi FROM {_PRICED} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2 AND max(hi - lo) <= 0.005 AND max(hi) - min(lo) > 0.005""")
def price_trend(t):
    return recipes.price_trend(t("lineitem"), "l_partkey", "l_suppkey", F.trunc("l_shipdate", "month"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"))


@query("""SELECT count(*) AS n_groups, count(*) FILTER (abs(s) <= 0.0051) AS n_balanced FROM (SELECT sum(CASE WHEN side = 1 THEN a ELSE -a END) AS s FROM (
SELECT l_orderkey, l_extendedprice AS a, 1 AS side FROM lineitem UNION ALL SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN a + 1 ELSE a END, 2 FROM (SELECT l_orderkey, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1)) GROUP BY l_orderkey HAVING count(*) >= 2)""")
def balanced_groups(t):
    lines = t("lineitem").select("l_orderkey", F.col("l_extendedprice").alias("net"))
    other = lines.groupBy("l_orderkey").agg(F.sum("net").alias("net")).select("l_orderkey", (-F.when(F.col("l_orderkey") % 10 == 0, F.col("net") + 1).otherwise(F.col("net"))).alias("net"))
    return recipes.balanced_groups(lines.union(other), "l_orderkey", F.col("net"))


@query(f"""SELECT 'quality' AS a, 'toxic' AS b, count(*) FILTER (quality IS NULL AND toxic IS NULL) AS n_both, count(*) FILTER (quality IS NULL AND toxic IS NOT NULL) AS n_a, count(*) FILTER (quality IS NOT NULL AND toxic IS NULL) AS n_b FROM {_LABELLED}""")
def coblank(t):
    return recipes.co_blank(_labelled(t), ["quality", "toxic"])


@query(f"SELECT source, count(*) AS n_rows, round(avg(CAST(quality IS NULL AS INT)), 6) AS blank_rate FROM {_LABELLED} GROUP BY 1")
def group_blank_rate(t):
    return recipes.group_blank_rate(_labelled(t), "source", "quality")


@query("""WITH g AS (SELECT user_id, sum(value) AS total FROM events WHERE user_id IS NOT NULL GROUP BY 1), l AS (SELECT list(total ORDER BY total) AS x, count(*) AS n FROM g),
q AS (SELECT x[n // 4 + 1] AS a, x[3 * n // 4 + 1] AS z FROM l)
SELECT user_id, round(total, 2) AS total FROM g, q WHERE total > z + 3 * (z - a)""")
def outlier_iqr(t):
    return recipes.entity_outliers(t("events"), "user_id", "value")


def _billed(t):
    """Parts with a billed price within 3 % of their retail price, but for a few slips of ten times."""
    slip = F.when(F.col("p_partkey").isin(77, 150), 10.0).otherwise(1.0)
    return t("part").withColumn("billed", F.col("p_retailprice") * (1 + (F.col("p_partkey") % 7 - 3) / 100.0) * slip)


def _ratio_sql(key, ratio, source):
    return f"""WITH r AS (SELECT {key}, {ratio} AS ratio FROM {source}), l AS (SELECT list(ratio ORDER BY ratio) AS x, count(*) AS n FROM r),
f AS (SELECT n, x[n * 5 // 100 + 1] AS lo, x[greatest(1, n * 95 // 100)] AS hi, x[n // 2 + 1] AS med FROM l), d AS (SELECT {key}, ratio, abs(ratio - med) AS dist, n FROM r, f WHERE n >= 30 AND lo > 0 AND hi <= 2.5 * lo),
m AS (SELECT list(dist ORDER BY dist)[count(*) // 2 + 1] * 1.4826 AS mad FROM d), o AS (SELECT d.* FROM d, m WHERE mad > 0 AND dist / mad > 5)
SELECT {key}, round(ratio, 4) AS ratio FROM o WHERE (SELECT count(*) FROM o) <= greatest(1, least(3, 0.01 * n))"""


@query(_ratio_sql("p_partkey", "p_retailprice * (1 + (p_partkey % 7 - 3) / 100.0) * (CASE WHEN p_partkey IN (77, 150) THEN 10.0 ELSE 1.0 END) / p_retailprice", "part WHERE p_retailprice > 0"))
def ratio_outliers(t):
    return recipes.ratio_outliers(_billed(t), ["p_partkey"], "p_retailprice", "billed")


@query(_ratio_sql("l_orderkey, l_linenumber", "l_extendedprice / l_quantity", "lineitem WHERE l_quantity > 0 AND l_extendedprice >= 0"))
def ratio_outliers_spread(t):
    """Prices of all parts spread out: no ratio is the norm, so no line is named."""
    return recipes.ratio_outliers(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity", "l_extendedprice")


def _ids(t):
    """Orders' customers as written ids, with placeholders and outliers planted."""
    key = F.col("o_orderkey")
    written = F.when(key % 500 == 3, "TEST-1").when(key % 500 == 5, "C999999").when(key % 500 == 7, "C88000000").when(key % 500 == 9, "").otherwise(F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")))
    return t("orders").withColumn("who", written).withColumn("amount", F.when(key % 500 == 3, 1.0).otherwise(F.col("o_totalprice")))


_IDS_SQL = """w AS (SELECT CASE o_orderkey % 500 WHEN 3 THEN 'TEST-1' WHEN 5 THEN 'C999999' WHEN 7 THEN 'C88000000' WHEN 9 THEN '' ELSE 'C' || lpad(o_custkey::VARCHAR, 6, '0') END AS who,
CASE WHEN o_orderkey % 500 = 3 THEN 1.0 ELSE o_totalprice END AS amount FROM orders),
i AS (SELECT who AS id, upper(regexp_extract(who, '^([A-Za-z]*)[-_ ]?([0-9]+)$', 1)) AS prefix, nullif(regexp_extract(who, '^([A-Za-z]*)[-_ ]?([0-9]+)$', 2), '') AS digits FROM w WHERE who <> '' GROUP BY 1),
q AS (SELECT prefix, list(digits::BIGINT ORDER BY digits::BIGINT) AS x, count(*) AS n FROM i WHERE digits IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
s AS (SELECT id, CASE WHEN regexp_matches(id, '(?i)test|dummy|xxx') THEN 'word' WHEN regexp_matches(digits, '^(000+|999+)$') THEN 'digits' WHEN digits::BIGINT > x[3 * n // 4 + 1] + 3 * (x[3 * n // 4 + 1] - x[n // 4 + 1]) THEN 'far' END AS why FROM i LEFT JOIN q USING (prefix))"""


@query(f"WITH {_IDS_SQL} SELECT id, why FROM s WHERE why IS NOT NULL")
def numbered_ids(t):
    return recipes.numbered_ids(_ids(t), "who")


@query(f"""WITH {_IDS_SQL}, e AS (SELECT who AS id, count(*) >= 3 AND min(amount) = max(amount) AS steady FROM w WHERE who <> '' GROUP BY 1), a AS (SELECT count(*) AS n, count(*) FILTER (steady) AS k FROM e)
SELECT id, why, 'constant' AS sign FROM s JOIN e USING (id), a WHERE why IS NOT NULL AND steady AND k - 1 < 0.05 * (n - 1)""")
def placeholder_ids(t):
    return recipes.placeholder_ids(_ids(t), "who", "amount")


@query("""WITH w AS (SELECT user_id, CASE WHEN user_id = 5 AND event_id % 4 <> 0 THEN 0 ELSE value + 1 END AS paid, CASE WHEN user_id % 2 = 0 THEN 0 ELSE value + 1 END AS often FROM events),
p AS (SELECT user_id, count(*) AS n, count(*) FILTER (paid = 0) AS z, count(*) FILTER (often = 0) AS y FROM w WHERE user_id IS NOT NULL GROUP BY 1), a AS (SELECT sum(n) AS n, sum(z) AS z, sum(y) AS y FROM p),
h AS (SELECT user_id AS entity, 'paid' AS amount, p.n AS n_rows, p.z AS n_zero, a.n - p.n AS rest, a.n - p.n - (a.z - p.z) AS live FROM p, a UNION ALL SELECT user_id, 'often', p.n, p.y, a.n - p.n, a.n - p.n - (a.y - p.y) FROM p, a)
SELECT entity, amount, n_rows, n_zero, round(live / rest, 6) AS share FROM h WHERE n_zero >= 6 AND 2 * n_zero >= n_rows AND rest > 0 AND live >= 0.95 * rest""")
def idle_amounts(t):
    """One user's amount is planted as zero on three rows of four; an amount that half the users lack names nobody."""
    paid = F.when((F.col("user_id") == 5) & (F.col("event_id") % 4 != 0), 0.0).otherwise(F.col("value") + 1)
    return recipes.idle_amounts(t("events").withColumn("paid", paid).withColumn("often", F.when(F.col("user_id") % 2 == 0, 0.0).otherwise(F.col("value") + 1)), "user_id", ["paid", "often"])


@query("""SELECT regexp_extract(p_name, '^([A-Za-z]+)', 1) AS prefix, min(p_brand) AS "only", count(*) AS n_rows FROM part GROUP BY 1 HAVING min(p_brand) = max(p_brand)""")
def exclusive_prefix(t):
    return recipes.exclusive_prefixes(t("part"), "p_brand", F.regexp_extract("p_name", "^([A-Za-z]+)", 1))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS top FROM c GROUP BY 1)
SELECT g.o_custkey, n_rows, max(c.o_orderstatus) AS main_code, CAST(n_rows - top AS BIGINT) AS n_other FROM g JOIN c ON c.o_custkey = g.o_custkey AND c.n = g.top GROUP BY 1, 2, top HAVING n_rows - top > 0 AND n_rows - top <= 0.2 * n_rows""")
def minority_codes(t):
    return recipes.minority_codes(t("orders"), "o_custkey", "o_orderstatus")


@query("""SELECT * FROM (SELECT l_suppkey, l_partkey, weight, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS weight FROM lineitem GROUP BY 1, 2)) WHERE rank <= 4""")
def entity_graph_links(t):
    return recipes.relation_links(t("lineitem"), "l_suppkey", "l_partkey", "l_extendedprice")


# time
@query("""WITH r AS (SELECT DISTINCT CAST(ts AS DATE) AS d, user_id AS k FROM events), s AS (SELECT d, count(*) AS n, row_number() OVER (ORDER BY d) AS i FROM r GROUP BY 1)
SELECT strftime(s.d, '%Y-%m-%d') AS day, s.n AS n_keys, round(b / (s.n + p.n - b), 6) AS jaccard FROM s JOIN s p ON p.i = s.i - 1, LATERAL (SELECT count(*) AS b FROM r x JOIN r y ON x.k = y.k AND x.d = s.d AND y.d = p.d)""")
def snapshot_panel(t):
    return timeline.snapshot_overlap(t("events"), F.to_date("ts"), "user_id")


@query("SELECT gap_days, count(*) AS n FROM (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap_days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE gap_days IS NOT NULL GROUP BY 1")
def cadence_orders(t):
    return timeline.cadence(t("orders"), F.to_date("o_orderdate"))


@query("""WITH m AS (SELECT DISTINCT user_id AS g, event_type AS c, CAST(ts AS DATE) AS m FROM events), a AS (SELECT DISTINCT g, m FROM m), f AS (SELECT g, c, min(m) AS s FROM m GROUP BY 1, 2)
SELECT f.g AS grp, f.c AS code, strftime(f.s, '%Y-%m-%d') AS start, count(*) FILTER (a.m < f.s) AS n_before, count(*) FILTER (a.m >= f.s) AS n_after FROM f JOIN a USING (g) GROUP BY f.g, f.c, f.s HAVING count(*) FILTER (a.m < f.s) >= 3""")
def onset_event_type(t):
    return timeline.onsets(t("events"), "user_id", "event_type", F.to_date("ts"))


@query("SELECT o_orderstatus AS value, count(*) AS n_rows, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def succession_status(t):
    return timeline.value_spans(t("orders"), "o_orderstatus", F.to_date("o_orderdate"))


@query("""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) FILTER (l_linestatus = 'F') AS o, count(*) FILTER (l_linestatus <> 'F') AS n FROM lineitem GROUP BY 1),
w AS (SELECT d, coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(o) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM d)
SELECT strftime(d, '%Y-%m-%d') AS day, CAST(x AS BIGINT) AS n_wrong FROM w ORDER BY x, d LIMIT 1""")
def switch_day(t):
    return timeline.switch_day(t("lineitem"), F.to_date("l_shipdate"), F.col("l_linestatus") == "F")


@query("""WITH s AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) - 1e6 AS v FROM orders GROUP BY 1)
SELECT round(min(v), 2) AS least, strftime(arg_min(p, v), '%Y-%m') AS least_period, strftime(max(p), '%Y-%m') AS last_period, strftime(min(p) FILTER (v < 0), '%Y-%m') AS first_below_zero, count(*) AS n_periods FROM s""")
def series_low_point(t):
    monthly = t("orders").groupBy(F.trunc("o_orderdate", "month").alias("p")).agg((F.sum("o_totalprice") - 1e6).alias("v"))
    return timeline.series_facts(monthly, F.col("p"), "v")


# rules
_SUMS = "count(*) AS n_rows, round(sum(o_totalprice), 2) AS total"


def _totals(df):
    return df.agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT {_SUMS} FROM orders WHERE NOT (o_orderstatus = 'F')")
def rule_exclude(t):
    return _totals(apply_rules(t("orders"), [Rule("exclude", "o_orderstatus = 'F'")]))


@query(f"SELECT {_SUMS} FROM orders WHERE o_totalprice > 1000")
def rule_filter(t):
    return _totals(apply_rules(t("orders"), [Rule("filter", "o_totalprice > 1000")]))


# blank keys, and keys that differ in case and blanks only
@query(f"""WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN ' Buyer ' || o_custkey || '.' ELSE 'buyer  ' || o_custkey END AS buyer FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) AS rn FROM o WHERE buyer IS NOT NULL)
SELECT {_SUMS} FROM (SELECT o_totalprice FROM k WHERE o_orderstatus <> 'F' OR rn = 1 UNION ALL SELECT o_totalprice FROM o WHERE buyer IS NULL)""")
def rule_dedupe(t):
    buyer = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" Buyer "), "o_custkey", F.lit("."))).otherwise(F.concat(F.lit("buyer  "), "o_custkey"))
    return _totals(apply_rules(t("orders").withColumn("buyer", buyer), [Rule("dedupe", "o_orderstatus = 'F'", args={"key": ["buyer"], "order": ["o_orderkey"]})]))


@query("""SELECT v AS value, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 1 THEN coalesce(last_value(CASE WHEN o_orderkey % 3 <> 1 AND x <> ' ' THEN x END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x) ELSE x END AS v
FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN ' ' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS x FROM orders)) GROUP BY 1""")
def rule_fill(t):
    k = F.col("o_orderkey")
    value = F.when((k % 3 == 2) & (k % 2 == 0), " ").when((k % 3 == 1) & (k % 2 == 0), None).otherwise(F.col("o_orderpriority"))
    d = t("orders").select("o_custkey", "o_orderkey", value.alias("value"))
    return apply_rules(d, [Rule("fill", "o_orderkey % 3 = 1", "value", {"key": ["o_custkey"], "order": ["o_orderkey"]})]).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def rule_map(t):
    return apply_rules(t("orders"), [Rule("map", column="o_orderstatus", args={"values": {"F": "finished", "O": "open"}})]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice - o_totalprice * 0.1 ELSE o_totalprice END), 2) AS total FROM orders")
def rule_adjust(t):
    return _totals(apply_rules(t("orders"), [Rule("adjust", "o_orderstatus = 'O'", "o_totalprice", {"less": "o_totalprice * 0.1"})]))


@query("SELECT count(*) AS n_rows, round(sum(CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN o_totalprice / 1000 ELSE o_totalprice END), 2) AS total FROM orders")
def rule_scale(t):
    return _totals(apply_rules(t("orders"), [Rule("scale", "o_orderdate < '1995-01-01'", "o_totalprice", {"by": 1000})]))


@query("""WITH e AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_custkey, o_orderkey + 10000000, -o_totalprice FROM orders WHERE o_orderkey % 7 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, round(abs(o_totalprice), 2), o_totalprice < 0 ORDER BY o_orderkey) AS rn, sum(CAST(o_totalprice < 0 AS INT)) OVER w AS m, sum(CAST(o_totalprice >= 0 AS INT)) OVER w AS o FROM e WINDOW w AS (PARTITION BY o_custkey, round(abs(o_totalprice), 2)))
SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM r WHERE rn > least(m, o)""")
def rule_pair(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    back = o.filter("o_orderkey % 7 = 0").select("o_custkey", F.col("o_orderkey") + 10_000_000, -F.col("o_totalprice"))
    return _totals(apply_rules(o.union(back), [Rule("pair", "o_totalprice < 0", args={"key": ["o_custkey"], "amount": "o_totalprice", "order": ["o_orderkey"]})]))


@query(f"SELECT 'orders' AS metric, {_SUMS} FROM orders UNION ALL SELECT 'revenue', {_SUMS} FROM orders WHERE o_orderstatus <> 'F'")
def rule_scope_metric(t):
    rules = [Rule("exclude", "o_orderstatus = 'F'", metrics=("revenue",))]
    return _totals(apply_rules(t("orders"), rules, "orders")).select(F.lit("orders").alias("metric"), "*").union(_totals(apply_rules(t("orders"), rules, "revenue")).select(F.lit("revenue").alias("metric"), "*"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_rows, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS amount, round(sum(abs(o_totalprice)) FILTER (o_orderstatus = 'F') / sum(abs(o_totalprice)), 6) AS share FROM orders")
def rule_effects(t):
    return rule_effect(t("orders"), Rule("exclude", "o_orderstatus = 'F'"), "o_totalprice")


# freshness and graphs
_HALVES = "o AS (SELECT * FROM events WHERE event_id % 3 <> 0), n AS (SELECT * FROM events WHERE event_id % 3 <> 1)"


@query(f"""WITH {_HALVES}, g AS (SELECT 'gone' AS kind FROM (SELECT event_id FROM o EXCEPT SELECT event_id FROM n) UNION ALL SELECT 'new' FROM (SELECT event_id FROM n EXCEPT SELECT event_id FROM o)) SELECT kind, count(*) AS n_values FROM g GROUP BY 1""")
def new_gone_values(t):
    e = t("events")
    return fresh.value_changes(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 <> 1"), "event_id")


@query("""SELECT 'event_type' AS "column", count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(event_type), 1, 12)) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM events
UNION ALL SELECT 'user_id', count(*), CAST(sum(CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 12)) AS HUGEINT)) AS VARCHAR) FROM events""")
def fingerprint_columns(t):
    return fresh.column_fingerprints(t("events"), ["event_type", "user_id"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, (p_size * 3 + 1) % 53 AS dst FROM part UNION SELECT DISTINCT p_size, (p_size + 7) % 53 FROM part WHERE p_size % 2 = 0),
r AS (SELECT 1 AS start, dst AS node, 1 AS steps FROM e WHERE src = 1 UNION SELECT 1, e.dst, r.steps + 1 FROM r JOIN e ON e.src = r.node WHERE r.steps < 60)
SELECT start, node, min(steps) AS steps FROM r GROUP BY 1, 2""")
def formula_reach(t):
    p = t("part").select("p_size").distinct()
    edges = p.select(F.col("p_size").alias("src"), ((F.col("p_size") * 3 + 1) % 53).alias("dst")).union(p.filter("p_size % 2 = 0").select("p_size", (F.col("p_size") + 7) % 53))
    return graph.downstream(edges, t("region").filter("r_regionkey = 1").select(F.lit(1).alias("start")))


@query("""SELECT lower(trim(p_type)) AS k, count(*) AS n FROM part GROUP BY 1""")
def normal_keys(t):
    return t("part").groupBy(norm_text(F.col("p_type")).alias("k")).agg(F.count("*").alias("n"))


# evidence about columns
@query("""SELECT o_orderpriority AS value, count(*) AS n_rows, round(sum(o_totalprice), 2) AS amount, round(sum(abs(o_totalprice)), 2) AS absolute,
strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1""")
def value_stats_priority(t):
    return evidence.value_stats(t("orders"), "o_orderpriority", "o_totalprice", "o_orderdate")


@query("""SELECT count(DISTINCT n_nationkey) AS n_a, count(DISTINCT n_name) AS n_b, count(DISTINCT (n_nationkey, n_name)) AS n_pairs,
count(DISTINCT (n_nationkey, n_name)) = count(DISTINCT n_nationkey) AND count(DISTINCT (n_nationkey, n_name)) = count(DISTINCT n_name) AS is_one_to_one FROM nation""")
def one_to_one_nation(t):
    return evidence.one_to_one(t("nation"), "n_nationkey", "n_name")


@query("SELECT count(*) FILTER (l_discount = 0) AS n_hit, round(sum(CASE WHEN l_discount = 0 THEN abs(l_extendedprice) ELSE 0 END) / sum(abs(l_extendedprice)), 6) AS stake FROM lineitem")
def row_stake_undiscounted(t):
    return evidence.row_stake(t("lineitem"), F.col("l_discount") == 0, "l_extendedprice")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_rows, round(sum(l_extendedprice * (1 - l_discount)), 2) AS amount FROM lineitem GROUP BY 1")
def monthly_revenue(t):
    return evidence.monthly_totals(t("lineitem"), "l_shipdate", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query(" UNION ALL ".join(f"SELECT '{w}' AS product, '{a}' AS a, '{b}' AS b, count(*) FILTER (abs({a} * {b} - {w}) <= 0.0051) AS n_equal FROM lineitem" for w, a, b in (
    ("l_quantity", "l_discount", "l_tax"), ("l_discount", "l_quantity", "l_tax"), ("l_tax", "l_quantity", "l_discount"))))
def products_lineitem(t):
    return evidence.products_of(t("lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("SELECT regexp_extract(p_name, '^[A-Za-z]+') AS prefix, count(*) AS n_rows, count(DISTINCT p_name) AS n_values FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING prefix <> '' AND count(*) >= 3")
def prefix_families_part(t):
    return evidence.prefix_families(t("part"), "p_name")


@query("""SELECT CASE WHEN l_shipdate < TIMESTAMP '1995-06-01' THEN 'before' ELSE 'after' END AS side, count(*) AS n_rows,
round(avg(CASE WHEN l_extendedprice = floor(l_extendedprice) THEN 1.0 ELSE 0.0 END), 6) AS whole_share, count(DISTINCT l_extendedprice) AS n_values,
percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice DESC) AS median FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1""")
def profile_change_price(t):
    return evidence.profile_change(t("lineitem"), "l_shipdate", "1995-06-01", "l_extendedprice")


@query("""SELECT weekday, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(n) / sum(sum(n)) OVER (), 6) AS share
FROM (SELECT CAST(isodow(CAST(ts AS DATE)) - 1 AS INTEGER) AS weekday, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def weekday_rows_events(t):
    return evidence.weekday_rows(t("events"), "ts")


@query("""WITH n AS (SELECT strftime(ts, '%Y-%m-%d %H') AS block, count(*) AS n_rows FROM events GROUP BY 1)
SELECT block, n_rows FROM n WHERE n_rows >= 1.8 * (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY n_rows DESC) FROM n)""")
def double_blocks_events(t):
    return evidence.double_blocks(t("events"), F.date_format("ts", "yyyy-MM-dd HH"))


@query("""SELECT 'debit' AS a, 'credit' AS b, count(*) FILTER (debit < 0 OR credit < 0) AS n_negative, count(*) FILTER (debit <> 0 AND credit <> 0) AS n_both, count(*) FILTER (debit <> 0 OR credit <> 0) AS n_either
FROM (SELECT greatest(c_acctbal, 0) AS debit, greatest(-c_acctbal, 0) AS credit FROM customer)""")
def side_pairs_customer(t):
    sides = t("customer").select(F.greatest("c_acctbal", F.lit(0.0)).alias("debit"), F.greatest(-F.col("c_acctbal"), F.lit(0.0)).alias("credit"))
    return evidence.side_pairs(sides, ["debit", "credit"])


@query("SELECT lower(c_mktsegment) AS value, count(*) AS n_rows FROM customer WHERE c_custkey % 2 = 0 AND lower(c_mktsegment) <> c_mktsegment GROUP BY 1")
def join_variants_segment(t):
    """Half of the customers with their segment in lower case against the segments as they are spelled."""
    c = t("customer")
    left = c.select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"))
    return evidence.join_variants(left, c, "segment", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_filled, count(*) FILTER (regexp_matches({c}, '^\\s*[-+]?[0-9][0-9,]*(\\.[0-9]+)?\\s*$')) AS n_numbers FROM part" for c in ("p_name", "p_brand", "p_type")))
def numbers_as_text_part(t):
    return evidence.numbers_as_text(t("part"), ["p_name", "p_brand", "p_type"])


@query("SELECT event_type, count(*) AS n_rows, round(sum(value), 2) AS amount FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1")
def latest_totals_events(t):
    return evidence.latest_totals(t("events"), "ts", "event_type", "value")


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{a}' AS start, '{z}' AS \"end\", count(*) FILTER ({a} IS NOT NULL AND {z} IS NOT NULL) AS n_rows, count(*) FILTER ({z} >= {a}) AS n_ordered FROM (SELECT l_shipdate AS shipped, l_shipdate + INTERVAL 3 DAY AS received FROM lineitem)) WHERE n_rows > 0 AND n_ordered >= 0.95 * n_rows"
                         for a, z in (("shipped", "received"), ("received", "shipped"))))
def window_columns_lineitem(t):
    return evidence.window_columns(t("lineitem").select(F.col("l_shipdate").alias("shipped"), F.expr("l_shipdate + INTERVAL 3 DAYS").alias("received")), ["shipped", "received"])


@query("""SELECT status, n_rows, n_blank, n_rows = n_blank AND n_blank = sum(n_blank) OVER () AND n_rows >= 5 AS lines_up FROM (
SELECT o_orderstatus AS status, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_blank FROM orders GROUP BY 1)""")
def status_lines_up_orders(t):
    """Order dates made blank where the status is F."""
    return evidence.status_lines_up(t("orders").withColumn("paid", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))), "o_orderstatus", "paid")


@query("SELECT user_id, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS n_periods, count(*) AS n_rows FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING n_periods >= 3 AND count(*) FILTER (event_type = 'purchase' AND value > 150) = 0")
def never_credited_users(t):
    return evidence.never_credited(t("events"), "user_id", F.date_format("ts", "yyyy-MM-dd"), (F.col("event_type") == "purchase") & (F.col("value") > 150))


@query("""WITH m AS (SELECT l_linenumber, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity DESC) AS quantity, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice DESC) AS price FROM lineitem GROUP BY 1)
SELECT l_linenumber, quantity, price, coalesce((SELECT bool_and(m.quantity * 3 <= o.quantity AND m.price >= 1.5 * o.price) FROM m o WHERE o.l_linenumber <> m.l_linenumber), false) AS other_unit FROM m""")
def unit_groups_lineitem(t):
    return evidence.unit_groups(t("lineitem"), "l_linenumber", "l_quantity", "l_extendedprice")


@query("""WITH u AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 40), s AS (SELECT p_type, min(p_partkey) AS live_code FROM part WHERE p_partkey IN (SELECT k FROM u) GROUP BY 1)
SELECT p_partkey AS code, live_code FROM part JOIN s USING (p_type) WHERE p_partkey NOT IN (SELECT k FROM u)""")
def stale_codes_part(t):
    """Parts without a large line whose type a part with one has."""
    return evidence.stale_codes(t("part"), t("lineitem").filter("l_quantity >= 40"), "p_partkey", "p_type", "l_partkey")


# column roles and keys
_ROLE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "priority_code", "warehouse"]
_ROLES = """SELECT '{c}' AS "column", count({c}) AS n_filled, count(DISTINCT {c}) AS n_distinct, {few} AND {codes_or_text} AS groups, {few} AND {codes} AS codes, {ids} AS document_numbers FROM o"""


def _roles_sql():
    parts = []
    for c, number, code in (("o_orderkey", True, True), ("o_custkey", True, True), ("o_orderstatus", False, False), ("o_orderpriority", False, False), ("priority_code", True, True), ("warehouse", True, False)):
        few = f"(count(DISTINCT {c}) BETWEEN 2 AND 30 AND count({c}) >= 10 * count(DISTINCT {c}))"
        width = f"(min(length(CAST({c} AS VARCHAR))) = max(length(CAST({c} AS VARCHAR))) AND min(length(CAST({c} AS VARCHAR))) >= 3)"
        codes = "false" if not number else "true" if code else width
        ids = f"count(DISTINCT {c}) >= 0.9 * count({c})" if number else "false"
        parts.append(_ROLES.format(c=c, few=few, codes=codes, codes_or_text=codes if number else "true", ids=ids))
    return "WITH o AS (SELECT *, o_orderkey % 7 AS priority_code, 100 + o_orderkey % 12 AS warehouse FROM orders) " + " UNION ALL ".join(parts)


@query(_roles_sql())
def column_roles(t):
    o = t("orders").withColumns({"priority_code": F.col("o_orderkey") % 7, "warehouse": 100 + F.col("o_orderkey") % 12})
    return roles.column_roles(o, _ROLE_COLUMNS)


@query("""SELECT 'l_extendedprice' AS "column", round(abs(sum(l_extendedprice)), 2) AS total FROM lineitem""")
def money_column_lineitem(t):
    return roles.money_column(t("lineitem"), ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"])


@query("""WITH m AS (SELECT o_totalprice * (CASE WHEN o_orderkey % 2 = 0 THEN 100.5 ELSE -100.5 END) AS moved, o_totalprice FROM orders), s AS (SELECT 'moved' AS "column", round(abs(sum(moved)), 2) AS total FROM m UNION ALL SELECT 'o_totalprice', round(abs(sum(o_totalprice)), 2) FROM m)
SELECT * FROM s ORDER BY total DESC, "column" LIMIT 1""")
def money_column_balanced(t):
    """A column of large sums to and fro against one that adds up."""
    moved = F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 100.5).otherwise(-100.5)
    return roles.money_column(t("orders").withColumn("moved", moved), ["moved", "o_totalprice", "o_orderkey"])


@query("SELECT 'l_orderkey,l_partkey' AS columns, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS extra FROM lineitem")
def smallest_key_lineitem(t):
    return lattice.table_key(t("lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])


# every hundredth customer is there twice
@query("SELECT 'c_custkey' AS columns, count(*) FILTER (c_custkey % 200 = 0) AS extra FROM customer")
def near_key_customer(t):
    c = t("customer")
    return lattice.table_key(c.union(c.filter("c_custkey % 200 = 0")), ["c_custkey", "c_nationkey", "c_mktsegment"])


# one flag follows the list throughout, one from a day on, one with exceptions
@query("""WITH l AS (SELECT l_returnflag AS g, strftime(l_shipdate, '%Y-%m') AS m, CASE
  WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_shipdate >= TIMESTAMP '1995-06-01') OR (l_returnflag = 'R' AND l_orderkey % 20 <> 0) THEN 1 ELSE 0 END AS hit FROM lineitem),
c AS (SELECT g, m, count(*) AS n, sum(hit) AS hit FROM l GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER w AS nl, sum(hit) OVER w AS nh, count(*) OVER w AS nm FROM c WINDOW w AS (PARTITION BY g ORDER BY m DESC)),
f AS (SELECT g, min(m) AS m FROM r WHERE 2 * hit >= n AND 10 * nh >= 9 * nl GROUP BY 1)
SELECT lower(g) AS "group", m AS since, nm AS n_months, CAST(nl AS BIGINT) AS n_lines, CAST(nh AS BIGINT) AS n_at FROM r JOIN f USING (g, m) WHERE nm >= 3 AND nl >= 10""")
def price_conformity(t):
    kept = F.expr("l_returnflag = 'A' or (l_returnflag = 'N' and l_shipdate >= '1995-06-01') or (l_returnflag = 'R' and l_orderkey % 20 <> 0)")
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("list"))
    lines = t("lineitem").join(p, "l_partkey").withColumn("price", F.when(kept, F.col("list")).otherwise(F.col("list") * 1.5))
    return roles.conformity_runs(lines, "l_returnflag", "l_shipdate", "price", "list")


# each order's goods, a tax of 7.25 % of them, and a fee that follows nothing
@query("""WITH g AS (SELECT l_orderkey AS doc, 'goods' AS cat, l_extendedprice AS v FROM lineitem), s AS (SELECT doc, round(sum(v), 2) AS goods FROM g GROUP BY 1),
l AS (SELECT * FROM g UNION ALL SELECT doc, CASE WHEN doc % 2 = 0 THEN 'Tax ' ELSE 'tax' END, round(goods * 0.0725, 2) FROM s UNION ALL SELECT doc, 'fee', -1.0 - doc % 5 FROM s),
c AS (SELECT doc, sign(v) AS sg, lower(trim(cat)) AS cat, sum(v) AS v, count(*) AS n FROM l GROUP BY 1, 2, 3),
r AS (SELECT cat, n, v, round(sum(v) OVER (PARTITION BY doc, sg) - v, 2) AS d FROM c),
m AS (SELECT * FROM r WHERE n = 1 AND d <> 0),
q AS (SELECT cat, greatest(0, least(1, round(v / d, 5))) AS ratio, row_number() OVER (PARTITION BY cat ORDER BY greatest(0, least(1, round(v / d, 5)))) AS i, count(*) OVER (PARTITION BY cat) AS nr FROM m),
t AS (SELECT cat, nr, ratio AS r5, round(ratio, 4) AS r4 FROM q WHERE i = nr // 2 + 1 AND nr >= 20 AND ratio > 0 AND ratio <= 0.5),
h AS (SELECT cat, nr, r4, r5, count(*) FILTER (abs(v - round(d * r4, 2)) <= 0.011) AS h4, count(*) FILTER (abs(v - round(d * r5, 2)) <= 0.011) AS h5 FROM m JOIN t USING (cat) GROUP BY ALL)
SELECT cat AS category, CASE WHEN h4 >= h5 THEN r4 ELSE r5 END AS rate, nr AS n_records, greatest(h4, h5) AS n_hits FROM h WHERE greatest(h4, h5) >= 0.9 * nr""")
def fixed_ratio_tax(t):
    goods = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("goods").alias("cat"), F.col("l_extendedprice").alias("v"))
    sums = goods.groupBy("doc").agg(F.round(F.sum("v"), 2).alias("goods"))
    tax = sums.select("doc", F.when(F.col("doc") % 2 == 0, "Tax ").otherwise("tax"), F.round(F.col("goods") * 0.0725, 2))
    fee = sums.select("doc", F.lit("fee"), -1.0 - F.col("doc") % 5)
    return ledger.fixed_ratio(goods.union(tax).union(fee), "doc", "cat", "v")


# queries of other modules register themselves
from tidemark.plans import detectors, structure  # noqa: E402, F401
