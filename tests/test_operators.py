from pyspark.sql import functions as F

from tidemark.functions.keys import norm_text, parse_number
from tidemark.operators import fresh, graph, joins, keys, lattice, ledger, recipes, roles
from tidemark.operators.rules import Rule, apply_rules


def test_norm_text(spark):
    d = spark.createDataFrame([(" A  b.,", "a b"), ("007", "7"), ("000", "0"), ("  ", None), (None, None), ("x;", "x")], "t string, want string")
    assert d.filter(~norm_text(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_parse_number_refuses_codes(spark):
    d = spark.createDataFrame([("0042", None), ("0.5", 0.5), ("(1,000)", -1000.0), ("7%", 0.07), ("", None), (None, None)], "t string, want double")
    assert d.filter(~parse_number(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_downstream_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    rows = {(r["node"], r["steps"]) for r in graph.downstream(edges, spark.createDataFrame([(1,)], "start int")).collect()}
    assert rows == {(2, 1), (3, 2), (1, 3), (4, 3)}


def test_rules_in_order_and_by_metric(spark):
    d = spark.createDataFrame([(1, "a", 10.0), (2, "a", -10.0), (3, "b", 5.0), (4, None, 7.0)], "id int, k string, x double")
    rules = [Rule("pair", "x < 0", args={"key": ["k"], "amount": "x", "order": ["id"]}), Rule("exclude", "k = 'b'", metrics=("m",))]
    assert [r["id"] for r in apply_rules(d, rules).orderBy("id").collect()] == [3, 4]
    assert [r["id"] for r in apply_rules(d, rules, "m").collect()] == [4]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "a long, b long")
    assert recipes.duplicates(d, ["a"]).first()["n_values"] == 0
    assert keys.near_key(d, ["a"]).count() == 0 and recipes.pareto(d, "a", "b").count() == 0
    assert fresh.value_changes(d, d, "a").count() == 0


def test_schema_changes(spark):
    a, b = spark.createDataFrame([], "x int, y int"), spark.createDataFrame([], "y string, z int")
    assert fresh.schema_changes(a, b) == {"added": ["z"], "removed": ["x"], "retyped": ["y"]}


def test_reference_price_takes_one_version(spark):
    ref = spark.createDataFrame([(1, "2000-01-01", "2000-06-30", 1.0), (1, "2000-06-01", "2000-12-31", 2.0), (1, "2001-01-01", None, 3.0), (1, None, "1999-12-31", 4.0),
                                 (2, "2000-01-01", None, 5.0), (2, "2000-01-01", None, None), (3, "2000-01-01", "2000-12-31", 6.0), (3, "2000-01-01", "2000-12-31", 7.0)], "k int, a string, z string, p double")
    want = [(1, "2000-06-15", 1.0), (1, "2000-06-15", 1.0), (1, "2000-07-01", 2.0), (1, "2005-01-01", 3.0), (1, "1990-01-01", 4.0), (1, None, None),
            (2, "1990-01-01", 5.0), (2, None, 5.0), (3, "2000-05-05", 6.0), (3, "2001-01-01", None), (4, "2000-05-05", None), (None, "2000-05-05", None)]
    lines = spark.createDataFrame(want, "k int, d string, want double")
    got = joins.reference_price(lines, ref, "k", "d", "a", "z", "p")
    assert got.columns == ["k", "d", "want", "reference"] and got.count() == len(want)
    assert got.filter("not reference <=> want").count() == 0


def test_roles_keys_and_runs(spark):
    rows = [(i, f"c{i % 3}", 100 + i % 2, i + 0.25, None, "x") for i in range(60)] + [(None, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_no long, kind string, branch int, amount double, none string, extra string")
    got = {r["column"]: (r["groups"], r["codes"], r["document_numbers"]) for r in roles.column_roles(df, ["doc_no", "kind", "branch", "amount", "none"]).collect()}
    assert got == {"doc_no": (False, False, True), "kind": (True, False, False), "branch": (True, True, False), "amount": (False, False, False)}
    assert [tuple(r) for r in roles.money_column(df, ["doc_no", "branch", "amount", "kind"]).collect()] == [("amount", 1785.0)]
    assert roles.money_column(df.limit(0), ["amount"]).count() == 0 and roles.money_column(df, ["kind"]).count() == 0
    pairs = spark.createDataFrame([(a, b, c) for a in range(5) for b in range(5) for c in range(5)], "a_no int, b_no int, c_no int")
    assert [tuple(r) for r in lattice.table_key(pairs, ["a_no", "b_no", "c_no"]).collect()] == [("a_no,b_no,c_no", 0)]
    assert lattice.table_key(pairs.union(pairs), ["a_no", "b_no", "c_no"]).count() == 0 and lattice.table_key(pairs.limit(0), ["a_no"]).count() == 0
    lines = spark.createDataFrame([("A ", f"2024-0{1 + i % 6}-01", 2.0 if i % 6 > 1 else 3.0, 2.0) for i in range(30)] + [(None, "2024-01-01", 2.0, 2.0), ("b", None, 2.0, 2.0), ("b", "2024-01-01", 2.0, None)], "m string, at string, p double, r double")
    assert [tuple(r) for r in roles.conformity_runs(lines, "m", "at", "p", "r").collect()] == [("a", "2024-03", 4, 20, 20)]


def test_rules_with_blanks_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "A", "x", 5.0, 0), (2, " a.", " ", -5.0, 0), (3, None, None, 5.0, 0), (4, None, "y", None, 0)], "i int, k string, v string, amount double, _rule0 int")
    kept = apply_rules(df, [Rule("dedupe", args={"key": ["k"], "order": ["i"]})])
    assert kept.columns == df.columns and sorted(r["i"] for r in kept.collect()) == [1, 3, 4]
    filled = apply_rules(df, [Rule("fill", "i > 1", "v", {"key": ["_rule0"], "order": ["i"]})])
    assert {r["i"]: r["v"] for r in filled.collect()} == {1: "x", 2: "x", 3: "x", 4: "x"}
    paired = apply_rules(df, [Rule("pair", "amount < 0", args={"key": ["k"], "amount": "amount", "order": ["i"]})])
    assert sorted(r["i"] for r in paired.collect()) == [3, 4]
    assert apply_rules(df.limit(0), [Rule("dedupe", args={"key": ["k"], "order": ["i"]})]).count() == 0


def test_fixed_ratio(spark):
    rows = [(f"d{i}", c, v) for i in range(30) for c, v in (("net", 100.0 + i), ("VAT", round((100.0 + i) * 0.2, 2)), ("tip", float(i % 7)), ("back", -5.0))]
    rows += [(None, "vat", 1.0), ("d1", None, 1.0), ("x", "vat", None), ("y", "vat", 3.0)]
    df = spark.createDataFrame(rows, "doc string, cat string, v double")
    got = [tuple(r) for r in ledger.fixed_ratio(df.filter("cat <> 'tip'"), "doc", "cat", "v").collect()]
    assert got == [("vat", 0.2, 30, 30)]
    assert ledger.fixed_ratio(df, "doc", "cat", "v").count() == 0 and ledger.fixed_ratio(df.limit(0), "doc", "cat", "v").count() == 0
