"""What keeps queries of large tables small: counts that stay right, and plans without the steps that grew too fast."""

import datetime as dt
import random
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.functions.keys import TWO_MARKS, parse_date
from tidemark.operators import changes, fresh, joins, keys, lattice, oddities, profile


def plan(df):
    return df._jdf.queryExecution().toString()


def test_key_candidates_are_brute_force_without_expanded_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(300) if i % 50 else None, rng.randrange(60), rng.randrange(4), i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "a long, b int, c int, d int")
    want = {",".join("abcd"[i] for i in s): len({tuple(r[i] for i in s) for r in rows}) for k in (1, 2, 3) for s in combinations(range(4), k)}
    for few in (1_000_000, 0):  # repeated combinations sent to tasks, or all rows counted again
        monkeypatch.setattr(keys, "FEW_REPEATED", few, raising=False)
        got = keys.key_candidates(df, list("abcd"), most=3)
        assert {r["columns"]: (r["n_rows"], r["n_distinct"], r["is_key"]) for r in got.collect()} == {s: (900, d, d == 900) for s, d in want.items()}
        assert "Expand" not in plan(got)
    unique = spark.createDataFrame([(i, i % 3) for i in range(20)], "a int, b int")
    assert {r["columns"]: r["is_key"] for r in keys.key_candidates(unique, ["a", "b"]).collect()} == {"a": True, "b": False, "a,b": True}
    assert all(r["n_rows"] == 0 == r["n_distinct"] for r in keys.key_candidates(df.limit(0), ["a", "b"]).collect())


def below_counts(df):
    """The optimized plan beneath its deepest aggregation: what is done with every row."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return "\n".join(lines[max(i for i, x in enumerate(lines) if "Aggregate" in x) + 1 :])


def test_groups_are_combined_before_values_are_rewritten(spark):
    rows = [(g, f" Item {i % 3}" if i % 2 else f"item {i % 3}", float(i)) for i, g in enumerate(["A x", "a  x", "B.", "b", None, " "] * 20)]
    df = spark.createDataFrame(rows, "g string, c string, v double")
    counts = oddities.grouped_counts(df, ["g"], {}, {"n": F.lit(1), "v": F.col("v")})
    want = {k: sum(r[2] for r in rows if r[0] in of) for k, of in (("a x", ("A x", "a  x")), ("b", ("B.", "b")))}
    assert {r["value"]: (r["n"], r["v"]) for r in counts.collect()} == {k: (40, v) for k, v in want.items()}
    values = oddities._values_of(df, ["g", "c"], ["c"])
    assert {(r["grouping"], r["value"], r["x"]): r["c"] for r in values.filter("value = 'b'").collect()} == {("g", "b", f"item {k}"): sum(r[0] in ("B.", "b") and r[1].strip().lower() == f"item {k}" for r in rows) for k in (0, 2)}
    for df in (counts, values):
        assert "regexp" not in below_counts(df)


def test_days_are_counted_before_forms_are_told(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 5), ["One", "one ", "2024-01-02", "A-12", None][i % 5 if i % 3 else 0], float(i % 3 - 1), f"C-{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "day timestamp_ntz, p string, v double, many string")
    hist = {(r["column"], r["view"], r["value"]): r["n"] for r in changes.day_histogram(df, "day", ["p", "v", "many"], ["v"]).groupBy("column", "view", "value").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    texts = [r[1] for r in rows if r[1] is not None]
    assert hist["many", "form", "id:C-#"] == 3000 and hist["p", "form", "text date"] == texts.count("2024-01-02") and hist["p", "label", "one"] == sum(x.strip().lower() == "one" for x in texts)
    assert hist["v", "sign", "positive"] == 1000 == hist["v", "sign", "negative"] and hist["p", "form", "blank"] == 3000 - len(texts)


def test_dates_are_tried_only_where_one_may_stand(spark):
    texts = ["2024-01-05", "2024/02/03 ", "05 Jan 2024", "Jan 5, 2024", "13/04/2024", "04/05/2024", "C-100123", "4-NOT SPECIFIED", "2024-02-30", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    days = [str(r[0]) if r[0] else None for r in df.select(parse_date(F.col("t"))).collect()]
    assert days == ["2024-01-05", "2024-02-03", "2024-01-05", "2024-01-05", "2024-04-13", None, None, None, None, None]
    assert [r[0] for r in df.filter(F.col("t").rlike(TWO_MARKS)).collect()] == [*texts[:6], "2024-02-30"]


def test_histogram_counts_values_before_they_are_written_as_text(spark):
    df = spark.createDataFrame([(" A  b" if i % 2 else "a B.", i % 3, 0.0 if i % 2 else -0.0, None, dt.datetime(2024, 1, 1 + i % 2, 5)) for i in range(12)], "s string, i int, d double, e string, t timestamp_ntz")
    hist = profile.histogram(df, df.columns)
    assert {(r["column"], r["k"]): r["n"] for r in hist.collect()} == {("s", "a b"): 12, ("i", "0"): 4, ("i", "1"): 4, ("i", "2"): 4, ("d", "0.0"): 12, ("t", "2024-01-01 05:00:00"): 6, ("t", "2024-01-02 05:00:00"): 6}
    below = below_counts(hist)
    assert "regexp" not in below and "Generate" not in below and "cast(" not in below


def test_near_key_counts_sets_without_multiplied_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lattice, "repeated_groups", lambda *a: seen.append(a))
    rows = [(i // 4, i % 4, f"item {i % 2}") for i in range(400)] + [(i // 4, i % 4, f"item {i % 2}") for i in range(20)] * 2
    df = spark.createDataFrame(rows, "doc_no long, line_no long, item string")
    assert lattice.near_key(df).collect() == [("doc_no,line_no", 40, 20)] and not seen  # groups come with the counts


def test_dependencies_work_out_each_key_once_a_row(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lattice, "staged", lambda df, tag: plans.append(plan(df)) or df)
    df = spark.createDataFrame([(f"Site {i % 60}", f"zone {i % 60 % 9}", f" Nation {i % 25}") for i in range(3000)], "site string, zone string, nation string")
    assert {(r["from"], r["to"], r["exceptions"], r["groups"]) for r in lattice.dependencies(df).collect()} == {("site", "zone", 0, 60)}
    optimized = plans[0].split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("lower(") == 3  # one for each column


def test_freshness_reads_values_of_columns_with_few_alone(spark, monkeypatch):
    asked, texts = [], fresh._texts
    monkeypatch.setattr(fresh, "_texts", lambda df, columns: asked.append(sorted(columns)) or texts(df, columns))
    old = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 60).alias("few"), (F.col("id") % 61).alias("more"), (F.col("id") % 4 * 0.5).alias("d"))
    new = old.filter("key > 0").withColumn("few", F.col("few") + 1).withColumn("more", F.col("more") + 1).withColumn("d", F.when(F.col("d") == 0, -0.0).otherwise(F.col("d")))
    got = {(r["kind"], r["column"]): (r["detail"], r["n"]) for r in fresh.freshness(old, new).collect()}
    assert got == {("rows", None): (None, -1), **{("changed", c): (None, None) for c in ("key", "few", "more", "d")}, ("new", "few"): ("60", 1), ("gone", "few"): ("0", 1), ("new", "d"): ("-0.0", 1), ("gone", "d"): ("0.0", 1)}
    assert asked == [["d", "few", "more"]] * 2


def test_windows_are_brute_force_with_a_stretch_a_line(spark):
    rng = random.Random(8)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    windows = [(rng.randrange(30), *(day(rng.randrange(90)) if rng.random() < 0.9 else None for _ in range(2))) for _ in range(70)] + [(None, day(1), day(2)), (40, day(50), day(10))]
    lines = [(rng.choice([*range(35), 40, None]), day(rng.randrange(-5, 95)) if rng.random() < 0.95 else None) for _ in range(3000)]
    keyed, want = {k for k, _, _ in windows if k is not None}, {}
    for k, d in lines:
        if k in keyed and d is not None:
            n, out = want.get(k, (0, 0))
            want[k] = n + 1, out + (not any(w == k and (a is None or a <= d) and (z is None or d <= z) for w, a, z in windows))
    df, w = spark.createDataFrame(lines, "k int, d date"), spark.createDataFrame(windows, "k int, a date, z date")
    found = joins.outside_windows(df, w, "k", "d", "a", "z")
    assert {r["k"]: (r["n_lines"], r["n_outside"]) for r in found.collect()} == {k: (n, o) for k, (n, o) in want.items() if o >= 5 and o >= 0.05 * n}
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.split("Join")[0].count("Aggregate") == 1  # nothing is counted by day once more after the join
