import datetime as dt
import random
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.operators import lattice, rowsets


def lines(n=600, repeats=0, seed=1):
    """Lines of documents; amounts and entry times differ in every row, but are no key."""
    rng, out = random.Random(seed), []
    for i in range(n):
        doc, line = i // 4, i % 4
        item = rng.randrange(40)
        out.append((round(rng.random() * 1e6, 2), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=977 * i), 5000 + doc, line, f"item {item}", f"group {item % 8}", dt.datetime(2024, 1, 1) + dt.timedelta(days=doc // 10), None))
    return out + out[:repeats]


SCHEMA = "amount double, uploaded_at timestamp, doc_no long, line_no long, item string, grp string, day timestamp, note string"


def test_semantics(spark):
    facts = {r["column"]: r for r in lattice.column_semantics(spark.createDataFrame(lines(), SCHEMA)).collect()}
    assert {c: r["semantic"] for c, r in facts.items()} == {"amount": "metric", "uploaded_at": "temporal", "doc_no": "identifier", "line_no": "identifier", "item": "dimension", "grp": "dimension", "day": "temporal", "note": "text"}
    assert {c for c, r in facts.items() if r["audit"]} == {"uploaded_at"} and facts["note"]["n_filled"] == 0
    assert lattice.date_axis(lattice.column_semantics(spark.createDataFrame(lines(), SCHEMA))).collect() == [("day",)]


def test_key_leaves_out_amounts_and_entry_times(spark):
    assert lattice.table_key(spark.createDataFrame(lines(), SCHEMA)).collect() == [("doc_no,line_no", 0)]
    assert lattice.table_key(spark.createDataFrame(lines(repeats=3), SCHEMA)).collect() == [("doc_no,line_no", 3)]
    assert lattice.table_key(spark.createDataFrame(lines(), SCHEMA).limit(0)).collect() == []
    single = spark.createDataFrame([(float(i), f"A{i:04}", i % 7) for i in range(300)], "amount double, code string, k int")
    assert lattice.table_key(single).collect() == [("code", 0)]
    assert lattice.table_key(spark.createDataFrame([(1.5,), (2.5,)], "amount double")).collect() == []


def test_near_key_and_its_groups(spark):
    df = spark.createDataFrame(lines(repeats=40), SCHEMA)
    assert lattice.near_key(df).collect() == [("doc_no,line_no", 40, 40)]
    groups = lattice.repeated_groups(df, ["doc_no", "line_no"]).collect()
    assert len(groups) == 40 and all(r["n_rows"] == 2 for r in groups)
    assert lattice.near_key(spark.createDataFrame(lines(), SCHEMA)).collect() == []  # a key already
    assert lattice.near_key(spark.createDataFrame(lines(repeats=300), SCHEMA)).collect() == []  # too many
    assert lattice.near_key(spark.createDataFrame(lines(12), SCHEMA)).collect() == []


def test_keys_are_brute_force(spark):
    rng = random.Random(5)
    for turn in range(4):
        rows = [tuple(rng.randrange(k) for k in (9, 14, 25, 40, 6)) for _ in range(260)]
        df = spark.createDataFrame([tuple(f"v{x}" for x in r) for r in rows], "a_code string, b_code string, c_code string, d_code string, e_code string")
        n, best = len(rows), None
        place = sorted(range(5), key=lambda i: (-len({r[i] for r in rows}), i))
        for size in (2, 3):
            got = {s: n - len({tuple(r[i] for i in s) for r in rows}) for s in combinations(place, size)}
            close = {s: e for s, e in got.items() if e <= 0.15 * n}
            if close:
                best = min(close, key=lambda s: (close[s], [place.index(i) for i in s]))
                break
        want = [] if best is None or not close[best] else [(",".join("abcde"[i] + "_code" for i in best), close[best])]
        assert [tuple(r)[:2] for r in lattice.near_key(df).collect()] == want, turn


def test_dependencies_are_brute_force(spark):
    rows = lines(800, seed=3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("city", F.when(F.col("item").isNotNull(), F.concat(F.lit("c"), F.length("item") + F.col("doc_no") % 3)))
    got = {(r["from"], r["to"]): (r["exceptions"], r["groups"]) for r in lattice.dependencies(df).collect()}
    assert got == {("item", "grp"): (0, 40)}
    broken = df.withColumn("grp", F.when((F.col("doc_no") == 5001) & (F.col("line_no") == 2), F.lit("odd")).otherwise(F.col("grp")))
    assert lattice.dependencies(broken).filter("`from` = 'item'").collect() == []  # one of forty is over 1 %
    assert lattice.dependencies(df.limit(0)).collect() == []


def test_row_sets_merge(spark):
    df = spark.range(100_000).withColumn("clash", F.lit(1))
    sets = {"big": F.col("id") < 50_000, "inside": F.col("id").between(10_000, 20_000), "mostly": F.col("id").between(49_900, 50_899), "nine tenths": F.col("id").between(49_100, 50_099), "other": F.col("id") > 90_000, "same": F.col("id") >= 90_001, "none": F.lit(None).cast("boolean")}
    rows = {r["name"]: (r["n_rows"], r["kept"], r["covered_by"]) for r in rowsets.merge_row_sets(df, "id", sets).collect()}
    assert rows == {"big": (50_000, True, None), "inside": (10_001, False, "big"), "mostly": (1000, True, None), "nine tenths": (1000, False, "big"), "other": (9999, True, None), "same": (9999, False, "other"), "none": (0, True, None)}
    pairs = {(r["a"], r["b"]): r["n_both"] for r in rowsets.overlaps(rowsets.row_bitmaps(df, "id", sets)).collect()}
    assert pairs["big", "mostly"] == 100 == pairs["mostly", "big"] and ("big", "other") not in pairs
    first = {r["name"]: r["first"] for r in rowsets.same_rows(df, "id", sets).collect()}
    assert first["same"] == "other" and first["inside"] == "inside" and first["none"] == "none"


def test_row_sets_of_repeated_and_null_positions(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (70_000,)], "id long")
    assert rowsets.merge_row_sets(df, "id", {"a": F.lit(True), "b": F.col("id") > 5}).collect() == [("a", 2, True, None), ("b", 1, False, "a")]
    assert rowsets.merge_row_sets(df.limit(0), "id", {"a": F.lit(True)}).collect() == [("a", 0, True, None)]
