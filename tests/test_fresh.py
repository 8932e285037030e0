from pyspark.sql import functions as F

from tidemark.operators import fresh


def base(spark):
    return spark.range(200).select(F.col("id").alias("key"), F.concat(F.lit("city "), F.col("id") % 9).alias("city"), (F.col("id") % 2 == 0).alias("open"), (F.col("id") * 1.5).alias("amount"), F.concat(F.lit("kind "), F.col("id") % 4).alias("kind"))


def report(old, new):
    return {(r["kind"], r["column"]): (r["detail"], r["n"]) for r in fresh.freshness(old, new).collect()}


def test_nothing_changed(spark):
    old = base(spark)
    assert report(old, old.repartition(3)) == {} and report(old, old.select(*reversed(old.columns))) == {("moved", None): (None, None)}
    assert report(old.limit(0), old.limit(0)) == {}


def test_renames_are_told_from_moves_and_new_columns(spark):
    old = base(spark)
    new = old.select("kind", "key", F.col("city").alias("place"), "open", F.col("amount").alias("total"), F.lit("x").alias("note"))
    assert [tuple(r) for r in fresh.renamed_columns(old, new).collect()] == [("city", "place", 9), ("amount", "total", 0)]
    assert report(old, new) == {("renamed", "city"): ("place", None), ("renamed", "amount"): ("total", None), ("added", "note"): (None, None)}
    other = old.withColumn("place", F.concat(F.lit("town "), F.col("key") % 9)).drop("city")
    assert report(old, other) == {("added", "place"): (None, None), ("removed", "city"): (None, None)}


def test_each_new_column_is_taken_once(spark):
    old = base(spark).withColumn("city2", F.col("city"))
    new = old.withColumnRenamed("city", "place").drop("city2")
    assert [tuple(r)[:2] for r in fresh.renamed_columns(old, new).collect()] == [("city", "place")]


def test_values_rows_and_types(spark):
    old = base(spark)
    new = old.filter("key < 190").withColumn("kind", F.when(F.col("key") % 4 == 1, "kind 7").otherwise(F.col("kind"))).withColumn("open", F.col("open").cast("string"))
    got = report(old, new)
    assert got["rows", None] == (None, -10) and got["new", "kind"] == ("kind 7", 1) and got["gone", "kind"] == ("kind 1", 1) and got["retyped", "open"] == ("boolean to string", None)
    assert ("new", "key") not in got and ("changed", "key") in got
    none = report(old.limit(0), old)
    assert none["rows", None] == (None, 200) and ("new", "kind") not in none


def test_aged_notes(spark):
    notes = spark.createDataFrame([(1, "2024-01-01", "+30d"), (2, "2024-01-01", "+31d"), (3, None, "+0d"), (4, "2024-01-01", "on-change"), (5, "x", "2024-01-30"), (6, None, None), (7, None, "2024-13-45"), (8, "2024-01-01", " ")], "i int, as_of string, stale_after string")
    assert sorted(r["i"] for r in fresh.aged_notes(notes, "2024-02-01").collect()) == [1, 5]
