from pyspark.sql import functions as F

from tidemark.operators import relations


def test_header_similarity():
    s = relations.header_similarity
    assert s("CustomerId", "client no") == 1.0 and s("SKU", "Product Code") == 1.0 and s("Order ID", "order_id") == 1.0
    assert s("Ship City", "Bill City") == 1 / 3 and s("x", "y") == 0.0 and s("", "a") == 0.0


def tables(spark):
    lines = spark.range(400).select((F.col("id") % 60 + 100).alias("item_id"), F.concat(F.lit("C-"), F.col("id") % 25).alias("customer_code"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 90).cast("int")).alias("day"), (F.col("id") * 1.5).alias("amount"),
                                    F.concat(F.lit("note "), F.col("id") % 7).alias("remark"))
    items = spark.range(60).select((F.col("id") + 100).cast("double").alias("sku_id"), F.concat(F.lit("item "), F.col("id")).alias("title"))
    clients = spark.range(20).select(F.concat(F.lit("c-"), F.col("id")).alias("client_code"), F.concat(F.lit("Client "), F.col("id")).alias("client_title"))
    other = spark.range(30).select(F.concat(F.lit("Z"), F.col("id")).alias("zone_code"), F.concat(F.lit("note "), F.col("id")).alias("text"))
    return {"lines": lines, "items": items, "clients": clients, "other": other}


def test_joins_have_direction_and_band(spark):
    found = {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]): r for r in relations.discover_joins(tables(spark)).collect()}
    assert set(found) == {("lines", "item_id", "items", "sku_id"), ("lines", "customer_code", "clients", "client_code"), ("lines", "remark", "other", "text")}
    item, client, note = (found[k] for k in sorted(found, key=lambda k: ["item_id", "customer_code", "remark"].index(k[1])))
    assert (item["band"], item["rows_matched"], item["to_unique"], item["header_similarity"]) == ("auto", 1.0, True, 1.0)
    assert (client["band"], client["n_shared"], client["rows_matched"]) == ("auto", 20, 0.8)  # the same header and a unique side
    assert (note["band"], note["values_matched"]) == ("auto", 1.0)


def test_unsure_joins_are_asked_or_left_out(spark):
    a = spark.range(100).select(F.concat(F.lit("A"), F.col("id") % 20).alias("batch_code"))
    half = spark.range(12).select(F.concat(F.lit("A"), F.col("id")).alias("lot_code"), F.lit("x").alias("pad"))
    got = relations.discover_joins({"a": a, "half": half}).collect()
    assert [(r["from_table"], r["band"]) for r in got] == [("a", "ask")] or [(r["from_table"], r["band"]) for r in got] == [("half", "auto")]
    few = spark.range(12).select(F.concat(F.lit("A"), F.col("id") * 9).alias("lot_code"))
    assert relations.discover_joins({"a": a, "few": few}).collect() == []
    assert relations.discover_joins({"a": a.limit(0), "half": half}).collect() == []


def test_reference_links(spark):
    t = tables(spark)
    joins = relations.discover_joins(t)
    links = {(r["lines"], r["reference"], r["line_key"]) for r in relations.reference_links(t, joins).collect()}
    assert links == {("lines", "items", "item_id"), ("lines", "clients", "customer_code"), ("lines", "other", "remark")}
    assert relations.reference_links(t, joins.limit(0)).collect() == []


def test_codes_and_names(spark):
    lookup = spark.createDataFrame([("N1", "North"), ("S2", "South"), ("W3", "West"), (None, "Gone"), ("E4", None)], "code string, name string")
    rows = [("N1",)] * 40 + [("north ",)] * 10 + [("South",)] * 5 + [("S2",)] * 44 + [("who",)] + [(None,), (" ",)]
    df = spark.createDataFrame([(v, "clash", 1) for v, in rows], "site string, name string, _k int")
    assert relations.code_or_name(df, "site", lookup, "code", "name").collect() == [(100, 84, 15, 1, True)]
    assert relations.code_or_name(df.filter("site <> 'South' and site <> 'north '"), "site", lookup, "code", "name").collect()[0]["mixed"] is False
    assert relations.code_or_name(df.limit(0), "site", lookup, "code", "name").collect() == [(0, 0, 0, 0, False)]
    fixed = relations.as_codes(df.drop("_k"), "site", lookup, "code", "name")
    assert fixed.columns == ["site", "name"] and {r["site"]: r["count"] for r in fixed.groupBy("site").count().collect()} == {"N1": 50, "S2": 49, "who": 1, None: 1, " ": 1}
