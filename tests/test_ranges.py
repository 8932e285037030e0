import random

from tidemark.operators import graph, ranges

CELLS = "file string, sheet string, r int, c int, kind string, s string, n double, formula string"


def cell(sheet, r, c, value=None, formula=None, file="f"):
    text = isinstance(value, str)
    return (file, sheet, r, c, "text" if text else "number", value if text else None, None if text or value is None else float(value), formula)


def test_references_are_read(spark):
    texts = {"=SUM(A1:B20)+C3": {("S", 1, 1, 20, 2), ("S", 3, 3, 3, 3)}, "=Data!$B$2*'My ''x'' tab'!C4": {("Data", 2, 2, 2, 2), ("My 'x' tab", 4, 3, 4, 3)}, "=SUM(Data!A:C)": {("Data", 1, 1, ranges.LAST_ROW, 3)},
             '="A1:B2"&LOG10(5)&X_A1': set(), "=SUM(3:4)": {("S", 3, 1, 4, ranges.LAST_COLUMN)}, "=B9:A2": {("S", 2, 1, 9, 2)}, "=A1+A1": {("S", 1, 1, 1, 1)}, "=AA10": {("S", 10, 27, 10, 27)}, "=TRUE+1": set()}
    df = spark.createDataFrame([cell("S", 50 + i, 1, formula=f) for i, f in enumerate(texts)] + [cell("S", 1, 1, 5)], CELLS)
    got = {}
    for r in ranges.read_boxes(df).collect():
        got.setdefault(r["r"] - 50, set()).add((r["to_sheet"], r["r1"], r["c1"], r["r2"], r["c2"]))
    assert [got.get(i, set()) for i in range(len(texts))] == list(texts.values())


def test_containment_is_brute_force(spark):
    rng = random.Random(4)
    cells = [cell(rng.choice("AB"), rng.randrange(1, 200), rng.randrange(1, 60), 1, file=rng.choice("fg")) for _ in range(400)]
    boxes = []
    for i in range(120):
        r, c = rng.randrange(1, 200), rng.randrange(1, 60)
        boxes.append((rng.choice("fg"), rng.choice("AB"), r, c, r + rng.choice([0, 0, 3, 17, 150]), c + rng.choice([0, 1, 5, 40]), i))
    boxes += [("f", "A", 1, 1, ranges.LAST_ROW, 2, 998), (None, "A", 1, 1, 2, 2, 999), ("f", "A", None, 1, 2, 2, 1000)]
    df = spark.createDataFrame(cells, CELLS)
    b = spark.createDataFrame(boxes, "file string, to_sheet string, r1 int, c1 int, r2 int, c2 int, i int")
    got = sorted((r["file"], r["sheet"], r["r"], r["c"], r["i"]) for r in ranges.contained(df, b).collect())
    want = sorted((x[0], x[1], x[2], x[3], i) for x in cells for f, s, r1, c1, r2, c2, i in boxes if f == x[0] and s == x[1] and r1 is not None and r1 <= x[2] <= r2 and c1 <= x[3] <= c2)
    assert got == want and len(want) > 300
    assert ranges.contained(df, b.limit(0)).collect() == [] and ranges.contained(df.limit(0), b).collect() == []


def book(spark):
    rows = [cell("Data", 1, c, h) for c, h in enumerate(["Day", "Item", "Qty"], 1)]
    for r in range(2, 42):
        rows += [cell("Data", r, 1, r), cell("Data", r, 2, f"i{r}"), cell("Data", r, 3, r * 2)]
    rows += [cell("Rates", 1, 1, "VAT"), cell("Rates", 1, 2, 0.2), cell("Rates", 2, 1, "Old rate"), cell("Rates", 2, 2, 0.175), cell("Rates", 3, 1, "VAT"), cell("Rates", 3, 2, 0.2), cell("Rates", 4, 2, 9)]
    rows += [cell("Sum", 1, 1, formula="=SUM(Data!C2:C31)"), cell("Sum", 2, 1, formula="=A1*Rates!B1+Rates!B3"), cell("Sum", 3, 1, formula="=SUM(A1:A2)"), cell("Sum", 4, 1, formula="=A3")]
    return spark.createDataFrame(rows, CELLS)


def test_short_ranges_orphans_and_twins(spark):
    cells = book(spark)
    tables = ranges.blocks_of_rows(cells).filter("sheet = 'Data'")
    assert [tuple(r) for r in tables.collect()] == [("f", "Data", 2, 41)]
    assert [tuple(r) for r in ranges.short_ranges(cells, tables).collect()] == [("f", "Sum", "Data", 31, 41, 10, 1)]
    orphans = ranges.orphan_inputs(cells, tables).collect()
    assert [(r["sheet"], r["r"], r["c"], r["label"], r["n"]) for r in orphans] == [("Rates", 2, 2, "Old rate", 0.175)]
    twins = [(r["label"], r["n"], r["n_cells"]) for r in ranges.twin_inputs(cells.filter("sheet = 'Rates'")).collect()]
    assert twins == [("vat", 0.2, 2)]
    whole = spark.createDataFrame([cell("Sum", 1, 1, formula="=SUM(Data!C2:C41)")], CELLS).union(cells.filter("sheet = 'Data'"))
    assert ranges.short_ranges(whole, tables).collect() == []


def test_edges_reach_downstream(spark):
    cells = book(spark)
    edges = ranges.formula_edges(cells)
    assert {tuple(r) for r in edges.collect()} == {("f|Sum|1|1", "f|Sum|2|1"), ("f|Sum|1|1", "f|Sum|3|1"), ("f|Sum|2|1", "f|Sum|3|1"), ("f|Sum|3|1", "f|Sum|4|1")}
    asked = spark.createDataFrame([("f", "Data", 5, 3), ("f", "Data", 40, 3)], "file string, sheet string, r int, c int")
    first = ranges.readers(cells, asked)
    assert {(r["r"], r["dst"]) for r in first.collect()} == {(5, "f|Sum|1|1")}
    reach = graph.downstream(edges, first.select(first["dst"].alias("start")))
    assert {r["node"] for r in reach.collect()} == {"f|Sum|2|1", "f|Sum|3|1", "f|Sum|4|1"}


def test_merged_ranges_are_filled(spark):
    cells = spark.createDataFrame([cell("S", 1, 1, "East"), cell("S", 2, 2, 5), cell("S", 5, 5, 7), cell("T", 2, 2, 5)], CELLS)
    merged = spark.createDataFrame([("f", "S", 1, 1, 2, 3), ("f", "S", 8, 1, 9, 1)], "file string, to_sheet string, r1 int, c1 int, r2 int, c2 int")
    got = {(r["sheet"], r["r"], r["c"]): r["s"] or r["n"] for r in ranges.fill_merged(cells, merged).collect()}
    assert got == {("S", r, c): "East" for r in (1, 2) for c in (1, 2, 3)} | {("S", 5, 5): 7.0, ("T", 2, 2): 5.0}
