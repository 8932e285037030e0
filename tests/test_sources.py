import zipfile
from xml.parsers.expat import ExpatError

import pytest

from tidemark.operators import tables
from tidemark.sources.delimited import load_delimited
from tidemark.sources.package import Refused, load, open_package, read_merged, read_package, shared_texts, sheet_cells, sheets_of
from tidemark.sources.workbook import load_cells
from tidemark.streaming.growth import new_values, windowed_counts

SHEET = """<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Qty</t></is></c></row>
<row r="2"><c r="A2" t="str"><v>x</v></c><c r="B2"><f>1+1</f><v>2</v></c></row><row r="5"><c r="AA5" t="b"><v>1</v></c></row></sheetData></worksheet>"""


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>It</t><t>em</t></si></sst>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/workbook.xml", '<w xmlns="m" xmlns:r="o"><sheets><sheet name="One" r:id="r1"/></sheets></w>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
    cells = load_cells(spark, f"file://{tmp_path}/a.xlsx").cache()
    got = {(r["r"], r["c"]): (r["kind"], r["s"], r["n"], r["formula"]) for r in cells.collect()}
    assert got == {(1, 1): ("text", "Item", None, None), (1, 2): ("text", "Qty", None, None), (2, 1): ("text", "x", None, None), (2, 2): ("number", None, 2.0, "=1+1"), (5, 27): ("bool", "1", None, None)}
    assert sorted((r["first_row"], r["last_row"], r["n_cells"]) for r in tables.row_bands(cells).collect()) == [(1, 2, 4), (5, 5, 1)]
    assert {r["r"]: r["score"] for r in tables.header_scores(cells).collect()}[1] == 1.0


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name\n1;a, b\n2; \n")
    df = load_delimited(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.orderBy("id").collect()] == [("1", "a, b"), ("2", None)]


def test_tables(spark):
    d = spark.createDataFrame([("s", 1, "North", 1.0, None), ("s", 2, None, 2.0, 3.0), ("s", 3, "Grand Total", 3.0, 3.0)], "sheet string, pos int, label string, jan double, feb double")
    assert [r["label"] for r in tables.fill_down(d, "label", ["sheet"], "pos").orderBy("pos").collect()] == ["North", "North", "Grand Total"]
    assert d.filter(~tables.is_total_label(d["label"])).count() == 2
    assert tables.unpivot_periods(d, ["pos"], ["jan", "feb"]).count() == 5


def test_streams(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    s = spark.readStream.schema(d.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = windowed_counts(s, "ts", "event_type", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from grown").first()[0] == d.count()
    assert new_values(d, d.filter("user_id % 2 = 0"), "user_id").filter("user_id % 2 = 0").count() == 0


BOOK = '<w xmlns="m" xmlns:r="o"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></w>'
RELS = '<R xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="r3" Target="http://x" TargetMode="External"/></R>'


def package(path, two="<worksheet><sheetData><row><c><v>1</v></c><c t='b'><v>0</v></c></row><row r='4'><c><v>2.5</v></c></row></sheetData></worksheet>", one=SHEET, more=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>It</t><rPh><t>hint</t></rPh><t>em</t></si></sst>')
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        z.writestr("xl/workbook.xml", BOOK)
        z.writestr("xl/worksheets/sheet1.xml", one)
        z.writestr("xl/worksheets/sheet2.xml", two)
        for name, data in more:
            z.writestr(name, data)
    return f"file://{path}"


def test_package_sheets_are_tasks(spark, tmp_path):
    cells = read_package(spark, package(tmp_path / "a.xlsx"))
    assert cells.rdd.getNumPartitions() == 2
    got = {(r["sheet"], r["r"], r["c"]): (r["kind"], r["s"], r["n"], r["formula"]) for r in cells.collect()}
    assert got == {("One", 1, 1): ("text", "Item", None, None), ("One", 1, 2): ("text", "Qty", None, None), ("One", 2, 1): ("text", "x", None, None), ("One", 2, 2): ("number", None, 2.0, "=1+1"), ("One", 5, 27): ("bool", "1", None, None),
                   ("Two", 1, 1): ("number", None, 1.0, None), ("Two", 1, 2): ("bool", "0", None, None), ("Two", 4, 1): ("number", None, 2.5, None)}
    two = read_package(spark, f"file://{tmp_path}/*.xlsx", sheets=["Two"], columns=[1])
    assert two.rdd.getNumPartitions() == 1 and sorted((r["sheet"], r["r"], r["c"]) for r in two.collect()) == [("Two", 1, 1), ("Two", 4, 1)]
    assert read_package(spark, f"file://{tmp_path}/a.xlsx", sheets=["None"]).collect() == []


def test_merged_ranges(spark, tmp_path):
    path = package(tmp_path / "m.xlsx", two="<worksheet><sheetData/><mergeCells><mergeCell ref='B2:C4'/><mergeCell ref='AA1'/></mergeCells></worksheet>")
    assert sorted(tuple(r) for r in read_merged(spark, path).collect()) == [("m.xlsx", "Two", 1, 27, 1, 27), ("m.xlsx", "Two", 2, 2, 4, 3)]


def test_a_long_sheet_is_parsed_in_pieces(spark, tmp_path):
    rows = "".join(f"<row r='{i}'><c r='A{i}'><v>{i}</v></c><c r='B{i}' t='inlineStr'><is><r><t>a</t></r><r><t>b{i}</t></r></is></c></row>" for i in range(1, 30_001))
    path = package(tmp_path / "l.xlsx", two=f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    with open_package(path.removeprefix("file://")) as p:
        sizes = [len(x) for x in sheet_cells(p, "xl/worksheets/sheet2.xml", [])]
    assert sum(sizes) == 60_000 and max(sizes) < 12_000
    cells = read_package(spark, path, sheets=["Two"])
    assert cells.filter("c = 1").agg({"n": "sum"}).first()[0] == 30_000 * 30_001 / 2 and cells.filter("s = 'ab77'").count() == 1


@pytest.mark.parametrize("how", ["late doctype", "entity", "ratio", "twice", "shared", "place", "old", "none"])
def test_hostile_packages_are_refused(tmp_path, monkeypatch, how):
    path = tmp_path / "h.xlsx"
    sheet = "<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c></row></sheetData></worksheet>"
    if how in ("old", "none"):
        path.write_bytes((b"\xd0\xcf\x11\xe0" if how == "old" else b"text") + b"x" * 20)
    elif how == "ratio":
        package(path, more=[("xl/media/x.bin", b"0" * (12 << 20))])
    elif how == "twice":
        package(path, more=[("XL/workbook.xml", "x")])
    else:
        package(path, {"late doctype": "<!--" + "x" * 9000 + "--><!DOCTYPE w>" + sheet, "entity": "<!DOCTYPE w [<!ENTITY a 'b'>]>" + sheet, "shared": sheet.replace("<v>0", "<v>9"), "place": sheet.replace("A1", "1A")}[how])
    with pytest.raises((Refused, ExpatError)):
        with open_package(str(path)) as p:
            texts = shared_texts(p)
            for _, part in sheets_of(p):
                list(sheet_cells(p, part, texts))


def test_dispatch_by_extension(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    assert load(spark, f"file://{tmp_path}/a.tsv").columns == ["x", "y"]
    assert load(spark, package(tmp_path / "b.XLSX".lower())).count() == 8
    for name in ("c.xls", "d.pdf"):
        with pytest.raises(Refused):
            load(spark, f"file://{tmp_path}/{name}")


def test_latin_text_and_quoted_line_ends(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name;city\nJosé;Köln\n".encode("latin-1"))
    assert [tuple(r) for r in load_delimited(spark, f"file://{tmp_path}/l.csv").collect()] == [("José", "Köln")]
    (tmp_path / "q.csv").write_text('id,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    assert [tuple(r) for r in load_delimited(spark, f"file://{tmp_path}/q.csv").orderBy("id").collect()] == [("1", 'two\nlines, "quoted"'), ("2", "plain")]
