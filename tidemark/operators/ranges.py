"""What formulas read: references as boxes of cells, which cells lie in which boxes, and what follows from that.

A range is never expanded into its cells. Boxes are laid on grids whose tiles are as large as they are, rows and columns
each by a power of two, so a box has four tiles at most, and a cell one for each tile size in use: containment
is an equi join on tiles, with each cell and box meeting once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import staged

LAST_ROW, LAST_COLUMN = 10_000_000, 16_384
# A reference, with its sheet or without, to a cell, a range, whole columns or whole rows.
_SHEET = r"(?:'((?:[^']|'')+)'|([A-Za-z_][A-Za-z0-9_.]*))!"
_RANGE = r"(\$?[A-Z]{1,3}\$?[0-9]{1,7}(?:\s*:\s*\$?[A-Z]{1,3}\$?[0-9]{1,7})?|\$?[A-Z]{1,3}:\$?[A-Z]{1,3}|\$?[0-9]{1,7}:\$?[0-9]{1,7})"
REFERENCE = rf"(?<![A-Za-z0-9_$.!'])(?:{_SHEET})?{_RANGE}(?![A-Za-z0-9_(!])"
_BOX = ["file", "to_sheet", "r1", "c1", "r2", "c2"]


def _number(letters: Column) -> Column:
    """The number of a column by its letters; null for none."""
    return F.when(letters != "", F.aggregate(F.split(letters, ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64))


def read_boxes(cells: DataFrame) -> DataFrame:
    """``file, sheet, r, c, to_sheet, r1, c1, r2, c2``: a row for each reference of each formula cell (columns ``file, sheet, r, c, formula``).

    Rows and columns count from 1; a reference without a sheet is to its own; whole columns and rows reach to the
    sheet's limits; the corners may come in any order. Texts in quotes are no references, nor are names of functions.
    Cells without a formula have none; repeated references of a formula count once."""
    text = F.regexp_replace("formula", r'"(?:[^"]|"")*"', '""')
    found = cells.filter(F.col("formula").isNotNull()).select("file", "sheet", "r", "c", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1)))).alias("ref"))
    part = rf"^(?:{_SHEET})?{_RANGE}$"
    quoted, plain = F.regexp_replace(F.regexp_extract("ref", part, 1), "''", "'"), F.regexp_extract("ref", part, 2)
    body = F.regexp_replace(F.regexp_extract("ref", part, 3), r"[$\s]", "")
    to = F.when(quoted != "", quoted).when(plain != "", plain).otherwise(F.col("sheet"))
    ends = found.select("file", "sheet", "r", "c", to.alias("to_sheet"), F.split_part(body, F.lit(":"), F.lit(1)).alias("a"), F.when(body.contains(":"), F.split_part(body, F.lit(":"), F.lit(2))).otherwise(body).alias("z"))
    row = lambda x: F.expr(f"try_cast(nullif(regexp_extract({x}, '([0-9]+)$', 1), '') as int)")
    column = lambda x: _number(F.regexp_extract(x, "^([A-Z]*)", 1))
    r1, r2, c1, c2 = F.coalesce(row("a"), F.lit(1)), F.coalesce(row("z"), F.lit(LAST_ROW)), F.coalesce(column("a"), F.lit(1)), F.coalesce(column("z"), F.lit(LAST_COLUMN))
    return ends.select("file", "sheet", "r", "c", "to_sheet", F.least(r1, r2).alias("r1"), F.least(c1, c2).alias("c1"), F.greatest(r1, r2).alias("r2"), F.greatest(c1, c2).alias("c2")).distinct()


def contained(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """All columns of ``cells`` (with ``file, sheet, r, c``) and of ``boxes`` (``file, to_sheet, r1, c1, r2, c2``, corners included) for each cell in a box.

    Other columns of ``boxes`` must have other names. A null anywhere in a place is no place. A pair meets in one tile only."""
    size = lambda lo, hi: F.ceil(F.log2(F.col(hi) - F.col(lo) + 1)).cast("int")
    b = boxes.withColumns({"_kr": size("r1", "r2"), "_kc": size("c1", "c2")})
    # how many sizes of tiles are in use: 25 by 16 at most
    sizes = [(r["_kr"], r["_kc"]) for r in b.select("_kr", "_kc").distinct().filter("_kr is not null and _kc is not null").collect()]
    steps = lambda lo, hi, k: F.explode(F.sequence(F.expr(f"shiftright({lo}, {k})"), F.expr(f"shiftright({hi}, {k})")))
    b = b.filter("_kr is not null and _kc is not null").withColumn("_tr", steps("r1", "r2", "_kr")).withColumn("_tc", steps("c1", "c2", "_kc")).withColumnRenamed("file", "_file")
    levels = F.array(*(F.struct(F.lit(r).alias("_xr"), F.lit(c).alias("_xc")) for r, c in sizes)).cast("array<struct<_xr:int,_xc:int>>")
    x = cells.select("*", F.inline(levels)).withColumns({"_ur": F.expr("shiftright(r, _xr)"), "_uc": F.expr("shiftright(c, _xc)")})
    same = (x["file"] == b["_file"]) & (x["sheet"] == b["to_sheet"]) & (x["_xr"] == b["_kr"]) & (x["_xc"] == b["_kc"]) & (x["_ur"] == b["_tr"]) & (x["_uc"] == b["_tc"])
    inside = x["r"].between(b["r1"], b["r2"]) & x["c"].between(b["c1"], b["c2"])
    return x.join(b, same & inside).drop("_file", "_kr", "_kc", "_tr", "_tc", "_xr", "_xc", "_ur", "_uc")


def _cell(file: str, sheet: str, r: str, c: str) -> Column:
    return F.concat_ws("|", file, sheet, r, c)


def formula_edges(cells: DataFrame) -> DataFrame:
    """``src, dst``: formula cells that read other formula cells, for :func:`tidemark.operators.graph.downstream`.

    Nodes are ``file|sheet|row|column``. Typed cells in a range give no edges: what reads them is found by :func:`readers`."""
    boxes = staged(read_boxes(cells).select("file", "to_sheet", "r1", "c1", "r2", "c2", _cell("file", "sheet", "r", "c").alias("dst")), "boxes")
    formulas = cells.filter(F.col("formula").isNotNull()).select("file", "sheet", "r", "c")
    return contained(formulas, boxes).select(_cell("file", "sheet", "r", "c").alias("src"), "dst").distinct()


def readers(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """``file, sheet, r, c, dst``: the formula cells that read each asked cell directly, by a range too."""
    boxes = read_boxes(cells).select("file", "to_sheet", "r1", "c1", "r2", "c2", _cell("file", "sheet", "r", "c").alias("dst"))
    return contained(asked.select("file", "sheet", "r", "c").distinct(), staged(boxes, "boxes")).select("file", "sheet", "r", "c", "dst").distinct()


def fill_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """``cells`` with a copy of a merged range's first cell in each of its other places (``merged``: ``file, to_sheet, r1, c1, r2, c2``).

    Places of a merged range hold what its top left cell holds, whatever stood there; an empty first cell leaves them empty. A range
    of more cells than a sheet can be read with is the caller's to refuse: each place becomes a row here, as a reader sees it."""
    rest = contained(cells, merged.select(*_BOX)).filter("r <> r1 or c <> c1").select("file", "sheet", "r", "c").distinct()
    kept = cells.join(rest, ["file", "sheet", "r", "c"], "left_anti")
    m = merged.select(F.col("file").alias("_f"), F.col("to_sheet").alias("_s"), "r1", "c1", "r2", "c2").distinct()
    first = cells.join(m, (F.col("file") == F.col("_f")) & (F.col("sheet") == F.col("_s")) & (F.col("r") == F.col("r1")) & (F.col("c") == F.col("c1")))
    rows = first.withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2"))).filter("r <> r1 or c <> c1")
    return kept.unionByName(rows.select(*cells.columns))


def orphan_inputs(cells: DataFrame, tables: DataFrame | None = None, columns: int = 4) -> DataFrame:
    """``file, sheet, r, c, label, n``: typed, labelled numbers on a sheet that feeds others, in a row that no formula reads.

    A sheet feeds others if a formula of another sheet reads it. The label is the first text of the row; the number is
    the first of the first ``columns`` columns that isn't a formula; rows of data tables (``file, sheet, first_row, last_row``) are data."""
    boxes = staged(read_boxes(cells), "boxes")
    feeds = boxes.filter("sheet <> to_sheet").select("file", F.col("to_sheet").alias("sheet")).distinct()
    rows = cells.join(feeds, ["file", "sheet"], "left_semi")
    label = rows.filter("kind = 'text' and trim(s) <> ''").groupBy("file", "sheet", "r").agg(F.min(F.struct("c", "s")).alias("m")).select("file", "sheet", "r", F.col("m.s").alias("label"))
    typed = rows.filter(F.col("formula").isNull() & (F.col("kind") == "number") & F.col("n").isNotNull() & (F.col("c") <= columns))
    first = typed.groupBy("file", "sheet", "r").agg(F.min(F.struct("c", "n")).alias("m")).select("file", "sheet", "r", "m.c", "m.n").join(label, ["file", "sheet", "r"])
    read = contained(first.withColumn("_c", F.col("c")).withColumn("c", F.lit(1)), boxes.select("file", "to_sheet", "r1", F.lit(1).alias("c1"), "r2", F.lit(1).alias("c2")).distinct()).select("file", "sheet", "r").distinct()
    out = first.join(read, ["file", "sheet", "r"], "left_anti")
    if tables is not None:
        data = contained(out.withColumn("_c", F.col("c")).withColumn("c", F.lit(1)), tables.select("file", F.col("sheet").alias("to_sheet"), F.col("first_row").alias("r1"), F.lit(1).alias("c1"), F.col("last_row").alias("r2"), F.lit(1).alias("c2"))).select("file", "sheet", "r").distinct()
        out = out.join(data, ["file", "sheet", "r"], "left_anti")
    return out.select("file", "sheet", "r", "c", "label", "n")


def short_ranges(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """``file, sheet, reads, range_end, last_row, rows_left_out, formulas``: sheets whose formulas read a data table by ranges that end before it does.

    ``tables``: ``file, sheet, first_row, last_row`` of data rows, of 20 rows or more. A range counts if it begins at or above the
    second data row and ends within the data; the furthest end stands for the sheet, and must cover half the data at least.
    One row only is no range."""
    data = tables.filter("last_row - first_row >= 19").select(F.col("file").alias("_f"), F.col("sheet").alias("_s"), "first_row", "last_row")
    spans = read_boxes(cells).filter("sheet <> to_sheet and r1 < r2").join(data, (F.col("file") == F.col("_f")) & (F.col("to_sheet") == F.col("_s")))
    spans = spans.filter("r1 <= first_row + 1 and r2 >= first_row and r2 < last_row")
    g = spans.groupBy("file", "sheet", F.col("to_sheet").alias("reads"), "first_row", "last_row").agg(F.max("r2").alias("range_end"), F.count("*").alias("formulas"))
    g = g.filter("range_end - first_row >= 0.5 * (last_row - first_row)")
    return g.select("file", "sheet", "reads", "range_end", "last_row", (F.col("last_row") - F.col("range_end")).alias("rows_left_out"), "formulas")


def twin_inputs(cells: DataFrame) -> DataFrame:
    """``file, n, label, first, n_cells``: the same typed number under the same label in several places, with the first of them by sheet, row and column."""
    label = cells.filter("kind = 'text' and trim(s) <> ''").groupBy("file", "sheet", "r").agg(F.min(F.struct("c", "s")).alias("m")).select("file", "sheet", "r", F.lower(F.trim("m.s")).alias("label"))
    typed = cells.filter(F.col("formula").isNull() & (F.col("kind") == "number") & F.col("n").isNotNull()).join(label, ["file", "sheet", "r"])
    g = typed.groupBy("file", "n", "label").agg(F.min(F.struct("sheet", "r", "c")).alias("m"), F.count("*").alias("n_cells")).filter("n_cells > 1")
    return g.select("file", "n", "label", _cell("file", "m.sheet", "m.r", "m.c").alias("first"), "n_cells")


def blocks_of_rows(cells: DataFrame) -> DataFrame:
    """``file, sheet, first_row, last_row``: unbroken runs of rows with three cells or more, the header row left out; what :func:`short_ranges` takes for tables."""
    rows = cells.groupBy("file", "sheet", "r").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "number").alias("numbers")).filter("n >= 3")
    w = Window.partitionBy("file", "sheet").orderBy("r")
    run = rows.withColumn("_g", F.col("r") - F.row_number().over(w))
    return run.filter("numbers > 0").groupBy("file", "sheet", "_g").agg(F.min("r").alias("first_row"), F.max("r").alias("last_row")).drop("_g")
