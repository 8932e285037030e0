"""Tables found in sheets of cells, and repairs of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_bands(cells: DataFrame) -> DataFrame:
    """Bands of rows without a blank row between them: ``file, sheet, band, first_row, last_row, n_columns, n_cells``.

    Gaps between filled rows start a new band; windows run within one sheet.
    """
    rows = cells.groupBy("file", "sheet", "r").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy("file", "sheet").orderBy("r")
    rows = rows.withColumn("_new", (F.coalesce(F.col("r") - F.lag("r").over(w), F.lit(2)) > 1).cast("int"))
    rows = rows.withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file", "sheet", "band").agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"), (F.max("hi") - F.min("lo") + 1).alias("n_columns"), F.sum("n").alias("n_cells"))


def header_scores(cells: DataFrame) -> DataFrame:
    """Share of text cells of each row; a row with a number has none."""
    return cells.groupBy("file", "sheet", "r").agg(F.when(F.count_if(F.col("kind") == "number") == 0, F.avg((F.col("kind") == "text").cast("double"))).otherwise(0.0).alias("score"))


def is_total_label(label: Column) -> Column:
    """Whether a label names a total or subtotal; null doesn't."""
    return F.coalesce(F.lower(F.trim(label)).rlike(r"^(grand |sub-?)?totals?\b"), F.lit(False))


def fill_down(df: DataFrame, column: str, sheet: list[str], position: str) -> DataFrame:
    """Blank labels take the last label above them in their sheet."""
    w = Window.partitionBy(*sheet).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, True).over(w))


def unpivot_periods(df: DataFrame, keys: list[str], periods: list[str]) -> DataFrame:
    """A grid of periods as rows ``period, value``; blank cells give none."""
    return df.unpivot(keys, periods, "period", "value").filter("value is not null")
