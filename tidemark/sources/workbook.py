"""Cells of spreadsheet packages that only Spark's readers reach: whole packages are handed to tasks, a file to each.

Where executors can open the files themselves, :mod:`tidemark.sources.package` reads a sheet a task instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.package import _NAMES, _TYPES, CELLS, open_package, shared_texts, sheet_cells, sheets_of


def cells_of(file: str, data: bytes):
    """Rows ``file, sheet, r, c, kind, s, n, formula`` of all filled cells, numbered from 1, some thousand at a time."""
    with open_package(data) as package:
        texts = shared_texts(package)
        for sheet, part in sheets_of(package):
            for rows in sheet_cells(package, part, texts):
                yield [(file, sheet, *r) for r in rows]


def _read(batches):
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for rows in cells_of(path.rpartition("/")[2], data):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under ``path``; a hostile or unreadable package fails, a blank one gives no rows."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, CELLS)
