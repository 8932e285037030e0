"""Spreadsheet packages, read sheet by sheet: a Spark data source with a partition for each sheet, streaming XML, hostile files refused.

``spark.read.format("package").option("path", ...).load()`` gives the cells; options ``sheets`` and ``columns`` (comma-separated) leave
the rest out before it is parsed. The files must be where executors can open them; for stores that only Spark reads, ``load_cells`` in
``workbook`` hands over whole packages. A sheet is parsed in pieces, so memory depends on its shared texts, not on its rows.
"""

from __future__ import annotations

import glob
import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.delimited import load_delimited

# Bytes of an unpacked package and of a formula's text, and how far a part of 10 MiB or more may be packed.
MOST_UNPACKED, MOST_RATIO, LARGE = 2 << 30, 200, 10 << 20
MOST_FORMULA = 9216
MOST_PARTS = 20_000
STEP, BATCH = 1 << 16, 4096
CELLS = "file string, sheet string, r int, c int, kind string, s string, n double, formula string"
MERGED = "file string, to_sheet string, r1 int, c1 int, r2 int, c2 int"
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]
_NAMES = [c.split()[0] for c in CELLS.split(", ")]
_KINDS = {"b": "bool", "e": "error", "str": "text", "d": "date", "s": "text", "inlineStr": "text", "n": "number"}


class Refused(ValueError):
    """A package that isn't read, and why."""


def open_package(source: str | bytes) -> zipfile.ZipFile:
    """A package whose directory keeps the limits; nothing is unpacked yet."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else open(source, "rb")
    head = stream.read(8)
    if head.startswith(b"\xd0\xcf\x11\xe0"):
        raise Refused("the file is encrypted or of the old binary format")
    if not head.startswith(b"PK"):
        raise Refused("the file is no package")
    package = zipfile.ZipFile(stream)
    parts = package.infolist()
    if len(parts) > MOST_PARTS or sum(p.file_size for p in parts) > MOST_UNPACKED:
        raise Refused("the package unpacks to too much")
    for p in parts:
        if p.file_size > LARGE and p.file_size > MOST_RATIO * max(1, p.compress_size):
            raise Refused(f"{p.filename} is packed too tightly")
    if len({p.filename.lower() for p in parts}) != len(parts):
        raise Refused("two parts have one name")
    return package


def _refuse(*_):
    raise Refused("a part declares a document type or an entity")


def parse(package: zipfile.ZipFile, part: str, start, end=None, text=None) -> Iterator[None]:
    """Feed a part to handlers of elements (names without their space) piece by piece; a step after each piece.

    A document type anywhere is refused, as are parts that unpack to more than their directory says."""
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True
    p.StartDoctypeDeclHandler = p.EntityDeclHandler = _refuse
    p.StartElementHandler = lambda name, attributes: start(name.rpartition(" ")[2], {k.rpartition(" ")[2]: v for k, v in attributes.items()})
    if end:
        p.EndElementHandler = lambda name: end(name.rpartition(" ")[2])
    if text:
        p.CharacterDataHandler = text
    size, most = 0, package.getinfo(part).file_size
    with package.open(part) as f:
        while piece := f.read(STEP):
            size += len(piece)
            if size > most:
                raise Refused(f"{part} is larger than it says")
            p.Parse(piece, False)
            yield
    p.Parse(b"", True)
    yield


def _run(steps: Iterator[None]) -> None:
    for _ in steps:
        pass


def sheets_of(package: zipfile.ZipFile) -> list[tuple[str, str]]:
    """The sheets' names and parts, in order."""
    targets, sheets = {}, []
    _run(parse(package, "xl/_rels/workbook.xml.rels", lambda name, a: targets.update({a["Id"]: a["Target"]}) if name == "Relationship" and a.get("TargetMode") != "External" else None))
    _run(parse(package, "xl/workbook.xml", lambda name, a: sheets.append((a["name"], a["id"])) if name == "sheet" else None))
    parts = {i: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for i, t in targets.items()}
    return [(name, parts[i]) for name, i in sheets if i in parts]


def shared_texts(package: zipfile.ZipFile) -> list[str]:
    """Shared texts by number; phonetic readings are left out."""
    if "xl/sharedStrings.xml" not in package.namelist():
        return []
    out: list[str] = []
    state = {"t": False, "hint": 0}

    def start(name, _):
        if name == "si":
            out.append("")
        state["hint"] += name == "rPh"
        state["t"] = name == "t" and not state["hint"]

    def end(name):
        state["hint"] -= name == "rPh"
        if name == "t":
            state["t"] = False

    def text(data):
        if state["t"]:
            out[-1] += data
    _run(parse(package, "xl/sharedStrings.xml", start, end, text))
    return out


def place_of(reference: str) -> tuple[int, int]:
    """Row and column of a place such as AB12."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?([0-9]{1,7})", reference)
    if not m:
        raise Refused(f"{reference[:20]} is no place of a cell")
    n = 0
    for letter in m[1]:
        n = n * 26 + ord(letter) - 64
    return int(m[2]), n


def sheet_cells(package: zipfile.ZipFile, part: str, texts: list[str], columns: set[int] | None = None) -> Iterator[list[tuple]]:
    """Cells ``r, c, kind, s, n, formula`` of a sheet, some thousand at a time; a cell that doesn't say where it stands follows the one before it."""
    rows: list[tuple] = []
    at = {"r": 0, "c": 0}
    cell: dict = {}
    field: list[str] = []
    taken = {"what": None}

    def start(name, a):
        if name == "row":
            at["r"], at["c"] = int(a.get("r", at["r"] + 1)), 0
        elif name == "c":
            at["r"], at["c"] = place_of(a["r"]) if "r" in a else (at["r"], at["c"] + 1)
            cell.clear()
            cell["t"] = a.get("t", "n")
        elif name in ("v", "f", "t"):
            taken["what"] = name if "t" in cell else None
            field.clear()

    def text(data):
        if taken["what"]:
            field.append(data)

    def end(name):
        if name in ("v", "f", "t") and taken["what"]:
            cell[{"t": "is"}.get(name, name)] = cell.get("is", "") * (name == "t") + "".join(field)
            taken["what"] = None
        elif name == "c":
            if columns is None or at["c"] in columns:
                row = _typed(cell, texts)
                if row:
                    rows.append((at["r"], at["c"], *row))
            cell.clear()

    for _ in parse(package, part, start, end, text):
        if len(rows) >= BATCH:
            yield rows[:]
            rows.clear()
    if rows:
        yield rows


def _typed(cell: dict, texts: list[str]) -> tuple | None:
    kind, value, formula = cell["t"], cell.get("v"), cell.get("f")
    formula = f"={formula[:MOST_FORMULA]}" if formula else None
    number = None
    if kind == "s":
        if value is not None and not 0 <= int(value) < len(texts):
            raise Refused("a cell names a shared text that isn't there")
        value = None if value is None else texts[int(value)]
    elif kind == "inlineStr":
        value = cell.get("is")
    elif kind == "n":
        value, number = None, float(value) if value else None
    return (_KINDS.get(kind, "text"), value, number, formula) if value or number is not None or formula else None


def merged_ranges(package: zipfile.ZipFile, part: str) -> list[tuple[int, int, int, int]]:
    """Corners of a sheet's merged ranges."""
    out = []

    def start(name, a):
        if name == "mergeCell" and "ref" in a:
            first, _, last = a["ref"].partition(":")
            (r1, c1), (r2, c2) = place_of(first), place_of(last or first)
            out.append((min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)))
    _run(parse(package, part, start))
    return out


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str, part: str):
        self.path, self.sheet, self.part = path, sheet, part


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"].removeprefix("file://")))
        self.sheets = {s.strip() for s in options["sheets"].split(",")} if "sheets" in options else None
        self.columns = {int(c) for c in options["columns"].split(",")} if "columns" in options else None
        self.merged = options.get("what", "cells") == "merged"
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self):
        out = []
        for path in self.paths:
            with open_package(path) as package:
                out += [_Sheet(path, name, part) for name, part in sheets_of(package) if self.sheets is None or name in self.sheets]
        return out or [_Sheet("", "", "")]

    def read(self, partition):
        if not partition.path:
            return
        file = partition.path.rpartition("/")[2]
        with open_package(partition.path) as package:
            if self.merged:
                yield from ((file, partition.sheet, *box) for box in merged_ranges(package, partition.part))
                return
            texts = shared_texts(package)
            for rows in sheet_cells(package, partition.part, texts, self.columns):
                columns = list(zip(*((file, partition.sheet, *r) for r in rows), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


class PackageSource(DataSource):
    """``what`` is ``cells`` (the default) or ``merged``."""

    @classmethod
    def name(cls):
        return "package"

    def schema(self):
        return MERGED if self.options.get("what") == "merged" else CELLS

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_package(spark: SparkSession, path: str, sheets: list[str] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Cells of the packages that ``path`` names (stars are allowed), one task a sheet. A hostile package fails the read, whatever its other sheets hold."""
    spark.dataSource.register(PackageSource)
    read = spark.read.format("package").option("path", path)
    read = read if sheets is None else read.option("sheets", ",".join(sheets))
    return (read if columns is None else read.option("columns", ",".join(map(str, columns)))).load()


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Merged ranges of the packages, for :func:`tidemark.operators.ranges.fill_merged`."""
    spark.dataSource.register(PackageSource)
    return spark.read.format("package").option("path", path).option("what", "merged").load()


def trim_trailing(cells: DataFrame) -> DataFrame:
    """Cells without those that hold blank text only and no formula: rows and sheets then end at what is filled."""
    return cells.filter("formula is not null or n is not null or trim(coalesce(s, '')) <> ''")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a file by its extension: delimited text as a table, spreadsheet packages as cells; others are refused."""
    low = path.lower()
    if low.endswith((".csv", ".tsv", ".txt")):
        return load_delimited(spark, path)
    if low.endswith((".xlsx", ".xlsm")):
        return read_package(spark, path)
    raise Refused("old workbooks must be saved as .xlsx first" if low.endswith(".xls") else f"{path.rpartition('/')[2]} is of no known type")
