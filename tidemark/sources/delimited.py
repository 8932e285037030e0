"""Delimited text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = [",", ";", "\t", "|"]
SNIFFED = 50  # lines that the separator is chosen from


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that most of the first lines have equally often (ties: the earlier of ``, ; tab |``)."""
    lines = [r["value"] for r in spark.read.text(path).limit(SNIFFED).collect() if r["value"].strip()]

    def score(sep: str) -> tuple[int, int]:
        counts = [x.count(sep) for x in lines]
        usual = max(set(counts), key=counts.count) if counts else 0
        return (counts.count(usual) if usual else 0), usual

    return max(SEPARATORS, key=score)


def text_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether all lines are UTF-8, and whether some quoted field may hold a line end (a line with an odd number of quotes); one pass, no parsing."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    r = lines.agg(F.min(F.is_valid_utf8("value")), F.max(quotes % 2 == 1)).first()
    return r[0] is not False, bool(r[1])


def load_delimited(spark: SparkSession, path: str, header: bool = True, encoding: str | None = None) -> DataFrame:
    """All columns as text, blank cells as null; a byte order mark in front of the first name is dropped.

    Without ``encoding`` a file that isn't UTF-8 throughout is read as latin-1. Files are split among tasks unless a quoted field
    holds a line end; then each file is one task, as only its beginning says which quotes open."""
    valid, spans = text_facts(spark, path)
    encoding = encoding or ("UTF-8" if valid else "ISO-8859-1")
    df = spark.read.csv(path, sep=sniff_separator(spark, path), header=header, encoding=encoding, multiLine=spans, quote='"', escape='"')
    df = df.toDF(*(c.lstrip("\ufeff").removeprefix("ï»¿").strip() for c in df.columns))
    return df.select(*(F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).alias(c) for c in df.columns))
