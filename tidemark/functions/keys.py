"""Column builders for the equality, the shape and the scalar typing that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats tried in this order, and flag words.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "MMM d, yyyy"]
TWO_MARKS = r"(?s)-.*-|/.*/| .* "  # that each of the formats has
FLAG_WORDS = ["y", "n", "yes", "no", "true", "false", "0", "1", "x"]


def norm_text(c: Column) -> Column:
    """White space as one space, lower case, without trailing ``.,;``; all-digit texts lose leading zeros; blank is null."""
    t = F.rtrim(F.regexp_replace(F.trim(F.lower(F.regexp_replace(c, r"\s+", " "))), r"[.,;]+$", ""))
    # each step names its text once: a text named twice is worked out twice, and what holds it four times
    return F.nullif(F.regexp_replace(t, r"^0+(?=[0-9]+$)", ""), F.lit(""))


def norm_key(c: Column, kind: str) -> Column:
    """The equality of all groups, joins and predicates. Typed numbers and dates stay what they are, so filters
    on them still reach the scan; only texts are rewritten."""
    if kind == "string":
        return norm_text(c)
    if kind in ("double", "float"):
        return F.when(~F.isnan(c), F.round(c, 6))
    if kind.startswith("timestamp"):
        return F.to_date(c)
    return c


def shape(c: Column) -> Column:
    """Of the first 24 characters: runs of digits as 9, of capitals as A, of other letters as a."""
    s = F.substring(c, 1, 24)
    for pattern, mark in ((r"[0-9]+", "9"), (r"\p{Lu}+", "A"), (r"\p{Ll}+", "a")):
        s = F.regexp_replace(s, pattern, mark)
    return s


def parse_number(c: Column) -> Column:
    """``1,234.5``, ``12%``, ``$5`` and ``(42.10)`` as doubles; codes with leading zeros or over 15 digits are null."""
    t = F.trim(c)
    minus = t.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.regexp_replace(t, r"^\((.*)\)$", "$1"), r"[$€£,\s]", "")
    percent = bare.endswith("%")
    bare = F.regexp_replace(bare, "%$", "")
    fits = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$") & ~bare.rlike(r"^[+-]?0[0-9]") & ~bare.rlike(r"^[+-]?[0-9]{16,}$")
    value = bare.try_cast("double")
    return F.when(fits, value * F.when(minus, -1.0).otherwise(1.0) / F.when(percent, 100.0).otherwise(1.0))


def parse_date(c: Column) -> Column:
    """The first format that fits, as a date; ``13/04/2024`` and ``04/13/2024`` are read, ``04/05/2024`` is ambiguous and null."""
    t = F.trim(c)
    day = F.regexp_extract(t, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", 1).try_cast("int")
    month = F.regexp_extract(t, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", 2).try_cast("int")
    slashed = F.when((day > 12) & (month <= 12), F.try_to_timestamp(t, F.lit("d/M/yyyy"))).when((month > 12) & (day <= 12), F.try_to_timestamp(t, F.lit("M/d/yyyy")))
    dated = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS), slashed).cast("date")
    return F.when(t.rlike(TWO_MARKS), dated)  # each format that fails costs an exception


# An identifier (letters, a mark, digits and marks) and a name written last name first.
ID_FORM = r"^([A-Za-z]{0,4})([-_ /.#]?[0-9][0-9\-_ /.]*)$"
NAME = r"\p{L}[\p{L}\p{N}_'.\-]*"
LAST_FIRST = f"^{NAME}( {NAME})*, {NAME}( {NAME})*$"


def written_form(c: Column, kind: str) -> Column:
    """How a value is written: blank, flag, zero, int, dec, date, text date, ``id:`` with its prefix and marks, last_first, caps or word."""
    if kind == "boolean":
        form = F.lit("flag")
    elif kind == "date" or kind.startswith("timestamp"):
        form = F.lit("date")
    elif kind == "string":
        t = F.trim(c)
        mark = F.concat(F.lit("id:"), F.upper(F.regexp_extract(t, ID_FORM, 1)), F.regexp_replace(F.regexp_extract(t, ID_FORM, 2), "[0-9]+", "#"))
        form = F.when(t == "", "blank").when(parse_date(t).isNotNull(), "text date").when(t.rlike(ID_FORM), mark).when(t.rlike(LAST_FIRST), "last_first")
        form = form.when(t.rlike("[A-Z]") & ~t.rlike("[a-z]"), "caps").otherwise("word")
    else:
        form = F.when(c == 0, "zero").when(c == F.floor(c), "int").otherwise("dec")
    return F.when(c.isNull(), "blank").otherwise(form)
