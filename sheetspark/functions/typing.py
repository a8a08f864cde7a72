"""Value types of cell text as column expressions: what a text file's field is, and what an extracted cell is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
INTEGER = r"^[+-]?[0-9]+$"
MONTHS = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def strip(v: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(v, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def without(v: Column, chars: str) -> Column:
    return F.translate(v, chars, "")


def to_number(v: Column) -> Column:
    """The number that a text is, after its commas go; null if it is none."""
    plain = strip(without(v, ","))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double")).when(plain.rlike(SPECIAL), plain.try_cast("double"))


def to_float(v: Column) -> Column:
    """The number that a text is as it stands; null if it is none."""
    plain = strip(v)
    return F.when(plain.rlike(NUMBER) | plain.rlike(SPECIAL), plain.try_cast("double"))


def looks_like_date(v: Column) -> Column:
    t = strip(v)
    dashes = F.length(t) - F.length(without(t, "-"))
    slashes = F.length(t) - F.length(without(t, "/"))
    named = (F.length(t) >= 8) & t.rlike(MONTHS)
    return t.rlike(r"[-/. ]") & t.rlike("[0-9]") & (((F.length(t) == 10) & ((dashes == 2) | (slashes == 2))) | named)


def infer_text(v: Column) -> Column:
    """struct(vtype, num) of a text file's field: empty, boolean words and 1 and 0, whole numbers, numbers, dates, text."""
    t = strip(v)
    plain = without(t, ",")
    whole = ~F.contains(t, F.lit(".")) & ~F.contains(F.lower(t), F.lit("e")) & strip(plain).rlike(INTEGER)
    kind = (
        F.when(t.isNull() | (t == ""), "empty")
        .when(F.lower(t).isin("true", "false", "yes", "no", "1", "0"), "boolean")
        .when(whole, "number")
        .when(to_number(t).isNotNull(), "number")
        .when(looks_like_date(t), "date")
        .otherwise("string")
    )
    return F.struct(kind.alias("vtype"), F.when(kind == "number", to_number(t)).alias("num"))


def cell_kind(v: Column, vtype: Column) -> Column:
    """numeric, text, date, boolean or empty: the type by which extraction judges columns."""
    t = strip(v)
    date = t.rlike("[-/:]") & (F.length(t) >= 6)
    return (
        F.when(v.isNull() | (t == ""), "empty")
        .when(vtype == "boolean", "boolean")
        .when(vtype == "number", "numeric")
        .when(vtype == "datetime", "date")
        .when(to_number(t).isNotNull(), "numeric")
        .when(date, "date")
        .when(F.lower(t).isin("true", "false", "yes", "no", "y", "n"), "boolean")
        .otherwise("text")
    )


def is_numeric(v: Column) -> Column:
    """A number once commas and dollar signs go."""
    return F.coalesce(to_number(without(v, ",$")).isNotNull(), F.lit(False))


def data_type(kind: str) -> str:
    """Cell type of a Spark SQL type."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return "number"
    return {"boolean": "boolean", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "void": "empty"}.get(kind, "string")
