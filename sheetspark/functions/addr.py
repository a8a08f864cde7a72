"""A1 addresses as column expressions. Rows and columns count from 0; text addresses count rows from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = r"^([A-Z]+)([0-9]+)$"


def column_letter(c: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA; null for negatives."""
    c = c.cast("long")
    letter = lambda n: F.char(65 + F.pmod(n, F.lit(26)))
    out = F.when(c < 0, F.lit(None).cast("string"))
    first = 0  # the first index that needs so many letters; seven are enough for any int
    for letters in range(1, 8):
        own = [letter(F.floor((c - first) / 26**k)) for k in range(letters - 1, 0, -1)] + [letter(c - first)]
        out = out.when(c < first + 26**letters, F.concat(*own))
        first += 26**letters
    return out


def column_index(letters: Column) -> Column:
    """A -> 0, AA -> 26, in any case; null unless all are letters."""
    up = F.upper(letters)
    n = F.aggregate(F.split(up, ""), F.lit(0).cast("long"), lambda a, x: a * 26 + F.ascii(x) - 64)
    return F.when(up.rlike("^[A-Z]+$"), n - 1)


def cell_address(r: Column, c: Column) -> Column:
    return F.concat(column_letter(c), (r + 1).cast("string"))


def parse_cell(ref: Column) -> Column:
    """struct(r, c); null where the text is no address. Dollar signs are allowed."""
    plain = F.upper(F.regexp_replace(ref, r"\$", ""))
    ok = plain.rlike(CELL)
    r = F.regexp_extract(plain, CELL, 2).try_cast("int") - 1
    return F.when(ok & (r >= 0), F.struct(r.alias("r"), column_index(F.regexp_extract(plain, CELL, 1)).cast("int").alias("c")))


def parse_range(ref: Column) -> Column:
    """struct(r0, c0, r1, c1) of 'A1:B2' or 'Sheet!A1:B2'; null unless exactly one colon joins two addresses."""
    own = F.element_at(F.split(ref, "!"), -1)
    parts = F.split(own, ":")
    a, b = parse_cell(F.get(parts, F.lit(0))), parse_cell(F.get(parts, F.lit(1)))
    ok = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.when(ok, F.struct(a["r"].alias("r0"), a["c"].alias("c0"), b["r"].alias("r1"), b["c"].alias("c1")))


def format_range(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return F.concat(cell_address(r0, c0), F.lit(":"), cell_address(r1, c1))


def is_data_range(refers_to: Column) -> Column:
    """A reference to more than one cell: its part after the last '!' has a colon."""
    return F.contains(F.element_at(F.split(refers_to, "!"), -1), F.lit(":"))
