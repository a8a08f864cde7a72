"""Single-table detection: one table that fills the sheet from near its top left, from sums by row and by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addr import column_letter, format_range
from ..functions.typing import strip
from ..model import KEY, filled, valued
from ..store import keep, keep_buckets
from .grid import BAND, band, on_sheets


#: Columns that are counted as bits of a number; sheets with more are counted by column.
BITS = 64


def row_totals(cells: DataFrame) -> DataFrame:
    """Per row of a sheet: its cells, its non-empty cells (all, other than text, bold), their first and last column, the first columns in use as bits, the last column of any cell."""
    f = filled()
    return cells.groupBy(*KEY, *band(cells), "r").agg(
        F.count(F.lit(1)).alias("stored"),
        F.count_if(f).alias("nf"),
        F.count_if(f & (F.col("vtype") != "string")).alias("other"),
        F.count_if(f & F.col("is_bold")).alias("bold"),
        F.min(F.when(f, F.col("c"))).alias("lo"),
        F.max(F.when(f, F.col("c"))).alias("hi"),
        F.max("c").alias("last"),
        F.bit_or(F.when(f & (F.col("c") < BITS), F.expr("shiftleft(1L, c)"))).alias("cols"),
        F.max(F.when((F.col("r") == 0) & (F.col("c") == 0) & valued(), 1)).alias("corner"),
    )


def bounds(rows: DataFrame) -> DataFrame:
    """Per sheet counts, extent and r0, r1, c0, c1: the whole sheet where A1 has a value and the sheet is over 0.3 full, else the non-empty cells. rows: row_totals."""
    has = F.col("nf") > 0
    s = rows.groupBy(*KEY).agg(
        F.sum("stored").alias("total"),
        F.sum("nf").alias("n_filled"),
        F.bit_count(F.bit_or("cols")).alias("low_cols"),
        F.count_if(has).alias("rows_used"),
        F.max("r").alias("max_row"),
        F.max("last").alias("max_col"),
        F.max("corner").alias("corner"),
        F.min(F.when(has, F.col("r"))).alias("lor"),
        F.max(F.when(has, F.col("r"))).alias("hir"),
        F.min("lo").alias("loc"),
        F.max("hi").alias("hic"),
    )
    whole = (F.col("corner") == 1) & (F.col("n_filled") / ((F.col("max_row") + 1) * (F.col("max_col") + 1)) > 0.3)
    pick = lambda a, b: F.when(F.coalesce(whole, F.lit(False)), a).otherwise(F.coalesce(b, F.lit(0))).cast("int")
    zero = F.lit(0)
    return s.select(*KEY, "total", "n_filled", "rows_used", "max_row", "max_col", "hic", "low_cols", pick(zero, F.col("lor")).alias("r0"), pick(F.col("max_row"), F.col("hir")).alias("r1"), pick(zero, F.col("loc")).alias("c0"), pick(F.col("max_col"), F.col("hic")).alias("c1"))


def header_flags(first_row, next_row):
    """Aggregates for: the first row has values, all strings, and one is bold or the next row has another type."""
    v, string = valued(), F.col("vtype") == "string"
    return (F.count_if(first_row & v) > 0) & (F.count_if(first_row & v & ~string) == 0) & ((F.count_if(first_row & v & F.col("is_bold")) > 0) | (F.count_if(next_row & v & ~string) > 0))


def confidence(r0, c0, density, has_headers, rows):
    s = F.lit(0.5)
    s = s + F.when((r0 == 0) & (c0 == 0), 0.2).when((r0 <= 1) & (c0 <= 1), 0.1).otherwise(0.0)
    s = s + F.when(density > 0.9, 0.2).when(density > 0.7, 0.1).otherwise(0.0)
    s = s + F.when(has_headers, 0.1).otherwise(0.0)
    s = s - F.when(rows < 3, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def detect(cells: DataFrame) -> DataFrame:
    """Per sheet: is_simple, reason, bounds, range, density, has_headers, confidence, last row and column.

    Cells are never shuffled: they are summed by row and by column first, and sheets are judged by those sums. Cells
    of white space alone, which count as values but not as filled, are looked at by themselves.
    """
    return judged(cells, *sums(cells))


def sums(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row_totals and bounds, written."""
    rows = row_totals(cells)
    rows = keep_buckets(rows, [*KEY, "_band"], dealt=True) if band(cells) else keep(rows)
    return rows, bounds(rows).transform(keep)


def judged(cells: DataFrame, rows: DataFrame, b: DataFrame) -> DataFrame:
    """detect from the sums of the cells."""
    height, width = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    wide = b.where((F.col("hic") >= BITS) & (F.col("r0") <= 2) & (F.col("c0") <= 2) & (F.col("rows_used") >= height))  # the others are settled by their place or rows
    counted = on_sheets(cells, wide).where(filled()).groupBy(*KEY, "c").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("counted"))
    near = band(cells)
    top = b.select(*KEY, "r0", F.explode(F.array("r0", F.col("r0") + 1)).alias("r"))
    if near:
        top = top.withColumn("_band", F.floor(F.col("r") / BAND)).hint("shuffle_hash")
    top = rows.join(top, [*KEY, *near, "r"])
    first, second = F.col("r") == F.col("r0"), F.col("r") == F.col("r0") + 1
    top = top.select(*KEY, *[F.when(on, F.col(x)).alias(n) for n, on, x in (("a_v", first, "nf"), ("a_other", first, "other"), ("a_bold", first, "bold"), ("b_other", second, "other"))], F.lit(0).cast("long").alias("blank"))
    blank = cells.where(valued() & ~filled()).select(*KEY, "r", "c", (F.col("vtype") != "string").cast("long").alias("o"), F.col("is_bold").cast("long").alias("x")).join(b.select(*KEY, "r0", "r1", "c0", "c1"), KEY)
    blank = blank.where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    one = F.lit(1).cast("long")
    blank = blank.select(*KEY, F.when(first, one).alias("a_v"), F.when(first, F.col("o")).alias("a_other"), F.when(first, F.col("x")).alias("a_bold"), F.when(second, F.col("o")).alias("b_other"), one.alias("blank"))
    head = top.unionByName(blank).groupBy(*KEY).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("a_v", "a_other", "a_bold", "b_other", "blank")])
    s = b.join(counted, KEY, "left").join(head, KEY, "left").withColumn("cols_used", F.coalesce("counted", "low_cols")).fillna({x: 0 for x in ("cols_used", "a_v", "a_other", "a_bold", "b_other", "blank")})
    s = s.withColumn("density", (F.col("n_filled") + F.col("blank")) / (height * width))
    s = s.withColumn("has_headers", (F.col("a_v") > 0) & (F.col("a_other") == 0) & ((F.col("a_bold") > 0) | (F.col("b_other") > 0)))
    reason = (
        F.when(F.col("n_filled") == 0, "no data")
        .when((F.col("r0") > 2) | (F.col("c0") > 2), "starts too far from the corner")
        .when(F.col("rows_used") < height, "empty rows")
        .when(F.col("cols_used") < width, "empty columns")
        .when(F.col("density") < 0.5, "too sparse")
        .otherwise("")
    )
    s = s.withColumn("reason", reason).withColumn("is_simple", F.col("reason") == "")
    conf = F.when(F.col("is_simple"), confidence(F.col("r0"), F.col("c0"), F.col("density"), F.col("has_headers"), height)).otherwise(0.0)
    return s.select(*KEY, "is_simple", "reason", "r0", "c0", "r1", "c1", format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")).alias("range"), "density", "has_headers", conf.alias("confidence"), "max_row", "max_col")


def headers(cells: DataFrame, regions: DataFrame, ids: list[str], placeholder=None) -> DataFrame:
    """ids, headers: first-row texts of each region, null ones replaced by the column letter or what placeholder makes of c and the ids."""
    top = regions.select(*KEY, *[i for i in ids if i not in KEY], F.col("r0").alias("r"), F.explode(F.sequence("c0", "c1")).alias("c"))
    named = top.join(cells.select(*KEY, "r", "c", "val_str"), [*KEY, "r", "c"], "left")
    text = F.coalesce(strip(F.col("val_str")), (placeholder or column_letter)(F.col("c")))
    got = named.groupBy(*KEY, *[i for i in ids if i not in KEY]).agg(F.sort_array(F.collect_list(F.struct("c", text.alias("h")))).alias("x"))
    return got.withColumn("headers", F.transform("x", lambda x: x["h"])).drop("x")
