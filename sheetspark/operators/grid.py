"""The grid of a sheet: bounds, rows and columns, regions, lookups and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addr import cell_address
from ..functions.typing import data_type
from ..model import KEY, LOOKED, complete, filled, valued
from ..store import keep_buckets


def to_cells(df: DataFrame, file_id: Column, row: Column, columns: list[str], header: bool = True) -> DataFrame:
    """A relational table as a sheet: row 0 has the column names in bold, row `row` + 1 the values. No sort and no shuffle but for the header."""
    kinds = dict(df.dtypes)
    values = F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("string").alias("v"), (F.col(n).cast("double") if data_type(kinds[n]) == "number" else F.lit(None).cast("double")).alias("num"), F.lit(data_type(kinds[n])).alias("t")) for i, n in enumerate(columns)])
    body = df.select(file_id.alias("file_id"), (row + int(header)).cast("int").alias("r"), F.explode(values).alias("x"))
    out = body.select("file_id", "r", "x.c", F.col("x.v").alias("val_str"), F.col("x.num").alias("val_num"), F.when(F.col("x.v").isNull(), "empty").otherwise(F.col("x.t")).alias("vtype"), F.lit(False).alias("is_bold"))
    if header:
        names = F.posexplode(F.array(*map(F.lit, columns))).alias("c", "val_str")
        top = df.select(file_id.alias("file_id")).distinct().select("file_id", F.lit(0).alias("r"), names, F.lit(None).cast("double").alias("val_num"), F.lit("string").alias("vtype"), F.lit(True).alias("is_bold"))
        out = top.unionByName(out)
    return complete(out.withColumn("sheet_name", F.col("file_id")))


def sheet_stats(cells: DataFrame) -> DataFrame:
    """Per sheet: stored, valued and non-empty cells, high-water marks, bounds of the non-empty cells, density."""
    f = filled()
    out = cells.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(valued()).alias("n_values"),
        F.count_if(f).alias("n_filled"),
        F.max("r").alias("max_row"),
        F.max("c").alias("max_col"),
        *[fn(F.when(f, F.col(x))).alias(f"{n}_{x}") for x in ("r", "c") for n, fn in (("min", F.min), ("max", F.max))],
    )
    area = (F.col("max_r") - F.col("min_r") + 1) * (F.col("max_c") - F.col("min_c") + 1)
    return out.withColumn("density", F.coalesce(F.col("n_filled") / area, F.lit(0.0)))


def addressed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("addr", cell_address(F.col("r"), F.col("c")))


def inside(r0, c0, r1, c1) -> Column:
    return F.col("r").between(r0, r1) & F.col("c").between(c0, c1)


def region(cells: DataFrame, r0: int, r1: int, c0: int, c1: int, stored: bool = False) -> DataFrame:
    """Cells of a rectangle; non-empty ones unless stored."""
    if min(r0, c0) < 0 or r1 < r0 or c1 < c0:
        raise ValueError(f"no rectangle: rows {r0}..{r1}, columns {c0}..{c1}")
    found = cells.where(inside(r0, c0, r1, c1))
    return found if stored else found.where(filled())


#: Rows of a band: regions and cells meet on the sheet and the band, so a sheet of many regions is not compared whole.
BAND = 64


def band(cells: DataFrame) -> list[str]:
    """The column by which cells lie, if they are laid."""
    return [x for x in cells.columns if x == "_band"]


def laid(cells: DataFrame) -> DataFrame:
    """What detectors look at of cells, written in buckets of sheet and row band: sums by row, regions and choices of sheets then move no cell. A large sheet lies in many buckets."""
    if band(cells):
        return cells
    return keep_buckets(cells.select(*LOOKED, F.floor(F.col("r") / BAND).alias("_band")), [*KEY, "_band"])


def on_sheets(cells: DataFrame, sheets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Cells of the sheets; laid ones stay where they lie. rows: simple.row_totals of them at least, if at hand."""
    if not band(cells):
        return cells.join(sheets.select(*KEY), KEY, "left_semi")
    bands = (cells if rows is None else rows).select(*KEY, "_band").distinct().join(sheets.select(*KEY), KEY, "left_semi")
    return cells.join(bands.hint("shuffle_hash"), [*KEY, "_band"], "left_semi")


def join_regions(cells: DataFrame, regions: DataFrame, pad: int = 0) -> DataFrame:
    """Cells with each region (r0, c0, r1, c1) of their sheet that they lie in, or within pad of: an equi-join on sheet and row band, then the bounds."""
    lo, hi = F.greatest(F.lit(0), F.col("r0") - pad), F.col("r1") + pad
    banded = regions.withColumn("_band", F.explode(F.sequence(F.floor(lo / BAND), F.floor(hi / BAND))))
    within = F.col("r").between(F.col("r0") - pad, hi) & F.col("c").between(F.col("c0") - pad, F.col("c1") + pad)
    if band(cells):
        return cells.join(banded.hint("shuffle_hash"), [*KEY, "_band"]).where(within)
    return cells.withColumn("_band", F.floor(F.col("r") / BAND)).join(banded, [*KEY, "_band"]).where(within).drop("_band")


def dense(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Every position of each region, with its cell's columns or nulls. For header rows and extraction, not whole sheets."""
    grid = regions.withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumn("c", F.explode(F.sequence("c0", "c1")))
    return grid.join(cells, [*KEY, "r", "c"], "left")


def rows_of(cells: DataFrame) -> DataFrame:
    """Per row of a sheet: its values by column, dense up to the sheet's last column."""
    last = cells.groupBy(*KEY).agg(F.max("c").alias("last"))
    rows = cells.groupBy(*KEY, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "val_str"))).alias("by"))
    return rows.join(last, KEY).select(*KEY, "r", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.col("by")[i]).alias("vals"))


def columns_of(cells: DataFrame) -> DataFrame:
    last = cells.groupBy(*KEY).agg(F.max("r").alias("last"))
    cols = cells.groupBy(*KEY, "c").agg(F.map_from_entries(F.collect_list(F.struct("r", "val_str"))).alias("by"))
    return cols.join(last, KEY).select(*KEY, "c", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.col("by")[i]).alias("vals"))


def lookup(cells: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (key, r, c, ...) with their cells or nulls; all positions stay."""
    return positions.join(cells, [*KEY, "r", "c"], "left")


def upsert(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """cells with the changes put in; of several for a position the last by column seq. Negative positions raise an error."""
    checked = changes.withColumn("r", F.when((F.col("r") < 0) | (F.col("c") < 0), F.raise_error(F.lit("negative position"))).otherwise(F.col("r")))
    order = Window.partitionBy(*KEY, "r", "c").orderBy(F.desc("seq"))
    seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
    given = checked.withColumn("seq", seq)
    old = complete(cells)
    new = given.select(*[F.col(n) if n in given.columns else F.lit(None).alias(n) for n in old.columns], "seq")
    both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return complete(both.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "seq"))


def merged_ranges(cells: DataFrame) -> DataFrame:
    """Per sheet: its distinct merge ranges in order."""
    return cells.where("merge_range is not null").groupBy(*KEY).agg(F.array_sort(F.collect_set("merge_range")).alias("merge_ranges"))


def empty_rows(cells: DataFrame) -> DataFrame:
    return _gaps(cells, "r")


def empty_columns(cells: DataFrame) -> DataFrame:
    return _gaps(cells, "c")


def _gaps(cells: DataFrame, axis: str) -> DataFrame:
    """Runs without a non-empty cell inside the bounds, as (key, first, last): a window over the distinct positions, nothing dense."""
    have = cells.where(filled()).select(*KEY, axis).distinct()
    before = F.lag(axis).over(Window.partitionBy(*KEY).orderBy(axis))
    return have.withColumn("before", before).where(F.col(axis) > F.col("before") + 1).select(*KEY, (F.col("before") + 1).alias("first"), (F.col(axis) - 1).alias("last"))


def totals_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"))
