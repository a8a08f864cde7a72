"""Text sheets: plates, wide tables and regular tables from rows with alike columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addr import column_letter
from ..functions.typing import strip
from ..store import keep
from ..model import KEY, PLATES, Config, truthy, valued
from . import islands
from .grid import join_regions
from .simple import headers

# Words of instrument headers.
INSTRUMENT_WORDS = ("sample", "well", "name", "value", "result", "concentration", "absorbance", "fluorescence", "mean", "std", "cv", "temperature")
WIDE, WIDE_ROWS, WIDE_COLS = 50, 10, 200


def plate_wells(height: Column, width: Column) -> Column:
    """struct(wells, rows) of the plate whose labelled grid has just this height and width, either way up; null if none."""
    shapes = [(wells, rows, cols) for wells, (a, b) in PLATES.items() for rows, cols in ((a, b), (b, a))]
    hits = [F.when((height == rows + 1) & (width == cols + 1), F.struct(F.lit(wells).alias("wells"), F.lit(rows).alias("rows"))) for wells, rows, cols in shapes]
    return F.coalesce(*hits)


def plates(cells: DataFrame, regions: DataFrame, ids: list[str]) -> DataFrame:
    """Regions of a plate's shape whose first column has the row letters on three quarters of the rows: adds wells. Letters go on as AA, AB, ..."""
    shaped = regions.withColumn("plate", plate_wells(F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1)).where("plate is not null")
    at = join_regions(cells.select(*KEY, "r", "c", "val_str"), shaped.select(*KEY, *ids, "r0", "c0", "r1", "c1", "plate")).where("c = c0 and r > r0")
    hit = F.upper(strip(F.col("val_str"))) == column_letter(F.col("r") - F.col("r0") - 1)
    good = at.groupBy(*KEY, *ids, "plate").agg(F.count_if(hit).alias("k")).where(F.col("k") >= 0.75 * F.col("plate")["rows"])
    return shaped.drop("plate").join(good.select(*KEY, *ids, F.col("plate")["wells"].alias("wells")), [*KEY, *ids])


def wide_tables(cells: DataFrame) -> DataFrame:
    """Tables of 50 columns or more that start in the first ten rows: bounds, and the plate size where labels show one."""
    top = cells.where((F.col("c") < WIDE_COLS) & (F.col("r") < WIDE_ROWS + 4) & valued())
    rows = top.groupBy(*KEY, "r").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.collect_list("c").alias("cols"))
    w = Window.partitionBy(*KEY).orderBy("r")
    go, last = F.lit(True), F.col("r")
    for k in (1, 2, 3, 4):  # a next row goes on with the table if it has enough cells under the first row's span
        nxt = F.lead(F.struct("r", "cols"), k).over(w)
        rows = rows.withColumn(f"x{k}", (nxt["r"] == F.col("r") + k) & (F.size(F.filter(nxt["cols"], lambda c: c.between(F.col("lo"), F.col("hi")))) >= 0.3 * F.col("n")))
        go = go & F.coalesce(f"x{k}", F.lit(False))
        last = F.when(go, F.col("r") + k).otherwise(last)
    starts = rows.where((F.col("r") < WIDE_ROWS) & (F.col("n") >= WIDE))
    starts = starts.select(*KEY, F.struct(F.col("r").alias("r0"), F.col("lo").alias("c0"), last.cast("int").alias("r1"), F.col("hi").alias("c1")).alias("t"))
    # ten starts a sheet at most: in order, a row that a table before takes in starts none of its own
    free = lambda a, t: F.when((F.size(a) == 0) | (t["r0"] > F.element_at(a, -1)["r1"]), F.concat(a, F.array(t))).otherwise(a)
    found = starts.groupBy(*KEY).agg(F.sort_array(F.collect_list("t")).alias("all"))
    none = F.slice("all", 1, 0)
    found = found.select(*KEY, F.inline(F.aggregate("all", none, lambda a, t: F.when(F.size(a) == 0, F.array(t)).otherwise(free(a, t))))).where(F.col("c1") - F.col("c0") >= WIDE)
    label = F.array(*[F.lit(str(i)) for i in range(1, 13)])
    at = join_regions(cells.select(*KEY, "r", "c", "val_str"), found).where("r = r0").groupBy(*KEY, "r0", "c0", "r1", "c1").agg(F.size(F.array_intersect(F.collect_set(strip(F.col("val_str"))), label)).alias("labels"))
    width, height = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    low = height.between(1, 4)
    kind = F.when(width.between(90, 100) & low & (F.col("labels") >= 10), "96-well").when(width.between(370, 400) & low, "384-well")
    return found.join(at, [*KEY, "r0", "c0", "r1", "c1"], "left").withColumn("plate_format", kind).drop("labels")


def enhance(cells: DataFrame, tables: DataFrame, ids: list[str]) -> DataFrame:
    """Adds header_keywords and instrument_output: whether 0.3 of the first row's texts have an instrument word."""
    first = join_regions(cells, tables.select(*KEY, *ids, "r0", "c0", "r1", "c1")).where(F.col("r") == F.col("r0")).where(truthy())
    word = reduce(lambda a, b: a | b, [F.contains(F.lower("val_str"), F.lit(x)) for x in INSTRUMENT_WORDS])
    s = first.groupBy(*KEY, *ids).agg(F.count_if(word).alias("header_keywords"), F.count(F.lit(1)).alias("k"))
    out = tables.join(s, [*KEY, *ids], "left").fillna({"header_keywords": 0, "k": 0})
    return out.withColumn("instrument_output", F.col("header_keywords") >= 0.3 * F.col("k")).drop("k")


def detect(cells: DataFrame) -> DataFrame:
    """Tables of a text sheet: plates, regular tables under 50 columns, and wide tables whose range is not taken."""
    found = islands.detect_structural(cells, Config(min_island_size=2, empty_row_tolerance=1)).select(*KEY, "seq", "r0", "c0", "r1", "c1", "confidence").transform(keep)
    plate = plates(cells, found, ["seq"]).select(*KEY, "seq", "wells")
    found = found.join(plate, [*KEY, "seq"], "left")
    regular = found.where((F.col("wells").isNotNull()) | (F.col("c1") - F.col("c0") + 1 < WIDE)).select(
        *KEY,
        "r0",
        "c0",
        "r1",
        "c1",
        F.when(F.col("wells").isNotNull(), 0.95).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("wells").isNotNull(), "plate_format_detection").otherwise("structured_text_detection").alias("method"),
        F.when(F.col("wells").isNotNull(), F.concat(F.lit("plate_"), F.col("wells").cast("string"), F.lit("well_"), F.concat_ws("_", "r0", "c0"))).otherwise(F.concat_ws("_", F.lit("structured"), "r0", "c0")).alias("table_id"),
    )
    wide = wide_tables(cells).join(regular.select(*KEY, "r0", "c0", "r1", "c1"), [*KEY, "r0", "c0", "r1", "c1"], "left_anti")
    wide = wide.select(*KEY, "r0", "c0", "r1", "c1", F.lit(0.85).alias("confidence"), F.lit("wide_table_detection").alias("method"), F.concat_ws("_", F.lit("wide"), "r0", "c0").alias("table_id"))
    both = regular.unionByName(wide).transform(keep)
    named = headers(cells, both, ["table_id"], lambda c: F.concat(F.lit("Column_"), (c + 1).cast("string")))
    return enhance(cells, both.join(named, [*KEY, "table_id"], "left"), ["table_id"])
