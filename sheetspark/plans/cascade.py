"""Table detection of sheets: the cheap detectors first, each later one only for sheets that are still open.

Table-level results of a detector are written to the shared folder, since later ones and the final filter read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addr import column_letter
from ..model import KEY, Config, valued
from ..operators import boxes, islands, simple, structured
from ..store import keep, keep_buckets
from ..operators.grid import band, join_regions, laid, on_sheets, totals_of

OUT = [*KEY, "table_id", "r0", "c0", "r1", "c1", "confidence", "method", "has_headers"]
BOUNDS = ["r0", "c0", "r1", "c1"]
ULTRA_FAST, FAST, LARGE_AREA = 0.89, 0.95, 10_000
TEXT_METHODS = ("plate_format_detection", "structured_text_detection", "wide_table_detection")


def detect_tables(cells: DataFrame, sheets: DataFrame | None = None, config: Config = Config(confidence_threshold=0.6)) -> DataFrame:
    """Tables of every sheet: bounds, confidence, method, headers, cell count and order.

    sheets may give file_type by sheet; text types skip boxes and use the structured detector for tsv and txt.
    """
    cells = laid(cells)
    rows, size = simple.sums(cells)
    kinds = size.select(*KEY) if sheets is None else sheets.select(*KEY, F.col("file_type") if "file_type" in sheets.columns else F.lit(None).cast("string").alias("file_type"))
    if "file_type" not in kinds.columns:
        kinds = kinds.withColumn("file_type", F.lit(None).cast("string"))
    threshold = config.confidence_threshold
    s = simple.judged(cells, rows, size).where(F.col("is_simple") & F.lit(config.enable_simple))
    area = (F.col("max_row") + 1) * (F.col("max_col") + 1)
    ultra = (F.col("confidence") >= ULTRA_FAST) & (area > LARGE_AREA)
    s = s.withColumn("method", F.when(ultra, "ultra_fast").when(F.col("confidence") >= FAST, "simple_case_fast"))
    s = s.withColumn("table_id", F.concat_ws("_", F.lit("simple"), "r0", "c0")).transform(keep)
    done = s.where("method is not null")
    found = [done.select(*OUT)]
    open_ = kinds.join(done.select(*KEY), KEY, "left_anti").transform(keep)

    if not open_.isEmpty():
        found += _later(cells, rows, size, s, open_, threshold, config)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return _finish(cells, size, every.transform(keep), config)


def _later(cells: DataFrame, rows: DataFrame, size: DataFrame, s: DataFrame, open_: DataFrame, threshold: float, config: Config) -> list[DataFrame]:
    """Tables of the sheets that are still open: boxes, then islands or text structure, then a weaker single table."""
    found = []

    def rest(x: DataFrame, of: DataFrame) -> DataFrame:
        return keep_buckets(on_sheets(x, of, rows), [*KEY, "_band"], dealt=True)

    text = F.coalesce(F.col("file_type").isin("tsv", "txt"), F.lit(False))
    if config.enable_boxes and config.use_border_detection:
        b = boxes.detect(cells, open_.where(~F.coalesce(F.col("file_type").isin("csv", "tsv", "txt"), F.lit(False))), rows)
        b = b.transform(keep)
        b = b.join(_has_headers(cells, b), [*KEY, "table_id"]).select(*OUT).transform(keep)
        found.append(b)
        open_ = open_.join(b.select(*KEY).distinct(), KEY, "left_anti").transform(keep)
    if config.enable_islands:
        texts, others = open_.where(text).transform(keep), open_.where(~text).transform(keep)
        parts = []
        if not texts.isEmpty():
            parts.append(structured.detect(rest(cells, texts)).withColumn("has_headers", F.col("instrument_output")).select(*OUT).transform(keep))
        if not others.isEmpty():
            own = size.select(*KEY, "total", "max_row", "max_col").join(others, KEY, "left_semi").transform(keep)
            i = islands.detect(cells, config, own, rest(rows, others)).where(F.col("confidence") >= threshold)
            parts.append(i.withColumns({"table_id": F.concat_ws("_", F.lit("island"), "r0", "c0"), "method": F.lit("island_detection")}).select(*OUT).transform(keep))
        found += parts
        for x in parts:
            open_ = open_.join(x.select(*KEY).distinct(), KEY, "left_anti")
    fallback = s.where(F.col("method").isNull() & (F.col("confidence") >= threshold)).join(open_.select(*KEY), KEY, "left_semi")
    found.append(fallback.withColumn("method", F.lit("simple_case")).select(*OUT))
    return found


def _has_headers(cells: DataFrame, tables: DataFrame) -> DataFrame:
    at = join_regions(cells, tables.select(*KEY, "table_id", *BOUNDS))
    return at.groupBy(*KEY, "table_id").agg(simple.header_flags(F.col("r") == F.col("r0"), F.col("r") == F.col("r0") + 1).alias("has_headers"))


def size_filter(cells: DataFrame, tables: DataFrame, share: float = 0.005, totals: DataFrame | None = None) -> DataFrame:
    """tables with n_cells (cells with a value) and total (stored cells of the sheet), those under the share of the sheet left out."""
    counted = join_regions(cells.where(valued()).select(*KEY, *band(cells), "r", "c"), tables.select(*KEY, "table_id", *BOUNDS)).groupBy(*KEY, "table_id").agg(F.count(F.lit(1)).alias("n_cells"))
    out = tables.join(counted, [*KEY, "table_id"], "left").fillna({"n_cells": 0}).join(totals_of(cells) if totals is None else totals, KEY)
    return out.where(F.col("n_cells") >= F.floor(F.col("total") * share))


def _finish(cells: DataFrame, size: DataFrame, tables: DataFrame, config: Config) -> DataFrame:
    out = size_filter(cells, tables, config.min_table_percentage if config.adaptive_thresholds else 0.0, size.select(*KEY, "total"))
    if config.min_table_size:
        out = out.where((F.col("r1") - F.col("r0") + 1 >= config.min_table_size[0]) & (F.col("c1") - F.col("c0") + 1 >= config.min_table_size[1]))
    first = [F.desc("n_cells")] if config.prefer_large_tables else []
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy(*KEY).orderBy(*first, "r0", "c0")) - 1)
    if config.max_tables_per_sheet is not None:
        out = out.where(F.col("seq") < config.max_tables_per_sheet)
    share = F.col("n_cells") / F.col("total")
    out = out.withColumn("size_class", F.when(share >= 0.05, "large").when(share >= 0.01, "medium").otherwise("small"))
    out = out.transform(keep)
    numbered = F.col("method").isin(*TEXT_METHODS)
    placeholder = lambda c: F.when(numbered, F.concat(F.lit("Column_"), (c + 1).cast("string"))).otherwise(column_letter(c))
    named = simple.headers(cells, out, ["table_id", "method"], placeholder).drop("method")
    # only a box without headers has no names; all others take their first row's
    return out.join(named, [*KEY, "table_id"], "left").withColumn("headers", F.when((F.col("method") != "box_table") | F.col("has_headers"), F.col("headers")))
