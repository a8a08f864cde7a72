"""Merged cells and multi-row headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addr import parse_range
from ..functions.typing import is_numeric
from ..store import keep
from ..model import KEY, valued
from .grid import inside, join_regions

TABLE = [*KEY, "table_id"]
HEADER_DEPTH, ROW_SPAN_DEPTH = 10, 5


def regions(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Merged regions: bounds, text of the first cell, spans, header likeness. With tables, those that lie inside one."""
    w = Window.partitionBy(*KEY, "merge_range").orderBy("r", "c")
    first = cells.where("merge_range is not null").withColumn("k", F.row_number().over(w)).where("k = 1")
    box = parse_range(F.col("merge_range"))
    m = first.withColumn("b", box).where("b is not null").select(*KEY, "merge_range", *[F.col("b")[x].alias(n) for x, n in (("r0", "m_r0"), ("c0", "m_c0"), ("r1", "m_r1"), ("c1", "m_c1"))], F.col("val_str").alias("text"), (F.col("is_bold") | F.col("bg_color").isNotNull()).alias("is_header"))
    m = m.withColumns({"spans_rows": F.col("m_r1") > F.col("m_r0"), "spans_cols": F.col("m_c1") > F.col("m_c0"), "area": (F.col("m_r1") - F.col("m_r0") + 1) * (F.col("m_c1") - F.col("m_c0") + 1)})
    if tables is None:
        return m
    t = tables.select(*TABLE, "r0", "c0", "r1", "c1")
    return m.join(t, KEY).where((F.col("m_r0") >= F.col("r0")) & (F.col("m_c0") >= F.col("c0")) & (F.col("m_r1") <= F.col("r1")) & (F.col("m_c1") <= F.col("c1")))


def header_regions(m: DataFrame, depth: int = HEADER_DEPTH) -> DataFrame:
    """Merged regions that look like headers: near the top with text, over columns, or higher still over rows."""
    return m.where((F.col("m_r0") < depth) & F.coalesce(F.trim("text") != "", F.lit(False)) & (F.col("spans_cols") | ((F.col("m_r0") < ROW_SPAN_DEPTH) & F.col("spans_rows"))))


def column_spans(m: DataFrame) -> DataFrame:
    """Per row: the sorted column spans of the regions that cover it."""
    return m.where("spans_cols").select(*KEY, F.explode(F.sequence("m_r0", "m_r1")).alias("r"), "m_c0", "m_c1").groupBy(*KEY, "r").agg(F.sort_array(F.collect_list(F.struct("m_c0", "m_c1"))).alias("spans"))


def hierarchy(m: DataFrame) -> DataFrame:
    """Per level (first row): the regions by column."""
    return m.groupBy(*KEY, F.col("m_r0").alias("level")).agg(F.sort_array(F.collect_list(F.struct("m_c0", "m_c1", "text"))).alias("regions"))


def column_headers(m: DataFrame) -> DataFrame:
    """Per table column: the texts of the regions over it, top down."""
    over = m.select(*TABLE, "m_r0", "text", F.explode(F.sequence("m_c0", "m_c1")).alias("at"), "c0")
    got = over.groupBy(*TABLE, (F.col("at") - F.col("c0")).alias("col")).agg(F.sort_array(F.collect_list(F.struct("m_r0", "text"))).alias("x"))
    return got.withColumn("texts", F.transform("x", lambda x: x["text"])).drop("x")


def header_row_counts(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """n_header_rows per table: below the deepest merged header, rows go on being headers until data or a change of format."""
    t = tables.select(*TABLE, "r0", "c0", "r1", "c1")
    deep = header_regions(regions(cells, t)).groupBy(*TABLE).agg((F.max("m_r1") - F.max("r0") + 1).alias("deep"))
    t = t.join(deep, TABLE, "left").withColumn("start", F.least(F.greatest(F.coalesce("deep", F.lit(1)), F.lit(1)), F.col("r1") - F.col("r0") + 1))
    at = join_regions(cells, t).where(F.col("r") < F.col("r0") + F.least(F.lit(10), F.col("r1") - F.col("r0") + 1))
    w = Window.partitionBy(*TABLE, "c").orderBy("r")
    before = F.lag(F.struct("r", "is_bold", "bg_color")).over(w)
    at = at.withColumn("p", before).withColumn("p", F.when(F.col("p")["r"] == F.col("r") - 1, F.col("p")))
    pair = F.col("p").isNotNull()
    s = at.groupBy(*TABLE, "start", "r0", "r").agg(
        F.count_if(valued()).alias("n"),
        F.count_if(valued() & ((F.col("vtype") == "number") | is_numeric(F.col("val_str")))).alias("num"),
        F.count_if(valued() & F.col("is_bold")).alias("bold"),
        F.count_if(pair).alias("pairs"),
        F.count_if(pair & (F.col("p")["is_bold"] != F.col("is_bold"))).alias("d_bold"),
        F.count_if(pair & ~F.col("p")["bg_color"].eqNullSafe(F.col("bg_color"))).alias("d_bg"),
    )
    i = F.col("r") - F.col("r0")
    header = (F.col("bold") / F.col("n") > 0.5) & (F.col("num") / F.col("n") < 0.2)
    change = (F.col("d_bold") + F.col("d_bg") > 0.5 * F.col("pairs")) & (i > 0)
    stop = (F.col("n") > 0) & ~header & ((F.col("num") / F.col("n") > 0.8) | change)
    stops = s.where((i >= F.col("start")) & stop).groupBy(*TABLE).agg(F.min(i).alias("at"))
    return t.join(stops, TABLE, "left").select(*TABLE, "r0", "c0", "r1", "c1", F.coalesce("at", "start").cast("int").alias("n_header_rows"))


def multi_row_headers(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with two header rows or more: each column's texts by header row, and a confidence. Bold counts for cells that are not merged."""
    t = header_row_counts(cells, tables).where("n_header_rows > 1").transform(keep)
    m = header_regions(regions(cells, t.select(*TABLE, "r0", "c0", "r1", "c1"))).join(t.select(*TABLE, "n_header_rows"), TABLE).where(F.col("m_r0") - F.col("r0") < F.col("n_header_rows"))
    head = m.select(*TABLE, (F.col("m_r0") - F.col("r0")).alias("row"), F.col("m_c0").alias("lo"), F.col("m_c1").alias("hi"), "text", F.lit(False).alias("bold"), F.lit(True).alias("merged"), "m_r0", "m_c0", "m_r1", "m_c1", "c0")
    at = join_regions(cells, t.withColumn("r1", F.col("r0") + F.col("n_header_rows") - 1)).select(*TABLE, "r", "c", "val_str", "is_bold", "r0", "c0")
    cover = m.select(*TABLE, "m_r0", "m_c0", "m_r1", "m_c1")
    free = at.join(cover, (at.file_id == cover.file_id) & (at.sheet_idx == cover.sheet_idx) & (at.table_id == cover.table_id) & at.r.between(cover.m_r0, cover.m_r1) & at.c.between(cover.m_c0, cover.m_c1), "left_anti")
    plain = free.select(*TABLE, (F.col("r") - F.col("r0")).alias("row"), F.col("c").alias("lo"), F.col("c").alias("hi"), F.col("val_str").alias("text"), F.col("is_bold").alias("bold"), F.lit(False).alias("merged"), "c0")
    both = head.select(*plain.columns).unionByName(plain)
    maps = both.where(F.coalesce(F.trim("text") != "", F.lit(False))).select(*TABLE, "row", "text", F.explode(F.sequence("lo", "hi")).alias("at"), "c0")
    maps = maps.groupBy(*TABLE, (F.col("at") - F.col("c0")).alias("col")).agg(F.sort_array(F.collect_list(F.struct("row", "text"))).alias("x")).withColumn("texts", F.transform("x", lambda x: x["text"])).drop("x")
    shape = maps.groupBy(*TABLE).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "texts")))).alias("columns"), F.var_pop(F.size("texts")).alias("var"), F.avg(F.size("texts")).alias("mean"))
    s = both.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"), F.count_if("merged").alias("m"), F.count_if(F.coalesce(F.trim("text") != "", F.lit(False))).alias("full"), F.count_if("bold").alias("b"))
    n = F.col("n")
    conf = (F.least(F.lit(1.0), 2 * F.col("m") / n) + (1 - F.least(F.lit(1.0), F.col("var") / F.col("mean"))) + F.col("full") / n + F.col("b") / n) / 4
    return t.join(s, TABLE).join(shape, TABLE).select(*TABLE, "n_header_rows", "columns", conf.alias("confidence"))
