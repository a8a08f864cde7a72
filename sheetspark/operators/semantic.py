"""Semantic rows of a table: headers, sections, subtotals, totals, blanks; format patterns; blanks worth keeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLANK_SHARE, FIRST_ROWS, KEY, MIN_PATTERN_ROWS, SAME_COLUMN, SAMPLE_ROWS, SECTION_WORDS, SUBTOTAL_WORDS, TOTAL_BOLD, TOTAL_WORDS, truthy, valued
from .grid import join_regions

TABLE = [*KEY, "table_id"]


def has_word(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def rows(cells: DataFrame, tables: DataFrame, header_rows: int = 1) -> DataFrame:
    """Per row of each table (bounds inclusive): i (0-based in the table), kind, confidence. Rows without a cell are blank."""
    if header_rows < 0:
        raise ValueError("header_rows must not be negative")
    every = tables.select(*TABLE, "r0", "c0", "r1", "c1", F.explode(F.sequence("r0", "r1")).alias("r"))
    own = F.struct("c", "val_str", truthy().alias("t"), F.col("is_bold").alias("b"), F.col("bg_color").isNotNull().alias("g"))
    at = join_regions(cells, tables.select(*TABLE, "r0", "c0", "r1", "c1")).groupBy(*TABLE, "r").agg(F.sort_array(F.collect_list(own)).alias("cells"), F.count_if(valued()).alias("nv"))
    x = every.join(at, [*TABLE, "r"], "left")
    width, height = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    i = F.col("r") - F.col("r0")
    cells_ = F.coalesce("cells", F.expr("array()").cast("array<struct<c:int,val_str:string,t:boolean,b:boolean,g:boolean>>"))
    x = x.withColumns({"i": i, "cells": cells_, "nv": F.coalesce("nv", F.lit(0))})
    x = x.withColumn("text", F.lower(F.array_join(F.transform(F.filter("cells", lambda c: c["t"]), lambda c: c["val_str"]), " ")))
    n = F.size("cells")
    bold_total = F.size(F.filter("cells", lambda c: c["b"])) > TOTAL_BOLD * n
    first = F.get("cells", F.lit(0))
    lone = first["t"] & (F.size(F.filter("cells", lambda c: c["t"])) == 1)
    section = (F.coalesce(lone, F.lit(False)) & (first["b"] | first["g"])) | has_word(F.col("text"), SECTION_WORDS)
    separator = (F.size(F.filter("cells", lambda c: c["t"])) <= 1) & F.exists("cells", lambda c: c["g"])
    blank = (width - F.col("nv")) / width >= BLANK_SHARE
    kind = (
        F.when(blank, "BLANK")
        .when(i < header_rows, "HEADER")
        .when(has_word(F.col("text"), SUBTOTAL_WORDS), "SUBTOTAL")
        .when(has_word(F.col("text"), TOTAL_WORDS), F.when((i >= height - 2) & bold_total, "TOTAL").otherwise("SUBTOTAL"))
        .when(section, "SECTION_HEADER")
        .when(separator, "SEPARATOR")
        .otherwise("DATA")
    )
    score = F.create_map(*[F.lit(v) for kv in {"BLANK": 1.0, "HEADER": 1.0, "SUBTOTAL": 0.9, "TOTAL": 0.9, "SECTION_HEADER": 0.8, "SEPARATOR": 0.85, "DATA": 0.7}.items() for v in kv])
    return x.withColumn("kind", kind).select(*TABLE, "r", "i", "kind", score[F.col("kind")].alias("confidence"))


def sections(semantic: DataFrame) -> DataFrame:
    """(first, last) of each section: from its header to the row before the next header, or before a blank or separator more than a row later."""
    w = Window.partitionBy(*TABLE).orderBy("i")
    s = semantic.withColumn("no", F.sum((F.col("kind") == "SECTION_HEADER").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("no > 0")
    start = F.min("i").over(Window.partitionBy(*TABLE, "no"))
    s = s.withColumn("first", start).withColumn("stop", F.when(F.col("kind").isin("BLANK", "SEPARATOR") & (F.col("i") > F.col("first") + 1), F.col("i")))
    return s.groupBy(*TABLE, "no", "first").agg(F.coalesce(F.min("stop") - 1, F.max("i")).cast("int").alias("last")).select(*TABLE, "first", "last")


def alternating_backgrounds(cells: DataFrame, tables: DataFrame, semantic: DataFrame) -> DataFrame:
    """Tables whose first data rows alternate between two colours in their first cell: colours in order, confidence .95."""
    data = semantic.where("kind = 'DATA'")
    w = Window.partitionBy(*TABLE).orderBy("i")
    first = data.withColumns({"k": F.row_number().over(w), "of": F.count(F.lit(1)).over(Window.partitionBy(*TABLE))}).where((F.col("of") >= MIN_PATTERN_ROWS) & (F.col("k") <= FIRST_ROWS))
    at = first.join(tables.select(*TABLE, F.col("c0").alias("c")), TABLE).join(cells.select(*KEY, "r", "c", "bg_color"), [*KEY, "r", "c"], "left")
    same = (F.col("bg_color") == F.lag("bg_color").over(w)).cast("int")
    s = at.withColumn("same", same).groupBy(*TABLE).agg(F.count_distinct("bg_color").alias("n"), F.count_if(F.col("bg_color").isNull()).alias("none"), F.coalesce(F.sum("same"), F.lit(0)).alias("same"), F.array_sort(F.collect_set("bg_color")).alias("colors"))
    return s.where("n = 2 and none = 0 and same = 0").select(*TABLE, F.array_join("colors", ",").alias("colors"), F.lit(0.95).alias("confidence"))


def column_patterns(cells: DataFrame, tables: DataFrame, semantic: DataFrame) -> DataFrame:
    """Columns of one alignment (.9) or mostly bold (.85), judged by the first 20 data rows; bold is counted against all data rows."""
    data = semantic.where("kind = 'DATA'").withColumns({"k": F.row_number().over(Window.partitionBy(*TABLE).orderBy("i")), "of": F.count(F.lit(1)).over(Window.partitionBy(*TABLE))}).where(F.col("k") <= SAMPLE_ROWS)
    at = join_regions(cells, tables.select(*TABLE, "r0", "c0", "r1", "c1")).select(*TABLE, "r", "c", "is_bold", "halign")
    s = at.join(data.select(*TABLE, "r", "of"), [*TABLE, "r"]).groupBy(*TABLE, "c").agg(F.count_distinct("halign").alias("aligns"), F.max("halign").alias("align"), F.count_if("is_bold").alias("bold"), F.max("of").alias("of"))
    align = s.where("aligns = 1").select(*TABLE, "c", F.lit("column_alignment").alias("pattern"), F.col("align").alias("value"), F.lit(0.9).alias("confidence"))
    bold = s.where(F.col("bold") > SAME_COLUMN * F.col("of")).select(*TABLE, "c", F.lit("column_bold").alias("pattern"), F.lit("bold").alias("value"), F.lit(0.85).alias("confidence"))
    return align.unionByName(bold)


def semantic_blanks(semantic: DataFrame, found: DataFrame) -> DataFrame:
    """Blank rows at a section's edge or beside a subtotal or total; a row may be there for both reasons, twice."""
    blank = semantic.where("kind = 'BLANK'").select(*TABLE, "i")
    edges = found.select(*TABLE, F.explode(F.array(F.col("first") - 1, F.col("last") + 1)).alias("i"))
    edge = blank.join(edges.distinct(), [*TABLE, "i"])
    w = Window.partitionBy(*TABLE).orderBy("i")
    totals = ("SUBTOTAL", "TOTAL")
    near = semantic.withColumn("beside", F.coalesce(F.lag("kind").over(w).isin(*totals), F.lit(False)) | F.coalesce(F.lead("kind").over(w).isin(*totals), F.lit(False))).where("kind = 'BLANK' and beside").select(*TABLE, "i")
    return edge.unionByName(near)


def flags(semantic: DataFrame) -> DataFrame:
    return semantic.groupBy(*TABLE).agg(F.max((F.col("kind") == "SUBTOTAL").cast("int")).cast("boolean").alias("has_subtotals"), F.max((F.col("kind") == "TOTAL").cast("int")).cast("boolean").alias("has_grand_total"))


def signatures(cells: DataFrame) -> DataFrame:
    """Per cell the format that likeness is judged by. Borders are no part of a cell's own signature: both are false."""
    ground = F.coalesce(F.col("bg_color") != "", F.lit(False))
    return cells.select(*KEY, "r", "c", F.col("is_bold").alias("bold"), F.col("is_italic").alias("italic"), ground.alias("ground"), F.lit(False).alias("top"), F.lit(False).alias("bottom"), F.col("bg_color").alias("color"), F.col("font_size").alias("size"), F.col("halign").alias("align"), "indent")


def format_likeness(a: str = "a_", b: str = "b_") -> Column:
    """Likeness of two signatures, by prefix of their columns: five switches, colour where both have one, half weight for indent."""
    x, y = (lambda n: F.col(a + n)), (lambda n: F.col(b + n))
    same = sum([(x(n) == y(n)).cast("double") for n in ("italic", "ground", "top", "bottom")], (x("bold") == y("bold")).cast("double"))
    colours = x("ground") & y("ground")
    got = same + F.when(colours & x("color").eqNullSafe(y("color")), 1.0).otherwise(0.0) + F.when(x("indent") == y("indent"), 0.5).otherwise(0.0)
    return got / (5.5 + F.when(colours, 1.0).otherwise(0.0))
