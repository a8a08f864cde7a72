"""Extraction: where a range's headers are, its rows of data, and how good the result is.

Candidates for the header (first row, depth) are scored for all tables at once: rows are numbered inside their table,
column types are counted once for each first row of data that candidates share, in one aggregation of a table's top
rows, and the best candidate is an ordered maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addr import column_letter
from ..functions.typing import cell_kind, strip, to_float
from ..store import keep
from ..model import KEY, PLATES, filled
from .grid import join_regions

TABLE = [*KEY, "table_id"]
BOX = ["r0", "c0", "r1", "c1"]
SAMPLE, STARTS, DEPTHS = 100, 10, (1, 2, 3)
KINDS = ("numeric", "text", "date", "boolean")


def matrix(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Non-empty cells of each table by place in it: i, j, v, kind, and the table's height and width."""
    at = join_regions(cells, tables.select(*TABLE, *BOX)).where(filled())
    kind = cell_kind(F.col("val_str"), F.col("vtype"))
    return at.select(*TABLE, (F.col("r") - F.col("r0")).alias("i"), (F.col("c") - F.col("c0")).alias("j"), F.col("val_str").alias("v"), kind.alias("kind"), (F.col("r1") - F.col("r0") + 1).alias("h"), (F.col("c1") - F.col("c0") + 1).alias("w"), F.col("vtype"))


def density(m: DataFrame) -> DataFrame:
    return m.groupBy(*TABLE, "h", "w").agg((F.count(F.lit(1)) / (F.first("h") * F.first("w"))).alias("density"))


def row_facts(m: DataFrame) -> DataFrame:
    """Per row of a table: filled cells, text cells, distinct texts, coverage and whether it is a title."""
    s = m.groupBy(*TABLE, "h", "w", "i").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "text").alias("texts"), F.count_distinct("v").alias("distinct"))
    return s.withColumns({"coverage": F.col("n") / F.col("w"), "is_title": (F.col("n") <= 2) & (F.col("w") > 3)})


def type_consistency(m: DataFrame, firsts: range) -> DataFrame:
    """types: for each first row of data, the mean over columns of the share of the commonest kind in SAMPLE rows from there on."""
    within = lambda f: F.count_if(F.col("i").between(f, f + SAMPLE - 1))
    kinds = m.where(F.col("i") < firsts.stop - 1 + SAMPLE).groupBy(*TABLE, "j", "kind").agg(*[within(f).alias(f"k{f}") for f in firsts])
    share = kinds.groupBy(*TABLE, "j").agg(*[F.try_divide(F.max(f"k{f}"), F.sum(f"k{f}")).alias(f"k{f}") for f in firsts])
    return share.groupBy(*TABLE).agg(F.array(*[F.avg(f"k{f}") for f in firsts]).alias("all_types"))


def column_types(m: DataFrame, first_row: int = 1) -> DataFrame:
    """Commonest kind of each column from a row on, ties in the order numeric, text, date, boolean."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, -i)])
    s = m.where(F.col("i") >= first_row).groupBy(*TABLE, "j", "kind").agg(F.count(F.lit(1)).alias("k"))
    return s.groupBy(*TABLE, "j").agg(F.max_by("kind", F.struct("k", order[F.col("kind")])).alias("kind"), (F.max("k") / F.sum("k")).alias("share"))


def header_scores(m: DataFrame) -> DataFrame:
    """Scores of every header candidate (start, depth) that leaves two rows or more."""
    rows = row_facts(m.where(F.col("i") < STARTS + len(DEPTHS)))
    size = m.select(*TABLE, "h", "w").distinct().where("h > 2")
    c = size.withColumn("start", F.explode(F.sequence(F.lit(0), F.least(F.lit(STARTS), F.col("h") - 2) - 1)))
    c = c.withColumn("depth", F.explode(F.array(*map(F.lit, DEPTHS)))).where(F.col("start") + F.col("depth") <= F.col("h") - 2)
    # a row with one or two cells of more than three is a title, and so is an empty one
    c = c.join(rows.select(*TABLE, F.col("i").alias("start"), "n"), [*TABLE, "start"], "left").where((F.coalesce("n", F.lit(0)) > 2) | (F.col("w") <= 3)).drop("n")
    first = F.col("start") + F.col("depth")
    types = type_consistency(m, range(1, STARTS + len(DEPTHS)))
    head = c.join(rows.drop("h", "w"), TABLE).where((F.col("i") >= F.col("start")) & (F.col("i") < first))
    parts = head.groupBy(*TABLE, "start", "depth").agg(
        F.sum(F.col("texts") / F.col("n")).alias("texty"),
        F.count(F.lit(1)).alias("rows"),
        F.max(F.when(F.col("i") == first - 1, F.col("distinct") / F.col("n"))).alias("unique"),
        F.max(F.when(F.col("i") == F.col("start"), F.col("coverage"))).alias("coverage"),
    )
    quality = (F.col("texty") + F.coalesce("unique", F.lit(0.0))) / (F.col("rows") + F.col("unique").isNotNull().cast("int"))
    s = c.join(types, TABLE, "left").withColumn("types", F.get("all_types", first - 1)).join(parts, [*TABLE, "start", "depth"], "left")
    score = 0.5 * F.coalesce("types", F.lit(0.0)) + 0.3 * F.coalesce(quality, F.lit(0.0)) + 0.2 * F.coalesce("coverage", F.lit(0.0))
    return s.select(*TABLE, "start", "depth", "types", quality.alias("quality"), "coverage", score.alias("score"))


def vertical_headers(scores: DataFrame) -> DataFrame:
    """The best candidate of each table, the earliest and shallowest of equals; at 0.5 or less there is none, with confidence 0."""
    best = F.max_by(F.struct("start", "depth", "score"), F.struct(F.round("score", 9), -F.col("start"), -F.col("depth")))  # sums in any order
    s = scores.groupBy(*TABLE).agg(best.alias("b")).where("b.score > 0.5")
    return s.select(*TABLE, "b.start", "b.depth", F.col("b.score").alias("confidence"))


def horizontal_headers(m: DataFrame, min_rows: int = 2) -> DataFrame:
    """Headers down the first column: the best score over 1 to 3 header columns that leave min_rows (uniqueness, texts, single-type columns).

    Rows without a name get one of their own, which is a text.
    """
    size = m.select(*TABLE, "h", "w").distinct()
    digits = F.regexp_replace("v", r"[.\-]", "").rlike(r"^\p{Nd}+$")
    names = m.where("j = 0").groupBy(*TABLE).agg(F.count(F.lit(1)).alias("named"), F.count_distinct("v").alias("distinct"), F.count_if(~digits).alias("texty"))
    c = size.withColumn("depth", F.explode(F.array(*map(F.lit, DEPTHS)))).where((F.col("depth") <= F.col("w") - min_rows) & (F.col("w") >= 2))
    plain = F.when(F.col("vtype").isin("number", "boolean") | ((F.col("vtype") != "datetime") & to_float(F.col("v")).isNotNull()), "numeric").when(F.col("vtype") == "datetime", "datetime").otherwise("text")
    one = m.groupBy(*TABLE, "j").agg((F.min(plain) == F.max(plain)).cast("int").alias("one"))
    single = c.join(one, TABLE).where(F.col("j") >= F.col("depth")).groupBy(*TABLE, "depth").agg(F.sum("one").alias("single"))
    s = c.join(names, TABLE, "left").join(single, [*TABLE, "depth"], "left").fillna({"named": 0, "distinct": 0, "texty": 0, "single": 0})
    unnamed = F.col("h") - F.col("named")
    score = (F.col("distinct") + unnamed) / F.col("h") * 0.3 + (F.col("texty") + unnamed) / F.col("h") * 0.3 + F.col("single") / (F.col("w") - F.col("depth")) * 0.4
    best = s.withColumn("score", score).groupBy(*TABLE).agg(F.max_by(F.struct("depth", "score"), F.struct(F.round("score", 9), -F.col("depth"))).alias("b"))
    return best.select(*TABLE, F.col("b.depth").alias("h_depth"), F.col("b.score").alias("h_confidence"))


def plates(m: DataFrame) -> DataFrame:
    """Tables whose first column and first row carry a plate's labels: wells, by least excess size."""
    label = strip(F.col("v"))
    rows = m.where("j = 0 and i > 0").where(F.upper(label) == column_letter(F.col("i") - 1)).groupBy(*TABLE).agg(F.collect_set("i").alias("rows"))
    cols = m.where("i = 0 and j > 0").where(F.regexp_replace(label, r"\.0$", "") == F.col("j").cast("string")).groupBy(*TABLE).agg(F.collect_set("j").alias("cols"))
    s = m.select(*TABLE, "h", "w").distinct().join(rows, TABLE).join(cols, TABLE)
    shapes = F.array(*[F.struct(F.lit(k).alias("wells"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (a, b) in PLATES.items() for r, c in ((a, b), (b, a))])
    run = lambda x, n: F.size(F.array_intersect(x, F.sequence(F.lit(1), n))) == n
    s = s.withColumn("p", F.explode(shapes)).where((F.col("h") >= F.col("p.r") + 1) & (F.col("w") >= F.col("p.c") + 1) & run(F.col("rows"), F.col("p.r")) & run(F.col("cols"), F.col("p.c")))
    excess = F.col("h") - F.col("p.r") + F.col("w") - F.col("p.c")
    return s.groupBy(*TABLE).agg(F.min_by("p", F.struct(excess, F.col("p.wells"))).alias("p")).select(*TABLE, F.col("p.wells").alias("wells"), F.col("p.r").alias("plate_rows"), F.col("p.c").alias("plate_cols"))


def quality(density_: Column, confidence: Column, rows: Column, cols: Column, share: Column) -> Column:
    ratio = F.least(rows / cols, cols / rows)
    return F.least(F.lit(1.0), 0.3 * density_ + F.coalesce(0.3 * confidence, F.lit(0.1)) + 0.2 * F.least(F.lit(1.0), ratio / 0.1) + 0.2 * share)


def analyse(cells: DataFrame, tables: DataFrame, min_rows: int = 2, min_density: float = 0.3) -> DataFrame:
    """Per table: density, orientation, header place and confidence, first data row or column, quality and status."""
    m = matrix(cells, tables).transform(keep)
    d = density(m)
    v, x, p = vertical_headers(header_scores(m)), horizontal_headers(m, min_rows), plates(m)
    titles = row_facts(m).where("not is_title and w > 3").groupBy(*TABLE).agg(F.min("i").alias("first_row"))
    s = d.join(v, TABLE, "left").join(x, TABLE, "left").join(p, TABLE, "left").join(titles, TABLE, "left")
    across = F.coalesce(F.col("h_confidence"), F.lit(0.0))
    up = F.coalesce(F.col("confidence"), F.lit(0.0))
    plate = F.col("wells").isNotNull()
    orientation = F.when(plate, "plate_map").when(up > across, "vertical").otherwise("horizontal")
    conf = F.when(plate, 0.95).when(up > across, up).otherwise(across)
    s = s.withColumns({"orientation": orientation, "header_confidence": conf})
    has = plate | (F.col("header_confidence") > 0.5)
    depth = F.when(plate, 1).when(~has, 0).when(F.col("orientation") == "vertical", F.col("depth")).otherwise(F.col("h_depth"))
    tested = F.least(F.lit(STARTS), F.greatest(F.lit(0), F.col("h") - 2))  # titles are looked for in these rows
    s = s.withColumns({"has_headers": has, "header_depth": depth.cast("int"), "first_row": F.least(F.coalesce("first_row", F.lit(0)), tested)})
    flat = (F.col("orientation") == "horizontal") & F.col("has_headers")
    upright = F.col("has_headers") & (F.col("orientation") == "vertical")
    data0 = F.when(flat, F.lit(0)).otherwise(F.when(upright, F.col("first_row")).otherwise(0) + F.col("header_depth"))
    s = s.withColumn("data_row", data0.cast("int")).transform(keep)
    body = m.join(s.select(*TABLE, "data_row", "orientation", "has_headers", "header_depth"), TABLE).where((F.col("i") >= F.col("data_row")) & (~flat | (F.col("j") >= F.col("header_depth"))))
    full = body.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("data_cells"))
    s = s.join(full, TABLE, "left").fillna({"data_cells": 0})
    rows = F.when(flat, F.col("w") - F.col("header_depth")).otherwise(F.col("h") - F.col("data_row"))
    cols = F.when(flat, F.col("h")).otherwise(F.col("w"))
    s = s.withColumns({"n_rows": rows.cast("int"), "n_cols": cols.cast("int")})
    q = quality(F.col("density"), F.when(F.col("has_headers"), F.col("header_confidence")), F.col("n_rows"), F.col("n_cols"), F.col("data_cells") / (F.col("n_rows") * F.col("n_cols")))
    status = F.when(F.col("density") < min_density, "too sparse").when((F.col("n_rows") < min_rows) & (F.col("orientation") != "plate_map"), "too few rows").otherwise("success")
    out = s.withColumn("status", status).withColumn("quality", F.when(F.col("status") != "success", 0.0).when(F.col("orientation") == "plate_map", 0.95).otherwise(q))
    return out.select(*TABLE, "h", "w", "density", "orientation", "has_headers", "header_confidence", F.coalesce("start", F.lit(0)).alias("header_row"), "header_depth", "data_row", "n_rows", "n_cols", "wells", "status", "quality")


def headers(cells: DataFrame, tables: DataFrame, facts: DataFrame) -> DataFrame:
    """col, header of each extracted table. Several header rows are joined, merged texts stand for all their columns, repeats beside each other go."""
    m = matrix(cells, tables)
    f = facts.where("status = 'success'").select(*TABLE, "orientation", "has_headers", "header_row", "header_depth", "n_cols", "h", "w")
    grid = f.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    place = m.join(f.drop("h", "w"), TABLE)
    up = place.where(F.col("has_headers") & (F.col("orientation") != "horizontal") & (F.col("i") >= F.col("header_row")) & (F.col("i") < F.col("header_row") + F.col("header_depth")))
    down = place.where(F.col("has_headers") & (F.col("orientation") == "horizontal") & (F.col("j") == 0))
    text = up.select(*TABLE, F.col("j").alias("col"), "i", "v").unionByName(down.select(*TABLE, F.col("i").alias("col"), F.lit(0).alias("i"), "v"))
    text = text.groupBy(*TABLE, "col").agg(F.sort_array(F.collect_list(F.struct("i", strip(F.col("v")).alias("t")))).alias("x"))
    parts = F.transform("x", lambda x: x["t"])
    once = F.filter(parts, lambda t, k: (k == 0) | (t != F.get(parts, k - 1)))
    named = grid.join(text.withColumn("header", F.array_join(once, " ")).drop("x"), [*TABLE, "col"], "left")
    fallback = F.concat(F.lit("Col_"), F.col("col").cast("string"))
    plate = F.when((F.col("orientation") == "plate_map") & (F.col("col") == 0), "Well")
    return named.select(*TABLE, "col", F.coalesce(plate, F.when(F.col("header") != "", F.col("header")), fallback).alias("header"))


def extract(cells: DataFrame, tables: DataFrame, facts: DataFrame | None = None, **options) -> DataFrame:
    """Long form: table, row, col, header, value, kind of every data cell. Tables with horizontal headers are transposed."""
    facts = analyse(cells, tables, **options) if facts is None else facts
    m = matrix(cells, tables).drop("h", "w")
    f = facts.where("status = 'success'")
    at = m.join(f.select(*TABLE, "orientation", "has_headers", "header_depth", "data_row"), TABLE)
    flat = (F.col("orientation") == "horizontal") & F.col("has_headers")
    at = at.where(F.when(flat, F.col("j") >= F.col("header_depth")).otherwise(F.col("i") >= F.col("data_row")))
    row = F.when(flat, F.col("j") - F.col("header_depth")).otherwise(F.col("i") - F.col("data_row")).cast("int")
    col = F.when(flat, F.col("i")).otherwise(F.col("j")).cast("int")
    return at.select(*TABLE, row.alias("row"), col.alias("col"), F.col("v").alias("value"), "kind").join(headers(cells, tables, facts), [*TABLE, "col"]).select(*TABLE, "row", "col", "header", "value", "kind")


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One table's long form as columns, in the order of names; rows that are wholly empty are not kept in long form."""
    return long.groupBy(*TABLE, "row").pivot("header", names).agg(F.first("value"))
