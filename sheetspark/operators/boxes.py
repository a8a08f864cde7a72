"""Bordered boxes: corners, runs of border cells along the four edges, values counted by running sums, greedy choice.

No box is joined with its cells. Where borders run without a break, the end of each run is a column of its cells, so
an edge is whole if the run at its start reaches its end. All rows of a box have a cell on its left and right edge, so
the box's values are the difference of two running sums down those columns of the values counted along each row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY, valued
from ..store import keep
from .grid import band, on_sheets

BOX = ["r0", "c0", "r1", "c1"]


def bordered(side: str):
    return F.coalesce(F.col(side).isNotNull() & (F.col(side) != "none"), F.lit(False))


def edges(cells: DataFrame, among: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Cells with a border on sheets with a corner: ends of the runs of top, bottom, left and right borders, and running sums of values. among: the sheets to look at. rows: simple.row_totals, if at hand."""
    flags = {"t": bordered("bt"), "b": bordered("bb"), "l": bordered("bl"), "g": bordered("br")}
    corners = cells.where(flags["t"] & flags["l"]).select(*KEY).distinct()
    if among is not None:
        corners = corners.join(among.select(*KEY), KEY, "left_semi")
    own = on_sheets(cells, corners.transform(keep), rows).select(*KEY, *band(cells), "r", "c", valued().cast("long").alias("v"), *[f.alias(n) for n, f in flags.items()])

    def ends(of: DataFrame, along: str, by: list[str], names: str) -> DataFrame:
        # from the last place to the first: a run ends where the place after it has no such border, and its cells before see that end last
        w = Window.partitionBy(*KEY, *by).orderBy(F.desc(along))
        beside = F.lag(along).over(w) == F.col(along) + 1
        of = of.withColumns({f"{n}_last": F.when(F.col(n) & ~F.coalesce(beside & F.lag(n).over(w), F.lit(False)), F.col(along)) for n in names})
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        return of.withColumns({f"{n}_end": F.when(F.col(n), F.last(f"{n}_last", ignorenulls=True).over(so_far)) for n in names}).drop(*[f"{n}_last" for n in names])

    def sums(of: DataFrame, along: str, by: list[str], values: dict) -> DataFrame:
        """Running sums from the first place on, in the order that ends has left."""
        w = Window.partitionBy(*KEY, *by)
        back = w.orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
        of = of.withColumns({f"{n}_own": x for n, x in values.items()})
        of = of.withColumns({f"{n}_back": F.sum(f"{n}_own").over(back) for n in values})
        of = of.withColumns({n: F.sum(f"{n}_own").over(w) - F.col(f"{n}_back") + F.col(f"{n}_own") for n in values})
        return of.drop(*[f"{n}_{x}" for n in values for x in ("own", "back")])

    e = sums(ends(own, "c", [*band(cells), "r"], "tb"), "c", [*band(cells), "r"], {"along": F.col("v")}).where("t or b or l or g")
    down = {"left_sum": F.when(F.col("l"), F.col("along") - F.col("v")).otherwise(0), "right_sum": F.when(F.col("g"), F.col("along")).otherwise(0)}
    return sums(ends(e, "r", ["c"], "lg"), "r", ["c"], down)


def verified(cells: DataFrame, min_rows: int = 2, min_cols: int = 2, min_density: float = 0.3, among: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Boxes from cells with top and left borders, as far right as top borders run and as far down as left ones, whose other edges are whole too and which hold values enough."""
    e = edges(cells, among, rows).transform(keep)
    b = e.where("t and l").select(*KEY, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("l_end").alias("r1"), F.col("t_end").alias("c1"), (F.col("left_sum") - F.col("along") + F.col("v")).alias("left_before"))
    b = b.where((F.col("r1") - F.col("r0") + 1 >= min_rows) & (F.col("c1") - F.col("c0") + 1 >= min_cols))
    low_left = e.where("b and l").select(*KEY, F.col("r").alias("r1"), F.col("c").alias("c0"), "b_end", "left_sum")
    up_right = e.where("g").select(*KEY, F.col("r").alias("r0"), F.col("c").alias("c1"), "g_end", (F.col("right_sum") - F.col("along")).alias("right_before"))
    low_right = e.where("g").select(*KEY, F.col("r").alias("r1"), F.col("c").alias("c1"), "right_sum")
    b = b.join(low_left, [*KEY, "r1", "c0"]).where("b_end >= c1").join(up_right, [*KEY, "r0", "c1"]).where("g_end >= r1").join(low_right, [*KEY, "r1", "c1"])
    values = F.col("right_sum") - F.col("right_before") - (F.col("left_sum") - F.col("left_before"))
    area = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    return b.where(values / area >= min_density).select(*KEY, *BOX)


def _disjoint(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values(["r0", "c0"], kind="stable")
    boxes, kept = df[BOX].to_numpy(), []
    taken = np.zeros((0, 4), boxes.dtype)
    for i, (r0, c0, _, _) in enumerate(boxes):
        if not ((taken[:, 0] <= r0) & (taken[:, 2] >= r0) & (taken[:, 1] <= c0) & (taken[:, 3] >= c0)).any():
            kept.append(i)
            taken = np.vstack([taken[taken[:, 2] >= r0], boxes[i]])  # boxes that end above this row hold no later corner
    return df.iloc[kept]


def detect(cells: DataFrame, among: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Boxes of the sheets in row-major order of their corners; corners inside an earlier box are passed over. Sheets with one box are settled without Python."""
    good = verified(cells, among=among, rows=rows).transform(keep)
    several = good.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*KEY)
    chosen = good.join(several, KEY, "left_anti")
    if not several.isEmpty():
        chosen = chosen.unionByName(good.join(several, KEY, "left_semi").groupBy(*KEY).applyInPandas(_disjoint, good.schema))
    return chosen.withColumns({"confidence": F.lit(0.95), "method": F.lit("box_table"), "table_id": F.concat_ws("_", F.lit("box"), "r0", "c0")})
