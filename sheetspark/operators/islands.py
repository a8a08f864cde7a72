"""Islands: several tables on a sheet as connected regions of non-empty cells.

Rows are compressed to runs of columns first; components join runs, not cells. Splitting at format boundaries is a
window over rows. The greedy, order-dependent merging works on island-level rows of one sheet, with runs to look
into gaps. Scores are one join of cells with island bounds and a few aggregations. Frames of runs and islands that
several steps read are written to the shared folder and read back.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import keep
from ..model import GOOD_SIZE, KEY, SMALL_SIZE, Config, filled, valued
from .grid import band, join_regions, on_sheets
from .batches import by_sheets, sheet_numbers
from .boxes import bordered
from .simple import BITS, row_totals

ISLAND = ["ir", "ic"]
#: A sheet with more runs than this is not labelled by one task; either way gives the same islands.
TASK_RUNS = 2_000_000
SIDES = ("bt", "bb", "bl", "br")

# Likeness of border signatures; equal ones are 1, pairs that are not listed 0.3.
BORDER_LIKENESS = {
    ("horizontal", "all"): 0.7,
    ("vertical", "all"): 0.7,
    ("horizontal", "mixed"): 0.6,
    ("vertical", "mixed"): 0.6,
    ("all", "mixed"): 0.8,
    ("outer", "all"): 0.8,
    ("outer", "mixed"): 0.7,
    ("none", "all"): 0.2,
    ("none", "mixed"): 0.2,
    ("none", "outer"): 0.2,
    ("horizontal", "vertical"): 0.5,
    ("horizontal", "outer"): 0.6,
    ("vertical", "outer"): 0.6,
}


def row_runs(cells: DataFrame, gap: int = 1) -> DataFrame:
    """Runs of non-empty cells of a row whose columns are at most gap apart: r, c0, c1, n."""
    w = Window.partitionBy(*KEY, "r").orderBy("c")
    starts = F.coalesce(F.col("c") - F.lag("c").over(w) > max(1, gap), F.lit(True)).cast("int")
    runs = cells.where(filled()).select(*KEY, "r", "c").withColumn("s", starts)
    runs = runs.withColumn("run", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*KEY, "r", "run").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n")).drop("run")


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For 0..n-1 the least number that links x[i] to y[i] reach: roots hook onto smaller ones, then paths are cut short."""
    label = np.arange(n)
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _links(sheet: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray, gap: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of one sheet at most gap rows apart whose columns, widened by reach, meet. Runs are in order and those of a row are apart."""
    starts = np.flatnonzero(np.r_[True, (np.diff(sheet) != 0) | (np.diff(r) != 0)])
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(r)]))
    place = sheet[starts] * (int(r.max()) + gap + 1) + r[starts]
    wide = int(b.max()) + reach + 1
    first, last = row * wide + a, row * wide + b  # in order over all rows, as runs of a row are
    xs, ys = [], []
    for d in range(1, gap + 1):
        at = np.minimum(np.searchsorted(place, place + d), len(place) - 1)
        other = np.where(place[at] == place + d, at, -1)[row]
        x = np.flatnonzero(other >= 0)
        lo = np.searchsorted(last, other[x] * wide + np.maximum(a[x] - reach, 0))
        k = np.searchsorted(first, other[x] * wide + b[x] + reach, "right") - lo
        xs.append(np.repeat(x, k))
        ys.append(np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum()))
    return np.concatenate(xs), np.concatenate(ys)


def _components(gap: int, diagonal: bool):
    """Cells, runs or rows of bits (one for each column in use) of whole sheets, in order, as runs with the first cell of their island."""

    def label(rows: pa.Table) -> pa.Table:
        if "cols" in rows.column_names and rows.column("cols").null_count < rows.num_rows:
            rows = _unpacked(rows)
        sheet = sheet_numbers(rows)
        r, a, b, n = (rows.column(x).to_numpy().astype(np.int64) for x in ("r", "c0", "c1", "n"))
        starts = np.flatnonzero(np.r_[True, (np.diff(sheet) != 0) | (np.diff(r) != 0) | (a[1:] - b[:-1] > gap)])
        ends = np.r_[starts[1:], len(r)] - 1
        sheet, r, a, b, n = sheet[starts], r[starts], a[starts], b[ends], np.add.reduceat(n, starts)
        root = _least(len(r), *_links(sheet, r, a, b, gap, gap if diagonal else 0))
        out = [rows.column(x).take(pa.array(starts)) for x in KEY]
        return pa.table([*out, *[pa.array(x, t) for x, t in ((r, pa.int32()), (a, pa.int32()), (b, pa.int32()), (n, pa.int64()), (r[root], pa.int32()), (a[root], pa.int32()))]], names=[*KEY, "r", "c0", "c1", "n", *ISLAND])

    return label


def _unpacked(rows: pa.Table) -> pa.Table:
    """Rows of bits as cells; a row without bits stays. No row has both."""
    bits = rows.column("cols").fill_null(0).to_numpy().astype("<i8")
    plain = np.asarray(rows.column("cols").is_null())
    on = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on[plain, 0] = 1
    at, col = np.nonzero(on)
    a, b, n = (np.where(plain[at], rows.column(x).fill_null(0).to_numpy()[at], col if x != "n" else 1) for x in ("c0", "c1", "n"))
    few = rows.select([*KEY, "r"]).take(pa.array(at))
    return pa.table([*few.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], names=[*KEY, "r", "c0", "c1", "n"])


def components(cells: DataFrame, gap: int = 1, diagonal: bool = True, size: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Runs with the island (ir, ic) they belong to: its first cell in row-major order. Cells within gap in both directions connect.

    Without diagonals cells connect along rows and columns only; gap 0 connects nothing but makes each cell its own.
    size: totals(cells), if at hand. rows: simple.row_totals(cells), if at hand; rows whose cells are those of their bits go as they are.
    """
    if not diagonal and gap > 1:
        raise ValueError("gaps above 1 need diagonals")
    one = F.lit(1).cast("long").alias("n")
    own = cells.where(filled()).select(*KEY, "r", F.col("c").alias("c0"), F.col("c").alias("c1"), one)
    if gap == 0:
        return own.withColumns({"ir": F.col("r"), "ic": F.col("c0")})
    schema = "file_id string, sheet_idx int, r int, c0 int, c1 int, n long, ir int, ic int"
    label = lambda df: by_sheets(df, ["r", "c0"], _components(gap, diagonal), schema)
    many = (totals(cells) if size is None else size).where(F.col("total") > TASK_RUNS).select(*KEY).transform(keep)
    if many.isEmpty():
        if rows is None:
            return label(own)
        none = F.lit(None)
        whole = F.coalesce((F.col("hi") < BITS) & (F.bit_count("cols") == F.col("nf")), F.lit(False))
        packed = rows.where((F.col("nf") > 0) & whole).select(*KEY, "r", *[none.cast(t).alias(x) for x, t in (("c0", "int"), ("c1", "int"), ("n", "long"))], "cols")
        others = rows.where((F.col("nf") > 0) & ~whole).select(*KEY, *band(rows), "r").transform(keep)
        if others.isEmpty():
            return label(packed)
        at = [*KEY, *band(cells), "r"]
        own = cells.where(filled()).join(others.hint("shuffle_hash"), at, "left_semi").select(*KEY, "r", F.col("c").alias("c0"), F.col("c").alias("c1"), one, none.cast("long").alias("cols"))
        return label(packed.unionByName(own))
    # of sheets with more cells than a task takes, the runs may still be few enough
    runs = row_runs(cells.join(many, KEY, "left_semi"), gap).transform(keep)
    large = runs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > TASK_RUNS).select(*KEY).transform(keep)
    small = label(own.join(many, KEY, "left_anti").unionByName(runs.join(large, KEY, "left_anti")))
    return small if large.isEmpty() else small.unionByName(_linked(runs.join(large, KEY, "left_semi"), gap, gap if diagonal else 0))


def components_distributed(cells: DataFrame, gap: int = 1) -> DataFrame:
    """The same in the form for sheets too large for one task."""
    return _linked(row_runs(cells, gap), gap, gap)


def _linked(runs: DataFrame, gap: int, reach: int) -> DataFrame:
    """Least labels over linked runs, with pointer jumping until no label changes, a checkpoint a round."""
    runs = runs.withColumn("id", F.struct("r", "c0"))
    step = F.explode(F.sequence(F.lit(1), F.lit(gap))).alias("d")
    down = runs.select(*KEY, F.col("id").alias("x"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), (F.col("r")).alias("row"), step).withColumn("r", F.col("row") + F.col("d"))
    links = down.join(runs.select(*KEY, "r", F.col("id").alias("y"), "c0", "c1"), [*KEY, "r"]).where((F.col("c0") <= F.col("a1") + reach) & (F.col("a0") <= F.col("c1") + reach)).select(*KEY, "x", "y")
    links = links.unionByName(links.select(*KEY, F.col("y").alias("x"), F.col("x").alias("y"))).checkpoint()
    labels = runs.select(*KEY, "id", F.col("id").alias("label")).checkpoint()
    while True:
        near = links.join(labels.select(*KEY, F.col("id").alias("y"), F.col("label").alias("m")), [*KEY, "y"]).groupBy(*KEY, F.col("x").alias("id")).agg(F.min("m").alias("m"))
        low = labels.join(near, [*KEY, "id"], "left").select(*KEY, "id", "label", F.least("label", "m").alias("m"))
        jump = labels.select(*KEY, F.col("id").alias("m"), F.col("label").alias("mm"))
        after = low.join(jump, [*KEY, "m"]).select(*KEY, "id", F.least("m", "mm").alias("label"), (F.least("m", "mm") < F.col("label")).alias("moved")).checkpoint()
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return runs.join(labels, [*KEY, "id"]).select(*KEY, "r", "c0", "c1", "n", F.col("label")["r"].alias("ir"), F.col("label")["c0"].alias("ic"))


def extents(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*KEY, *by).agg(F.sum("n").alias("n"), F.min("r").alias("r0"), F.min("c0").alias("c0"), F.max("r").alias("r1"), F.max("c1").alias("c1"))


def totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"), F.max("r").alias("max_row"), F.max("c").alias("max_col"))


def least_size(total: Column, config: Config) -> Column:
    least = F.lit(config.min_island_size)
    if not config.adaptive_thresholds:
        return least
    large, medium = F.greatest(F.lit(20), F.floor(total * 0.001)), F.greatest(F.lit(10), F.floor(total * 0.005))
    return F.greatest(least, F.when(total > 10000, large).when(total > 1000, medium).otherwise(least))


# ---- formats of rows and the boundaries they show


def border_signature_of(flags: Column) -> Column:
    """Signature of a row from its cells in column order: array of struct(t, b, l, g)."""

    def kind(x, i):
        n = sum(x[s].cast("int") for s in ("t", "b", "l", "g"))
        flat = x["t"] | x["b"]
        upright = x["l"] | x["g"]
        outer = ((i == 0) & x["l"] & flat) | ((i == F.size(flags) - 1) & x["g"] & flat)
        return F.when(n == 0, "none").when(n == 4, "all").when(outer, "outer").when(flat & ~upright, "horizontal").when(upright & ~flat, "vertical").otherwise("mixed")

    kinds = F.transform(flags, kind)
    order = ("all", "none", "horizontal", "vertical", "mixed", "outer")
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    # the largest count wins, ties by order
    best = F.array_max(F.array(*[F.struct(count(k).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(order)]))
    return best["k"]


def border_likeness(x: Column, y: Column) -> Column:
    out = F.when(x == y, 1.0)
    for (a, b), s in BORDER_LIKENESS.items():
        out = out.when(((x == a) & (y == b)) | ((x == b) & (y == a)), s)
    return out.otherwise(0.3)


def row_formats(cells: DataFrame) -> DataFrame:
    """Per row of a sheet, over its non-empty cells in all columns: count, bold share, colours, header likeness, consistency, borders."""
    own = F.struct("c", *[bordered(s).alias(n) for s, n in zip(SIDES, "tblg")])
    rows = cells.where(filled()).groupBy(*KEY, "r").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_bold").alias("n_bold"),
        F.collect_set("bg_color").alias("backgrounds"),
        F.collect_set("font_color").alias("colors"),
        F.sort_array(F.collect_list(own)).alias("cells"),
    )
    bold = F.col("n_bold") / F.col("n")
    even = F.when((F.col("n_bold") == 0) | (F.col("n_bold") == F.col("n")), 1.0).otherwise(F.greatest("n_bold", F.col("n") - F.col("n_bold")) / F.col("n"))
    one = lambda c: F.when(F.size(c) <= 1, 1.0).otherwise(0.5)
    header = (bold >= 0.7) | ((F.size("backgrounds") == 1) & (F.col("n") > 1))
    return rows.withColumns({"bold_ratio": bold, "is_header": header, "consistency": (even + one("backgrounds") + one("colors")) / 3, "borders": border_signature_of(F.col("cells"))})


def format_boundaries(formats: DataFrame) -> DataFrame:
    """Rows that start a new table by their format, against the non-empty row before: key, r, prev_r and the three reasons."""
    w = Window.partitionBy(*KEY).orderBy("r")
    p = formats.withColumns({f"p_{x}": F.lag(x).over(w) for x in ("r", "is_header", "borders", "cells", "n")})
    header = ~F.col("p_is_header") & F.col("is_header")
    borders = border_likeness(F.col("borders"), F.col("p_borders")) < 0.8
    closed = F.size(F.filter("p_cells", lambda x: x["b"])) >= F.col("p_n") * 0.7
    lo, hi = F.get("p_cells", F.lit(0))["c"], F.element_at("p_cells", -1)["c"]
    below = F.filter("cells", lambda x: x["c"].between(lo, hi))
    end = closed & ((F.size(below) == 0) | (F.size(F.filter(below, lambda x: x["t"])) < F.size(below) * 0.3))
    out = p.where("p_r is not null").select(*KEY, "r", F.col("p_r").alias("prev_r"), header.alias("header_starts"), borders.alias("borders_change"), end.alias("table_ends"))
    return out.withColumn("is_boundary", F.col("header_starts") | F.col("borders_change") | F.col("table_ends"))


def boundary_rows(cells: DataFrame, rows: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """rows: simple.row_totals of the sheets among, if at hand. Rows (key, r) that start a new table by their format. Sheets without a border and without a background are judged by counts of bold cells alone, which needs no lists of cells."""
    border = bordered(SIDES[0]) | bordered(SIDES[1]) | bordered(SIDES[2]) | bordered(SIDES[3])
    dressed = cells.where(border | F.col("bg_color").isNotNull()).select(*KEY).distinct()
    dressed = (dressed if among is None else dressed.join(among.select(*KEY), KEY, "left_semi")).transform(keep)
    rows = row_totals(cells) if rows is None else rows
    plain = rows.where("nf > 0").select(*KEY, *band(rows), "r", (F.col("bold") / F.col("nf") >= 0.7).alias("is_header"))
    # a header below another row: no other sheet can have a start
    lower = plain.groupBy(*KEY).agg(F.min("r").alias("top"), F.max(F.when(F.col("is_header"), F.col("r"))).alias("low")).where("low > top").select(*KEY).transform(keep)
    plain = on_sheets(plain, lower)
    none = dressed.isEmpty()
    plain = plain if none else plain.join(dressed, KEY, "left_anti")
    before = F.lag("is_header").over(Window.partitionBy(*KEY).orderBy("r"))
    found = plain.withColumn("starts", ~before & F.col("is_header")).where("starts").select(*KEY, "r")
    if none:
        return found
    return found.unionByName(format_boundaries(row_formats(on_sheets(cells, dressed, rows))).where("is_boundary").select(*KEY, "r"))


def split_at_boundaries(runs: DataFrame, marks: DataFrame, min_size: int = SMALL_SIZE) -> DataFrame:
    """runs with `part`: islands of more than 4 rows are cut before the marks (boundary_rows); parts below min_size go, unless none is left."""
    marks = marks.select(*KEY, "r", F.lit(1).alias("cut"))
    w = Window.partitionBy(*KEY, *ISLAND)
    own = runs.join(marks, [*KEY, "r"], "left").withColumns({"top": F.min("r").over(w), "tall": F.max("r").over(w) - F.min("r").over(w) > 3})
    here = F.when(F.col("tall") & (F.col("r") > F.col("top")), F.coalesce("cut", F.lit(0))).otherwise(0)
    own = own.withColumn("part", F.sum(here).over(w.orderBy("r").rangeBetween(Window.unboundedPreceding, 0)).cast("int"))
    own = own.withColumn("size", F.sum("n").over(Window.partitionBy(*KEY, *ISLAND, "part")))
    own = own.withColumn("largest", F.max("size").over(w)).withColumn("part", F.when(F.col("largest") < min_size, 0).otherwise(F.col("part")))
    return own.where((F.col("size") >= min_size) | (F.col("largest") < min_size)).select(*KEY, *ISLAND, "part", "r", "c0", "c1", "n")


# ---- greedy merging within a sheet


def mergeable(a, b, distance: int, overlap: float = 0.5, column_gap_prevents: bool = False) -> bool:
    """Whether two bounds (r0, c0, r1, c1) are near enough to be one table."""
    v = max(0, b[0] - a[2] - 1, a[0] - b[2] - 1)
    h = max(0, b[1] - a[3] - 1, a[1] - b[3] - 1)
    if h >= 2 or h and column_gap_prevents:
        return False
    if h:
        both = min(a[2], b[2]) - max(a[0], b[0]) + 1
        if both > 0 and both / min(a[2] - a[0] + 1, b[2] - b[0] + 1) < overlap:
            return False
    return v <= distance and h <= distance


def mergeable_column(distance: Column, a: str = "a_", b: str = "b_") -> Column:
    """The same as a column over a_r0, a_c0, ... and b_r0, ..."""
    x, y = (lambda n: F.col(a + n)), (lambda n: F.col(b + n))
    v = F.greatest(F.lit(0), y("r0") - x("r1") - 1, x("r0") - y("r1") - 1)
    h = F.greatest(F.lit(0), y("c0") - x("c1") - 1, x("c0") - y("c1") - 1)
    both = F.least(x("r1"), y("r1")) - F.greatest(x("r0"), y("r0")) + 1
    low = (h == 1) & (both > 0) & (both / F.least(x("r1") - x("r0") + 1, y("r1") - y("r0") + 1) < 0.5)
    return (h < 2) & ~low & (v <= distance) & (h <= distance)


def _gap(a, b):
    """The rectangle between two bounds: a vertical gap counts before a horizontal one; None if there is none."""
    out = None
    if a[3] < b[1] or b[3] < a[1]:
        left, right = (a, b) if a[3] < b[1] else (b, a)
        out = (max(a[0], b[0]), left[3] + 1, min(a[2], b[2]), right[1] - 1)
    if a[2] < b[0] or b[2] < a[0]:
        up, low = (a, b) if a[2] < b[0] else (b, a)
        out = (up[2] + 1, max(a[1], b[1]), low[0] - 1, min(a[3], b[3]))
    return out if out and out[1] <= out[3] and out[0] <= out[2] else None


def _union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def _absorb(items: list, test) -> list:
    """One greedy pass in list order: each item takes later ones that test(original, grown, other) accepts. Items: (bounds, members)."""
    out, used = [], set()
    for i, (own, members) in enumerate(items):
        if i in used:
            continue
        grown, got = own, list(members)
        for j in range(i + 1, len(items)):
            if j not in used and test(own, grown, items[j][0]):
                grown = _union(grown, items[j][0])
                got += items[j][1]
                used.add(j)
        out.append((grown, got))
    return out


def _merged(parts: list[tuple], runs: list[np.ndarray], own: tuple[int, int], tolerance: int, overlap: float, column_gap_prevents: bool) -> list[int]:
    """The table that each part of a sheet falls in. parts: (whole, ir, ic, part, r0, c0, r1, c1, density); runs: rows, first and last columns, own: where the sheet's are, in order of rows."""
    row, lo, hi = (memoryview(x) for x in runs)

    def cells_in(box) -> int:
        i, j = bisect_left(row, box[0], *own), bisect_right(row, box[2], *own)
        if j - i < 64:
            return sum(max(0, min(hi[x], box[3]) - max(lo[x], box[1]) + 1) for x in range(i, j))
        return int(np.clip(np.minimum(runs[2][i:j], box[3]) - np.maximum(runs[1][i:j], box[1]) + 1, 0, None).sum())

    order = sorted(range(len(parts)), key=lambda i: (-parts[i][0], *parts[i][1:4]))
    items = [(parts[i][4:8], [i]) for i in order]
    split = len(items) > len({p[1:3] for p in parts})
    if tolerance > 0 and len(items) > 1:
        items.sort(key=lambda x: (x[0][0], x[0][1]))

        def reconnects(_, a, b):
            width = min(a[3], b[3]) - max(a[1], b[1]) + 1
            if not 1 <= b[0] - a[2] - 1 <= tolerance or width <= 0 or width / min(a[3] - a[1] + 1, b[3] - b[1] + 1) < 0.5:
                return False
            return cells_in((a[2] + 1, max(a[1], b[1]), b[0] - 1, min(a[3], b[3]))) <= width * 0.2

        items = _absorb(items, reconnects)
    if len(items) > 1:
        bounds = sorted((x[0] for x in items), key=lambda x: (x[0], x[1]))
        apart = all(b[0] > a[2] + 1 and not cells_in((a[2] + 1, min(a[1], b[1]), b[0] - 1, max(a[3], b[3]))) for a, b in zip(bounds, bounds[1:]))
        density = parts[0][8]
        distance = 0 if apart else 1 if split else 5 if density < 0.3 else 3 if density < 0.6 else 2
        if distance:
            items = _absorb(items, lambda own, grown, b: mergeable(own, b, distance, overlap, column_gap_prevents) and not ((g := _gap(grown, b)) and cells_in(g)))
    seq = [0] * len(parts)
    for k, (_, members) in enumerate(items):
        for i in members:
            seq[i] = k
    return seq


PART = ["whole", *ISLAND, "part", "r0", "c0", "r1", "c1", "density"]


def _merge_sheets(tolerance: int, overlap: float = 0.5, column_gap_prevents: bool = False):
    def merge(rows: pa.Table) -> pa.Table:
        sheet = sheet_numbers(rows)
        is_run = rows.column("is_run").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, np.diff(sheet) != 0])
        ends = np.r_[starts[1:], len(sheet)]
        heads = ends - np.add.reduceat(is_run.astype(np.int64), starts)  # parts come before runs
        runs = [rows.column(x).to_numpy(zero_copy_only=False) for x in ("r0", "c0", "c1")]
        at = np.flatnonzero(~is_run)
        few = rows.select([*KEY, *PART]).take(pa.array(at))
        parts = list(zip(*(few.column(x).to_pylist() for x in PART)))
        seq, done = [], 0
        for i, j, k in zip(starts.tolist(), heads.tolist(), ends.tolist()):
            own = parts[done : done + j - i]
            done += j - i
            seq += _merged(own, runs, (j, k), tolerance, overlap, column_gap_prevents) if own else []
        return few.select([*KEY, *ISLAND, "part"]).append_column("seq", pa.array(seq, pa.int32()))

    return merge


def merge_parts(parts: DataFrame, runs: DataFrame, config: Config) -> DataFrame:
    """parts with `seq`, the table of their sheet that they fall in. Only sheets with several parts go to Python, with their runs."""
    several = parts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*KEY)
    own = parts.withColumn("density", F.col("total") / ((F.col("max_row") + F.lit(1).cast("long")) * (F.col("max_col") + 1))).select(*KEY, F.lit(False).alias("is_run"), *PART)
    kinds = dict(own.dtypes)
    places = {"r0": F.col("r"), "c0": F.col("c0"), "r1": F.col("r"), "c1": F.col("c1")}
    every = runs.select(*KEY, F.lit(True).alias("is_run"), *[places.get(x, F.lit(None)).cast(kinds[x]).alias(x) for x in PART])
    rows = own.unionByName(every).join(several, KEY, "left_semi")
    merged = by_sheets(rows, ["is_run", "r0", "c0"], _merge_sheets(config.empty_row_tolerance, config.min_column_overlap_for_merge, config.column_gap_prevents_merge), "file_id string, sheet_idx int, ir int, ic int, part int, seq int")
    return parts.join(merged, [*KEY, *ISLAND, "part"], "left").withColumn("seq", F.coalesce("seq", F.lit(0)))


def detect(cells: DataFrame, config: Config = Config(), size: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Islands of each sheet: seq, n, bounds and all scores. size, rows: totals and simple.row_totals of the sheets to look at, where cells may have more."""
    own = cells if rows is None else on_sheets(cells, size, rows)
    size = totals(cells).transform(keep) if size is None else size
    runs = components(own, config.max_gap, size=size, rows=rows).transform(keep)
    islands = extents(runs, ISLAND).join(size, KEY).where(F.col("n") >= least_size(F.col("total"), config))
    islands = islands.withColumns({"whole": F.col("n"), "part": F.lit(0)}).transform(keep)
    parts = islands
    if config.use_border_detection:
        marks = boundary_rows(cells, rows, size).transform(keep)
        cut = islands.join(marks, KEY).where((F.col("r1") - F.col("r0") > 3) & (F.col("r") > F.col("r0")) & (F.col("r") <= F.col("r1"))).select(*KEY, *ISLAND).distinct().transform(keep)
        if not cut.isEmpty():
            by = [*KEY, *ISLAND]
            pieces = extents(split_at_boundaries(runs.join(cut, by, "left_semi"), marks, config.min_island_size), [*ISLAND, "part"])
            facts = islands.select(*by, "whole", "total", "max_row", "max_col")
            parts = islands.join(cut, by, "left_anti").unionByName(pieces.join(facts, by)).transform(keep)
    every = runs if config.max_gap <= 1 else row_runs(own, 1)  # up to gap 1 a run has no hole
    whole = merge_parts(parts, every, config).groupBy(*KEY, "seq").agg(F.sum("n").alias("n"), F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"), F.max("c1").alias("c1"))
    return score(cells, whole, ["seq"], size)


# ---- scores


def measure(cells: DataFrame, islands: DataFrame, ids: list[str], size: DataFrame | None = None) -> DataFrame:
    """ids, n, bounds -> every component of the score, from one join of cells with bounds widened by the ring of 2.

    Cells are counted by all that the score looks at, once; each component is a sum of those counts.
    """
    size = totals(cells) if size is None else size
    near = band(cells)
    own = [*KEY, *ids, "n", "r0", "c0", "r1", "c1"]
    sig = F.concat_ws("", *[F.coalesce(F.col(s), F.lit("")).rlike(".").cast("int").cast("string") for s in SIDES])
    looked = {"v": valued(), "f": filled(), "vtype": F.col("vtype"), "is_bold": F.col("is_bold"), "halign": F.col("halign"), "sig": sig, **{x: F.col(x) for x in ("font_size", "font_color", "bg_color")}}
    r, c = F.col("r"), F.col("c")
    at = join_regions(cells.select(*KEY, *near, "r", "c", *[x.alias(n) for n, x in looked.items()]), islands.select(*own), 2)
    box = r.between(F.col("r0"), F.col("r1")) & c.between(F.col("c0"), F.col("c1"))
    line = F.when(~box, -1).when(r == F.col("r0"), 0).when(r == F.col("r0") + 1, 1).otherwise(2)
    inside = [F.when(box, F.col(x)).alias(x) for x in ("c", *looked) if x != "f"]
    counted = at.select(*own, *near, line.alias("line"), "f", *inside)
    counted = counted.groupBy(counted.columns).agg(F.count(F.lit(1)).alias("k")).transform(keep)
    tally = lambda on: F.coalesce(F.sum(F.when(on, F.col("k"))), F.lit(0))
    first = F.col("line") == 0
    head = counted.groupBy(*own).agg(
        tally(first & F.col("v") & (F.col("vtype") == "string")).alias("texts"),
        tally(first & F.col("is_bold")).alias("bolds"),
        tally((F.col("line") == 1) & F.col("vtype").isin("number", "datetime")).alias("numbers"),
        tally((F.col("line") < 0) & F.col("f")).alias("ring"),
    )
    width, height = (F.col("c1") - F.col("c0") + 1).cast("long"), F.col("r1") - F.col("r0") + 1
    head = head.join(size, KEY)
    head = head.withColumn("has_headers", (F.col("texts") == width) & ((F.col("bolds") > 0) | (F.col("numbers") > 0)))
    wide = (F.least("max_col", F.col("c1") + 2) - F.greatest(F.lit(0), F.col("c0") - 2) + 1).cast("long")
    tall = F.least("max_row", F.col("r1") + 2) - F.greatest(F.lit(0), F.col("r0") - 2) + 1
    area = wide * tall - width * height
    head = head.withColumns({"density": F.col("n") / (width * height), "ring_ratio": F.when(area > 0, F.col("ring") / area).otherwise(0.0)})
    head = head.drop("texts", "bolds", "numbers", "ring").transform(keep)

    inner = counted.where("line >= 0").join(head.select(*KEY, *ids, "has_headers"), [*KEY, *ids])
    inner = inner.withColumn("body", (F.col("line") > 0) | ~F.col("has_headers"))
    border = inner.groupBy(*KEY, *ids, "sig").agg(F.sum("k").alias("k"))
    border = border.groupBy(*KEY, *ids).agg((F.max("k") / F.sum("k")).alias("share"), F.max((F.col("sig") != "0000").cast("int")).alias("any"))
    border = border.select(*KEY, *ids, F.when(F.col("any") == 1, F.least(F.lit(1.0), F.col("share") + 0.1)).otherwise(F.col("share")).alias("border_score"))
    kinds = inner.where(F.col("body") & F.col("v")).groupBy(*KEY, *ids, "c", "vtype").agg(F.sum("k").alias("k"))
    kinds = kinds.groupBy(*KEY, *ids, "c").agg((F.max("k") / F.sum("k")).alias("share")).groupBy(*KEY, *ids).agg(F.avg("share").alias("type_score"))
    halign = F.col("halign")
    right = ((F.col("vtype") == "number") & (halign == "right")) | (F.col("vtype").isin("string", "datetime") & halign.isin("left", "center"))
    some = lambda c: F.when(F.col("body") & (F.col(c).cast("string") != ""), F.col(c)).alias(c)
    looks = inner.groupBy(*KEY, *ids, *[some(x) for x in ("font_size", "font_color", "bg_color")]).agg(
        tally(F.coalesce(halign, F.lit("")) != "").alias("aligned"), tally(right).alias("right"), tally(F.col("body")).alias("k"), tally(F.col("body") & F.col("is_bold")).alias("kb")
    )
    looks = looks.groupBy(*KEY, *ids).agg(
        *[F.sum(x).alias(x) for x in ("aligned", "right", "k", "kb")], F.count_distinct("font_size").alias("sizes"), F.count_distinct("font_color").alias("colors"), F.count_distinct("bg_color").alias("grounds")
    )
    share = F.col("kb") / F.col("k")
    parts = [
        F.when(F.col("sizes") <= 1, 1.0).when(F.col("sizes") == 2, 0.8).otherwise(0.5),
        F.when(F.col("colors") <= 1, 1.0).when(F.col("colors") == 2, 0.7).otherwise(0.4),
        F.when(F.col("grounds") == 0, 0.9).when(F.col("grounds") == 1, 1.0).otherwise(0.5),
        F.when((share == 0) | (share == 1), 1.0).when((share < 0.1) | (share > 0.9), 0.8).otherwise(0.5),
    ]
    looks = looks.select(*KEY, *ids, F.when(F.col("aligned") == 0, 0.7).otherwise(F.col("right") / F.col("aligned")).alias("align_score"), F.when(F.col("k") == 0, 0.5).otherwise((parts[0] + parts[1] + parts[2] + parts[3]) / 4).alias("uniform_score"))
    return head.join(border, [*KEY, *ids], "left").join(kinds, [*KEY, *ids], "left").join(looks, [*KEY, *ids], "left").fillna({"border_score": 0.5, "type_score": 0.5, "align_score": 0.7, "uniform_score": 0.5})


def confidence() -> Column:
    """Weighted mean of seven scores over the columns of measure(), summed in this order."""
    n, d = F.col("n"), F.col("density")
    share = n / F.col("total")
    size = F.when(share >= 0.05, 1.0).when(share >= 0.01, 0.8).when(share >= 0.005, 0.6).when(share < 0.001, 0.2).otherwise(0.5)
    size = F.when(n >= GOOD_SIZE, F.least(F.lit(1.0), size + 0.1)).when(n < SMALL_SIZE, F.greatest(F.lit(0.0), size - 0.2)).otherwise(size)
    dense = F.when(d > 0.8, 1.0).when(d > 0.6, 0.7).when(d < 0.3, 0.3).otherwise(0.5)
    aspect = (F.col("c1") - F.col("c0") + 1) / (F.col("r1") - F.col("r0") + 1)
    shape = F.when(aspect.between(0.1, 10), 0.9).when((aspect < 0.05) | (aspect > 20), 0.2).otherwise(0.5)
    head = F.when(F.col("has_headers"), 0.8).otherwise(0.4)
    ring = F.when(F.col("ring_ratio") > 0.5, 0.2).when(F.col("ring_ratio") > 0.3, 0.5).otherwise(1.0)
    form = (F.col("border_score") + F.col("type_score") + F.col("align_score") + F.col("uniform_score")) / 4
    weighed = size * 0.20 + dense * 0.15 + shape * 0.10 + head * 0.15 + ring * 0.15 + form * 0.15 + F.lit(1.0) * 0.10
    total = F.lit(0.20) + 0.15 + 0.10 + 0.15 + 0.15 + 0.15 + 0.10
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighed / total))


def score(cells: DataFrame, islands: DataFrame, ids: list[str], size: DataFrame | None = None) -> DataFrame:
    return measure(cells, islands.transform(keep), ids, size).withColumn("confidence", confidence())


# ---- structural rows


def row_patterns(cells: DataFrame) -> DataFrame:
    return cells.where(filled()).groupBy(*KEY, "r").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sort_array(F.collect_set("c")).alias("cols"))


def pattern_likeness(a: str = "p_", b: str = "") -> Column:
    x, y = (lambda n: F.col(a + n)), (lambda n: F.col(b + n))
    over = F.least(x("hi"), y("hi")) - F.greatest(x("lo"), y("lo")) + 1
    span = F.greatest(x("hi"), y("hi")) - F.least(x("lo"), y("lo")) + 1
    return 0.5 * (over / span) + 0.5 * (F.size(F.array_intersect(x("cols"), y("cols"))) / F.size(F.array_union(x("cols"), y("cols"))))


def row_groups(cells: DataFrame, tolerance: int = 1, consistency: float = 0.8, split_rows: int = 1) -> DataFrame:
    """Rows with the group they fall in: a row joins the row before where their columns are alike and the gap is small."""
    w = Window.partitionBy(*KEY).orderBy("r")
    p = row_patterns(cells).withColumns({f"p_{x}": F.lag(x).over(w) for x in ("r", "lo", "hi", "cols")})
    gap = F.col("r") - F.col("p_r") - 1
    unlike = pattern_likeness() < consistency
    new = F.col("p_r").isNull() | unlike | ((gap > tolerance) & (gap > split_rows))
    return p.withColumn("grp", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select(*KEY, "r", "lo", "hi", F.size("cols").alias("n"), "grp")


def detect_structural(cells: DataFrame, config: Config = Config()) -> DataFrame:
    """Islands of rows with alike columns; groups with too few rows or cells go."""
    size = totals(cells)
    groups = row_groups(cells, config.empty_row_tolerance).groupBy(*KEY, "grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("r").alias("r0"), F.min("lo").alias("c0"), F.max("r").alias("r1"), F.max("hi").alias("c1"))
    least = F.lit(config.min_island_size)
    if config.adaptive_thresholds:
        least = F.when(F.col("total") > 1000, F.greatest(least, F.floor(F.col("total") * 0.005))).otherwise(least)
    kept = groups.join(size, KEY).where((F.col("rows") >= least) & (F.col("n") >= least)).drop("rows", "total", "max_row", "max_col")
    return score(cells, kept.withColumnRenamed("grp", "seq"), ["seq"])
