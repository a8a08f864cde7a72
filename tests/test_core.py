"""Detection on hand-made grids with expected results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sheetspark.functions import addr
from sheetspark.functions.typing import cell_kind, infer_text, looks_like_date
from sheetspark.model import KEY, Config, complete
from sheetspark.operators import boxes, extract, grid, islands, merged, semantic, simple, structured
from sheetspark.plans.cascade import detect_tables


def grid_of(spark, sheets):
    """cells from {name: {(r, c): value or (value, formats)}}."""
    rows = []
    for name, cells in sheets.items():
        for (r, c), v in cells.items():
            v, look = v if isinstance(v, tuple) else (v, {})
            kind = "empty" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
            rows.append((name, r, c, None if v is None else str(v), float(v) if kind == "number" else None, look.get("vtype", kind), look.get("bold", False), look.get("bg"), *(look.get("border", [None] * 4)), look.get("merge"), look.get("halign")))
    df = spark.createDataFrame(rows, "file_id string, r int, c int, val_str string, val_num double, vtype string, is_bold boolean, bg_color string, bt string, bb string, bl string, br string, merge_range string, halign string")
    return complete(df.withColumn("sheet_name", F.col("file_id")))


def block(values, r0=0, c0=0, bold=False):
    return {(r0 + i, c0 + j): ((v, {"bold": True}) if bold and i == 0 else v) for i, row in enumerate(values) for j, v in enumerate(row) if v is not None}


PEOPLE = block([["Name", "Age", "City"], ["Alice", 25, "New York"], ["Bob", 30, "London"]], bold=True)


def ranges(df):
    return sorted(r[0] for r in df.select(addr.format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))).collect())


def test_addresses(spark):
    df = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (16383,)], "c int")
    got = [r[0] for r in df.orderBy("c").select(addr.column_letter(F.col("c"))).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert [r[0] for r in df.orderBy("c").select(addr.column_index(addr.column_letter(F.col("c")))).collect()] == [0, 25, 26, 701, 702, 16383]
    far = spark.createDataFrame([(18277,), (18278,), (475253,), (475254,), (2147483647,)], "c int").select("c", addr.column_letter(F.col("c")).alias("a"), addr.column_index(addr.column_letter(F.col("c"))).alias("i")).orderBy("c").collect()
    assert [r.a for r in far[:4]] == ["ZZZ", "AAAA", "ZZZZ", "AAAAA"] and all(r.i == r.c for r in far)
    refs = spark.createDataFrame([("Sheet!$A$1:B2",), ("A1",), ("1A:B2",), (None,)], "x string").select(addr.parse_range(F.col("x")).alias("p")).collect()
    assert [tuple(r.p) if r.p else None for r in refs] == [(0, 0, 1, 1), None, None, None]


def test_types(spark):
    words = {"hello": "string", "123": "number", "1,234.5": "number", "1": "boolean", "yes": "boolean", "": "empty", "2023-12-25": "date", "12/25/2023": "date", "25 Dec 2023": "date", "1d": "string", "1e5": "number", "nan": "number", "-7": "number"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.t for r in df.select("w", infer_text(F.col("w"))["vtype"].alias("t")).collect()} == words
    assert df.select(F.count_if(looks_like_date(F.col("w")))).first()[0] == 3
    kinds = {r.w: r.k for r in df.select("w", cell_kind(F.col("w"), F.lit("string")).alias("k")).collect()}
    assert kinds["12/25/2023"] == "date" and kinds["yes"] == "boolean" and kinds["1,234.5"] == "numeric"


def test_simple(spark):
    cells = grid_of(spark, {"people": PEOPLE, "gap": block([["a", "b"], ["c", "d"]]) | block([["e", "f"]], 5), "far": block([["a", "b"]], 5, 5)})
    got = {r.file_id: r for r in simple.detect(cells).collect()}
    assert got["people"].range == "A1:C3" and got["people"].has_headers and got["people"].confidence == 0.9999999999999999
    assert got["gap"].reason == "empty rows" and got["far"].reason == "starts too far from the corner"
    h = simple.headers(cells, simple.detect(cells).where("is_simple"), []).first()
    assert h.headers == ["Name", "Age", "City"]


def test_grid(spark):
    cells = grid_of(spark, {"people": PEOPLE})
    s = grid.sheet_stats(cells).first()
    assert (s.n_cells, s.max_row, s.max_col, s.density) == (9, 2, 2, 1.0)
    assert grid.rows_of(cells).where("r = 1").first().vals == ["Alice", "25", "New York"]
    assert grid.columns_of(cells).where("c = 1").first().vals == ["Age", "25", "30"]
    change = spark.createDataFrame([("people", 0, 1, 1, "26", 5)], "file_id string, sheet_idx int, r int, c int, val_str string, seq int")
    assert grid.upsert(cells, change).where("r = 1 and c = 1").first().val_str == "26"
    sparse = grid_of(spark, {"x": {(r, c): "t" for r in range(20) for c in range(10) if (r + c) % 5 == 0}})
    assert grid.sheet_stats(sparse).first().density == 40 / 200
    assert grid.empty_rows(grid_of(spark, {"g": block([["a"]]) | block([["b"]], 4)})).first()[2:] == (1, 3)
    with pytest.raises(ValueError):
        grid.region(cells, -1, 2, 0, 1)


def test_boxes(spark):
    t = "thin"
    cells = {}
    for r in range(1, 5):
        for c in range(1, 4):
            v = f"h{c}" if r == 1 else r * c
            cells[r, c] = (v, {"border": [t] * 4})
    assert ranges(boxes.detect(grid_of(spark, {"b": cells}))) == ["B2:D5"]


def test_gridded_sheets_are_linear(spark):
    t = "thin"
    full = {(r, c): (1 if r < 30 else None, {"border": [t] * 4}) for r in range(40) for c in range(30)}  # every cell is a corner
    hollow = {(r, c): (None, {"border": [t] * 4}) for r in range(20) for c in range(20)}
    over = {(r, c): (r, {"border": [t if r in (0, 6) else None, t if r in (5, 9) else None, t if c in (0, 4) else None, t if c in (3, 7) else None]}) for r in range(10) for c in range(8)}
    gap = {(r, c): (r, {"border": [t if r == 0 else None, t if r == 5 and c != 2 else None, t if c == 0 else None, t if c == 4 else None]}) for r in range(6) for c in range(5)}
    cells = grid_of(spark, {"full": full, "hollow": hollow, "over": over, "gap": gap})
    found = boxes.detect(cells)
    by = {n: ranges(found.where(F.col("file_id") == n)) for n in ("full", "hollow", "over", "gap")}
    assert by == {"full": ["A1:AD40"], "hollow": [], "over": ["A1:H10"], "gap": []}


def test_boxes_are_brute_force(spark):
    import random

    rng = random.Random(4)
    sheets = {}
    for n in range(12):
        cells = {(r, c): [rng.choice([None, 1, 1]), [None] * 4] for r in range(12) for c in range(12)}
        for _ in range(6):  # boxes drawn over one another
            r0, c0 = rng.randrange(9), rng.randrange(9)
            r1, c1 = rng.randrange(r0 + 1, 12), rng.randrange(c0 + 1, 12)
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    own = cells[r, c][1]
                    for k, on in enumerate((r == r0, r == r1, c == c0, c == c1)):
                        own[k] = "thin" if on else own[k]
        sheets[f"s{n}"] = {at: (v, {"border": b}) for at, (v, b) in cells.items() if v is not None or any(b)}
    want = {}
    for name, cells in sheets.items():
        has = lambda r, c, k: (r, c) in cells and cells[r, c][1]["border"][k] is not None  # noqa: B023,E731
        taken, found = [], []
        for r in range(12):
            for c in range(12):
                if not (has(r, c, 0) and has(r, c, 2)) or any(a <= r <= d and b <= c <= e for a, b, d, e in taken):
                    continue
                c1, r1 = c, r
                while has(r, c1 + 1, 0):
                    c1 += 1
                while has(r1 + 1, c, 2):
                    r1 += 1
                inside = [(i, j) for i in range(r, r1 + 1) for j in range(c, c1 + 1)]
                whole = all(has(r1, j, 1) for j in range(c, c1 + 1)) and all(has(i, c1, 3) for i in range(r, r1 + 1))
                if r1 > r and c1 > c and whole and sum(p in cells and cells[p][0] is not None for p in inside) >= 0.3 * len(inside):
                    taken.append((r, c, r1, c1))
        want[name] = sorted(taken)
    got = {n: [] for n in sheets}
    for x in boxes.detect(grid_of(spark, sheets)).collect():
        got[x.file_id].append((x.r0, x.c0, x.r1, x.c1))
    assert {n: sorted(v) for n, v in got.items()} == want and sum(map(len, want.values())) > 5


def test_large_sheets_are_labelled_alike(spark, monkeypatch):
    cells = grid_of(spark, {"a": {(r, c): 1 for r in range(30) for c in range(20) if (r * 7 + c * 3) % 5 < 2}, "b": block([["x"] * 3] * 3)})
    rows = lambda: sorted(map(tuple, islands.components(cells).select("file_id", "r", "c0", "ir", "ic").collect()))
    small = rows()
    monkeypatch.setattr(islands, "TASK_RUNS", 20)
    assert rows() == small


def test_islands(spark):
    three = block([["a", "b", "c"]] * 3) | block([["a", "b", "c"]] * 3, 4, 4) | block([["a", "b"]] * 3, 9)
    near = block([["a", "b"]] * 3) | block([["d", "e"]] * 3, 0, 3)
    ell = block([["x"] * 5] * 2) | block([["x"] * 2] * 4, 2)
    far = block([["x"] * 5] * 10) | block([["x"] * 3] * 5, 100, 50)
    dots = {(0, 0): "a", (5, 5): "b", (10, 10): "c"}
    cells = grid_of(spark, {"three": three, "near": near, "ell": ell, "far": far, "dots": dots})
    found = islands.detect(cells)
    by = {n: ranges(found.where(F.col("file_id") == n)) for n in ("three", "near", "ell", "far", "dots")}
    assert by == {"three": ["A10:B12", "A1:C3", "E5:G7"], "near": ["A1:E3"], "ell": ["A1:E6"], "far": ["A1:E10", "AY101:BA105"], "dots": []}
    plain = islands.detect(grid_of(spark, {"p": block([["a", "b", "c"]] * 3)})).first()
    assert abs(plain.confidence - 0.8878125) < 1e-9
    one, two = (sorted(map(tuple, f(cells).select("file_id", "r", "c0", "ir", "ic").collect())) for f in (islands.components, islands.components_distributed))
    assert one == two


def test_structural_and_plates(spark):
    plate = {(0, 0): "Plate", (0, 1): "x", (1, 0): "Date", (1, 1): "y"} | {(3, j): j for j in range(1, 13)} | {(3, 0): "p"} | {(4 + i, j): ("ABCDEFGH"[i] if j == 0 else i * j) for i in range(8) for j in range(13)}
    wide = block([[f"c{j}" for j in range(101)]] + [[j for j in range(1, 102)]] * 3)
    cells = grid_of(spark, {"plate": plate, "wide": wide})
    got = {(r.file_id, r.rng): r for r in structured.detect(cells).withColumn("rng", addr.format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))).collect()}
    assert got["plate", "A4:M12"].method == "plate_format_detection" and got["plate", "A4:M12"].confidence == 0.95
    assert ("plate", "A1:B2") in got
    assert got["wide", "A1:CW4"].method == "wide_table_detection"


def test_cascade(spark):
    two = block([["a", "b", "c", "d", "e"]] + [["x", 1, 2, 3, 4]] * 3, bold=True) | block([["n", "m", "o", "p"]] + [["y", 5, 6, 7]] * 3, 10, 8, bold=True)
    cells = grid_of(spark, {"people": PEOPLE, "two": two})
    got = detect_tables(cells, config=Config())
    assert {(r.file_id, r.method) for r in got.collect()} == {("people", "simple_case_fast"), ("two", "island_detection")}
    assert ranges(got) == ["A1:C3", "A1:E4", "I11:L14"]


def test_semantic(spark):
    b, fill = {"bold": True}, {"bold": True, "bg": "#EEEEEE"}
    rows = {
        **{(0, j): (h, b) for j, h in enumerate(("Account", "Q1", "Q2", "Q3", "Q4"))},
        (1, 0): ("Revenue", fill),
        **{(2, j): v for j, v in enumerate(("Product", 1, 2, 3, 4))},
        **{(3, j): v for j, v in enumerate(("Service", 1, 2, 3, 4))},
        **{(4, j): (v, b) for j, v in enumerate(("Total Revenue", 2, 4, 6, 8))},
        (6, 0): ("Expenses", fill),
        **{(7, j): v for j, v in enumerate(("Salaries", 1, 2, 3, 4))},
    }
    cells = grid_of(spark, {"fin": rows})
    t = spark.createDataFrame([("fin", 0, "t", 0, 0, 7, 4)], "file_id string, sheet_idx int, table_id string, r0 int, c0 int, r1 int, c1 int")
    s = semantic.rows(cells, t)
    kinds = [r.kind for r in s.orderBy("i").collect()]
    assert kinds == ["HEADER", "SECTION_HEADER", "DATA", "DATA", "SUBTOTAL", "BLANK", "SECTION_HEADER", "DATA"]
    sec = semantic.sections(s)
    assert sorted((r.first, r.last) for r in sec.collect()) == [(1, 4), (6, 7)]
    assert [r.i for r in semantic.semantic_blanks(s, sec).collect()] == [5, 5]
    f = semantic.flags(s).first()
    assert f.has_subtotals and not f.has_grand_total


def test_multi_row_header(spark):
    b = {"bold": True}
    cells = {(0, 0): ("Department", b | {"merge": "A1:A2"}), (0, 1): ("Sales", b | {"merge": "B1:C1"}), (0, 3): ("Support", b | {"merge": "D1:E1"})}
    cells |= {(1, j + 1): (q, b) for j, q in enumerate(("Q1", "Q2", "Q1", "Q2"))}
    cells |= {(2 + i, j): v for i in range(2) for j, v in enumerate(("North", 1, 2, 3, 4))}
    df = grid_of(spark, {"h": cells})
    t = spark.createDataFrame([("h", 0, "t", 0, 0, 3, 4)], "file_id string, sheet_idx int, table_id string, r0 int, c0 int, r1 int, c1 int")
    got = merged.multi_row_headers(df, t).first()
    assert got.n_header_rows == 2
    assert got.columns == {0: ["Department"], 1: ["Sales", "Q1"], 2: ["Sales", "Q2"], 3: ["Support", "Q1"], 4: ["Support", "Q2"]}
    assert abs(got.confidence - 0.8349206349206348) < 1e-9


def test_extract(spark):
    simple_ = block([["Name", "Age", "City"], ["John", "25", "NYC"], ["Jane", "30", "LA"]])
    plate = {(0, j): j for j in range(1, 13)} | {(0, 0): "x"} | {(1 + i, j): ("ABCDEFGH"[i] if j == 0 else 1.5) for i in range(8) for j in range(13)}
    sparse = {(0, 0): "a", (0, 2): "b", (1, 1): "c", (2, 0): "d", (2, 2): "e"}
    cells = grid_of(spark, {"s": simple_, "p": plate, "q": sparse})
    t = spark.createDataFrame([("s", 0, "t", 0, 0, 2, 2), ("p", 0, "t", 0, 0, 8, 12), ("q", 0, "t", 0, 0, 2, 2)], "file_id string, sheet_idx int, table_id string, r0 int, c0 int, r1 int, c1 int")
    facts = {r.file_id: r for r in extract.analyse(cells, t).collect()}
    assert facts["s"].orientation == "vertical" and facts["s"].header_confidence == 1.0 and abs(facts["s"].quality - 1.0) < 1e-9
    assert facts["p"].wells == 96 and facts["p"].quality == 0.95
    assert facts["q"].quality < 0.8
    long = extract.extract(cells, t)
    got = extract.wide(long.where("file_id = 's'"), ["Name", "Age", "City"]).orderBy("row").collect()
    assert [(r.Name, r.Age, r.City) for r in got] == [("John", "25", "NYC"), ("Jane", "30", "LA")]
    assert [r.header for r in extract.headers(cells, t, extract.analyse(cells, t)).where("file_id = 'p'").orderBy("col").collect()][:3] == ["Well", "1", "2"]


def test_format_likeness(spark):
    cells = grid_of(spark, {"x": {(0, 0): ("a", {"bold": True, "bg": "#111111"}), (0, 1): ("b", {"bold": True, "bg": "#222222"}), (0, 2): "c"}})
    s = semantic.signatures(cells).drop(*KEY, "r")
    pair = s.select(*[F.col(n).alias(f"a_{n}") for n in s.columns]).join(s.select(*[F.col(n).alias(f"b_{n}") for n in s.columns]), F.col("a_c") < F.col("b_c"))
    got = {(r.a_c, r.b_c): r.x for r in pair.withColumn("x", semantic.format_likeness()).collect()}
    assert got == {(0, 1): 5.5 / 6.5, (0, 2): 3.5 / 5.5, (1, 2): 3.5 / 5.5}


def test_report_and_merge_options(spark):
    from sheetspark import api

    near = block([["a", "b"]] * 3) | block([["d", "e"]] * 3, 0, 3)
    cells = grid_of(spark, {"near": near, "people": PEOPLE})
    tables = detect_tables(cells, config=Config())
    got = {r.file_id: r for r in api.report(cells, tables).collect()}
    assert got["people"].method_used == "simple_case_fast" and got["people"].tables[0].startswith("A1:C3 100.00%") and got["people"].large_tables == 1 and got["people"].sheet_density == 1.0
    assert got["near"].table_count == 1
    apart = islands.detect(cells.where("file_id = 'near'"), Config(column_gap_prevents_merge=True))
    assert ranges(apart) == ["A1:B3", "D1:E3"]


def test_partitioning_changes_nothing(spark):
    cells = grid_of(spark, {"a": PEOPLE, "b": block([["a", "b"]] * 4) | block([["c", "d"]] * 4, 8, 6)})
    one, many = (sorted(map(str, detect_tables(c).collect())) for c in (cells.coalesce(1), cells.repartition(7)))
    assert one == many and KEY == ["file_id", "sheet_idx"]


def test_many_sheets_are_labelled_in_few_calls(spark, monkeypatch):
    """Islands of 300 sheets equal a flood fill; Python is called for batches of sheets, one sheet may span several."""
    import random

    rng = random.Random(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    sheets = {f"s{k:03d}": {(r, c): 1 for r in range(rng.randint(1, 30 if k % 100 else 90)) for c in range(9) if rng.random() < 0.35} for k in range(300)}
    cells = grid_of(spark, sheets)
    try:
        for gap, diagonal in ((1, True), (1, False), (2, True)):
            got = {(x.file_id, x.r, c): (x.ir, x.ic) for x in islands.components(cells, gap, diagonal).collect() for c in range(x.c0, x.c1 + 1)}
            near = [(i, j) for i in range(-gap, gap + 1) for j in range(-gap, gap + 1) if diagonal or not i or not j]
            for name, own in sheets.items():
                left = set(own)
                while left:
                    root = min(left)
                    left.discard(root)
                    queue = [root]
                    for r, c in queue:
                        assert got[name, r, c] == root
                        new = [(r + i, c + j) for i, j in near if (r + i, c + j) in left]
                        left.difference_update(new)
                        queue += new
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grouped = [f for f in (islands.components(cells), islands.detect(cells)) if "FlatMapGroupsInPandas" in f._jdf.queryExecution().toString() or "FlatMapCoGroups" in f._jdf.queryExecution().toString()]
    assert not grouped


def test_parts_are_merged_in_batches(spark):
    """No Python call for each sheet of a cascade: parts of many sheets go in batches, sheets with one part not at all."""
    bounds = {"near": [(0, 0, 2, 3), (4, 0, 6, 3)], "far": [(0, 0, 2, 3), (40, 20, 42, 23)], "one": [(0, 0, 2, 3)]}
    parts = [(n, 0, b[0], b[1], 0, 12, *b, 12, 12 * len(own), 42, 23) for n, own in bounds.items() for b in own]
    runs = [(n, 0, r, b[1], b[3]) for n, own in bounds.items() for b in own for r in range(b[0], b[2] + 1)]
    parts = spark.createDataFrame(parts, "file_id string, sheet_idx int, ir int, ic int, part int, n long, r0 int, c0 int, r1 int, c1 int, whole long, total long, max_row int, max_col int")
    got = islands.merge_parts(parts, spark.createDataFrame(runs, "file_id string, sheet_idx int, r int, c0 int, c1 int"), Config())
    assert "CoGroups" not in got._jdf.queryExecution().toString()
    assert {n: len({x.seq for x in got.collect() if x.file_id == n}) for n in bounds} == {"near": 1, "far": 2, "one": 1}


def test_cascade_moves_no_cells(spark, tmp_path):
    """Cells are laid by sheet and row band once: sums, choices of sheets and regions leave them where they lie, and labels come from bits of rows."""
    wide = [("w", r, c) for r in range(3) for c in (*range(60, 70), 130)]
    tall = [("t", r, c) for r in (*range(70), 80, 81) for c in (0, 1, 3, 63)]
    cells = complete(spark.createDataFrame([(f, r, c, "x") for f, r, c in wide + tall], "file_id string, r int, c int, val_str string"))
    lying = grid.laid(cells)
    rows, size = simple.sums(lying)
    sheets = size.select(*KEY, "total", "max_row", "max_col")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(lying.groupBy(*KEY, "_band", "r").count()).count("Exchange") == 0
    regions = spark.createDataFrame([("t", 0, 0, 1, 60, 3)], "file_id string, sheet_idx int, r0 int, c0 int, r1 int, c1 int")
    assert plan(grid.join_regions(lying, regions)).count("Exchange hashpartitioning") <= 1
    assert grid.join_regions(lying, regions).count() == 61 * 2
    of = lambda df: sorted(map(tuple, df.select(*KEY, "r", "c0", "c1", "n", "ir", "ic").collect()))
    assert of(islands.components(lying, size=sheets, rows=rows)) == of(islands.components(cells))
    every = lambda df: sorted(map(str, df.collect()))
    assert every(simple.detect(lying)) == every(simple.detect(cells))
    assert every(islands.detect(lying, Config(), sheets, rows)) == every(islands.detect(cells, Config()).select(islands.detect(lying, Config(), sheets, rows).columns))
