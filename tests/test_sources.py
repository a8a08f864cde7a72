"""Files in: identification, encodings, text and workbook readers, from bytes made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sheetspark import api
from sheetspark.functions import addr
from sheetspark.model import Config
from sheetspark.sources import identify, registry, text, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(rows, name="Sales", merge="", bold=True):
    """A small workbook: inline strings and numbers, first row bold with a border."""
    cells = []
    for r, row in enumerate(rows):
        out = []
        for c, v in enumerate(row):
            ref, style = f"{chr(65 + c)}{r + 1}", ' s="1"' if r == 0 and bold else ""
            out.append(f'<c r="{ref}"{style} t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"{style}><v>{v}</v></c>')
        cells.append(f'<row r="{r + 1}">{"".join(out)}</row>')
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("_rels/.rels", "<Relationships/>")
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets><definedNames><definedName name="Area">{name}!$A$1:$B$3</definedName><definedName name="One">{name}!$A$1</definedName><definedName name="_xlnm.Print_Area">{name}!$A$1:$Z$100</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><fonts><font/><font><b/><sz val="11"/></font></fonts><fills><fill/><fill><patternFill patternType="solid"><fgColor rgb="FFEEEEEE"/></patternFill></fill></fills><borders><border/><border><top style="double"/></border></borders><cellXfs><xf/><xf fontId="1" fillId="1" borderId="1"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData>{"".join(cells)}</sheetData>{merge}</worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="../tables/table1.xml"/></Relationships>')
        z.writestr("xl/tables/table1.xml", f'<table {MAIN} name="T" displayName="T" ref="A1:B3"><tableColumns><tableColumn name="a"/><tableColumn name="b"/></tableColumns></table>')
    return data.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "people.csv").write_text("Name,Age,City\nAlice,25,New York\nBob,30,London\nEve,35,Paris\n")
    for name, sep in (("tab.tsv", "\t"), ("semi.csv", ";"), ("pipe.csv", "|")):
        (d / name).write_text("\n".join(sep.join(x) for x in (["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"])))
    (d / "sales.xlsx").write_bytes(workbook([["Item", "Q1", "Q2", "Q3", "Q4"]] + [[f"p{i}", i, i * 2, i * 3, i * 4] for i in range(2, 6)]))
    (d / "broken.xlsx").write_bytes(b"this is no archive at all, only text of some length to look at")
    (d / "empty.csv").write_bytes(b"")
    (d / "wrong.xls").write_text("Name,Age,City\nAlice,25,Rome\nBob,30,Oslo\n")
    (d / ".hidden.csv").write_text("a,b\n1,2\n")
    return str(d)


def test_identify(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: r for r in identify.identify(identify.read_files(spark, folder)).drop("content").collect()}
    assert ".hidden.csv" not in got
    assert {n: got[n].file_type for n in ("people.csv", "tab.tsv", "sales.xlsx", "wrong.xls")} == {"people.csv": "csv", "tab.tsv": "tsv", "sales.xlsx": "xlsx", "wrong.xls": "csv"}
    assert got["sales.xlsx"].confidence == 0.95 and got["wrong.xls"].format_mismatch and got["people.csv"].encoding == "utf-8"


def test_magic_and_marks(spark):
    rows = [("a.xls", bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 100), ("b.txt", "﻿a".encode("utf-16-le")), ("c.bin", b"%PDF-1.4"), ("d.csv", bytes(range(32)) * 4)]
    df = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in rows], "path string, content binary, length long")
    got = {r.path: r for r in identify.identify(df).select("path", "file_type", identify.bom(F.col("content")).alias("bom")).collect()}
    assert got["a.xls"].file_type == "xls" and got["b.txt"].bom == "utf-16-le" and got["c.bin"].file_type == "unknown" and got["d.csv"].file_type == "csv"


def test_text_delimiters():
    lines = ["a\tb\tc"] * 5
    assert text.score_text_delimiter(lines, "\t") == 3 * 5 * 0.1
    assert text.pick_text_delimiter("\n".join(["a|b|c|d"] * 6)) == "|"
    assert list(text.rows_of(b"x\ty\n\n1\t2\n3\t4\n5\t6\n7\t8\n9\t0\n1\t1\n2\t2\n", "txt", "utf-8"))[1] == ["1", "2"]


def test_read_workbook(spark, folder):
    files = identify.identify(identify.read_files(spark, folder))
    cells = xlsx.read_workbooks(files)
    rows = {(r.r, r.c): r for r in cells.collect()}
    assert len(rows) == 25 and rows[0, 0].is_bold and rows[0, 0].bg_color == "#EEEEEE" and rows[0, 0].bt == "thick" and rows[2, 1].val_num == 3.0 and rows[2, 1].vtype == "number"
    hints = {(r.kind, r.confidence) for r in xlsx.detection_hints(xlsx.workbook_metadata(files)).collect()}
    assert hints == {("table", 0.95), ("named_range", 0.7), ("print_area", 0.5)}


def test_detect_files(spark, folder):
    found = api.detect_tables(spark, folder, Config())
    got = {(r.file_id.rsplit("/", 1)[-1], r.range): r for r in found.withColumn("range", addr.format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))).collect()}
    assert got["people.csv", "A1:C4"].method == "simple_case_fast" and got["people.csv", "A1:C4"].confidence == 0.9999999999999999
    assert ("sales.xlsx", "A1:E5") in got
    assert {n for n, r in got if r == "A1:C3"} == {"tab.tsv", "semi.csv", "pipe.csv", "wrong.xls"}
    assert not [n for n, _ in got if n in ("broken.xlsx", "empty.csv")]


def test_faults_are_rows(spark, tmp_path):
    good = workbook([["Item", "Q1"], ["a", 1], ["b", 2]])
    (tmp_path / "good.xlsx").write_bytes(good)
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 400_000)
    damaged = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(good)) as z, zipfile.ZipFile(damaged, "w") as out:
        for n in z.namelist():
            if n == "xl/workbook.xml":
                body = z.read(n).replace(b"</sheets>", b'<sheet name="Second" sheetId="2" r:id="rId2"/></sheets>')
            elif n.endswith("workbook.xml.rels"):
                body = z.read(n).replace(b"</Relationships>", b'<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
            else:
                body = z.read(n)
            out.writestr(n, body)
        out.writestr("xl/worksheets/sheet2.xml", "<worksheet><sheetData><row></worksheet>")
    (tmp_path / "hurt.xlsx").write_bytes(damaged.getvalue())
    read = api.read_folder(spark, str(tmp_path), Config(max_file_size_mb=1))
    name = lambda p: p.rsplit("/", 1)[-1]
    errors = {(name(r.file_id), r.sheet_idx): r.error for r in read.errors.collect()}
    assert set(errors) == {("big.csv", -1), ("hurt.xlsx", 1)} and errors["big.csv", -1] == "file too large" and errors["hurt.xlsx", 1].startswith("ParseError")
    assert {(name(r.file_id), r.sheet_idx) for r in read.sheets.collect()} == {("good.xlsx", 0), ("hurt.xlsx", 0)}
    only = api.read_folder(spark, str(tmp_path), Config(max_file_size_mb=1, max_sheets=1))
    assert {(name(r.file_id), r.sheet_idx) for r in only.errors.collect()} == {("big.csv", -1)}


def test_large_merges(spark, tmp_path):
    (tmp_path / "m.xlsx").write_bytes(workbook([["Item", "Q1"], ["a", 1], ["b", 2]], merge='<mergeCells count="2"><mergeCell ref="A1:A1048576"/><mergeCell ref="B2:B3"/></mergeCells>'))
    cells = xlsx.read_workbooks(identify.identify(identify.read_files(spark, str(tmp_path))))
    assert {(r.r, r.c): r.merge_range for r in cells.collect()} == {(i, 0): "A1:A1048576" for i in range(3)} | {(0, 1): None, (1, 1): "B2:B3", (2, 1): "B2:B3"}


def test_text_faults(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "rows_of", lambda *a: iter([["a", "b"]] * 5))
    out = list(text._parse(iter([text.pd.DataFrame([("d/x.csv", b"", "csv", None)], columns=["path", "content", "file_type", "encoding"])])))
    assert [len(x) for x in out] == [10]
    monkeypatch.setattr(text, "MAX_ROWS", 2)
    out = list(text._parse(iter([text.pd.DataFrame([("d/x.csv", b"", "csv", None)], columns=["path", "content", "file_type", "encoding"])])))
    assert out[0].r.tolist() == [0, 0, 1, 1, 2, 2, -1]


def test_results_and_summary(spark, folder, tmp_path):
    results, long = api.extraction_results(spark, folder, Config())
    got = {(r.file_id.rsplit("/", 1)[-1], r.range): r for r in results.collect()}
    people = got["people.csv", "A1:C4"]
    assert people.orientation == "vertical" and people.columns == ["Name", "Age", "City"] and people.status == "success" and people.n_rows == 3
    out = str(tmp_path / "tables")
    api.write_tables(long, out)
    back = spark.read.option("header", True).csv(out)
    assert {r.value for r in back.where("header = 'Name'").collect()} >= {"Alice", "Bob", "Eve"}
    files = api.identify(spark, folder, Config())
    s = {r.file_id.rsplit("/", 1)[-1]: r for r in api.summary(files, api.detect_tables(spark, folder, Config())).collect()}
    assert s["people.csv"].n_tables == 1 and s["people.csv"].success_rate == 1.0 and s["broken.xlsx"].n_tables == 0


def test_media_types_and_strict_checking(spark, folder, tmp_path):
    got = {r.path.rsplit("/", 1)[-1]: r.mime_type for r in identify.identify(identify.read_files(spark, folder)).select("path", "mime_type").collect()}
    assert got["people.csv"] == got["wrong.xls"] == "text/csv" and got["tab.tsv"] == "text/tab-separated-values" and got["sales.xlsx"].endswith("spreadsheetml.sheet") and got["broken.xlsx"] == "text/plain"
    (tmp_path / "a.xlsx").write_bytes(b"%PDF-1.4 and so on")
    with pytest.raises(registry.UnsupportedFormatError):
        api.identify(spark, str(tmp_path), Config(strict_format_checking=True))
    assert api.identify(spark, str(tmp_path), Config()).first().mime_type == "application/pdf"


def test_registry():
    assert registry.is_supported("x/y.CSV") and not registry.is_supported("x/y.pdf")
    with pytest.raises(registry.UnsupportedFormatError):
        registry.reader_for("xlsb")
    registry.register("xlsb", registry.reader_for("xlsx"))
    assert "xlsb" in registry.supported_types()
    registry.reset()
    assert "xlsb" not in registry.supported_types()


def test_config(monkeypatch):
    monkeypatch.setenv("SHEETSPARK_CONFIDENCE_THRESHOLD", "0.8")
    assert Config.from_env().confidence_threshold == 0.8
    with pytest.raises(ValueError):
        Config(empty_row_tolerance=9)


def test_nothing_is_no_text(spark, tmp_path):
    """A share of no characters is not computed: the division would end the job."""
    rows = [("empty.csv", bytearray(b""), 0), ("a.csv", bytearray(b"a,b\n1,2\n"), 8)]
    got = {r.path: r for r in identify.identify(spark.createDataFrame(rows, "path string, content binary, length long")).collect()}
    assert (got["empty.csv"].file_type, got["empty.csv"].method) == ("csv", "extension")
    text = spark.createDataFrame([("",), (None,), ("abc",), ("ééa",)], "t string")
    assert [r[0] for r in text.select(identify.is_likely_text(F.col("t"))).collect()] == [False, False, True, False]
