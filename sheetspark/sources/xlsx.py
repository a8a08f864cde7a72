"""Workbooks (xlsx, xlsm) to cells, and their own hints about tables, with the standard library's zip and XML readers."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addr import is_data_range
from ..model import CELLS, FAULT

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Border styles by weight; any other is thin.
MEDIUM = {"medium", "mediumDashed", "mediumDashDot", "mediumDashDotDot"}
THICK = {"thick", "double"}
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Cells of a merge that are listed one by one; larger merges are looked up by their bounds.
LISTED = 10_000
CELL_REF = re.compile(r"([A-Z]+)(\d+)")
HINTS = "file_id string, kind string, name string, refers_to string, confidence double, headers array<string>, hidden boolean"
NAMES = [x.split()[0] for x in CELLS.split(", ")]


def _index(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n - 1


def _is_date_code(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.|\*.', "", code.lower())
    return bool(re.search("[ymdhs]", plain)) and "general" not in plain


def _color(x) -> str | None:
    rgb = x.get("rgb") if x is not None else None
    return f"#{rgb[-6:].upper()}" if rgb else None


def _weight(x) -> str | None:
    style = x.get("style") if x is not None else None
    return None if not style or style == "none" else "medium" if style in MEDIUM else "thick" if style in THICK else "thin"


class Styles:
    def __init__(self, root):
        find = lambda p: root.findall("/".join(MAIN + x for x in p.split("/"))) if root is not None else []
        codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in find("numFmts/numFmt")}
        on = lambda f, n: (e := f.find(MAIN + n)) is not None and e.get("val", "1") not in ("0", "false")
        fonts = [dict(is_bold=on(f, "b"), is_italic=on(f, "i"), is_underline=f.find(MAIN + "u") is not None, font_size=float(s.get("val")) if (s := f.find(MAIN + "sz")) is not None else None, font_color=_color(f.find(MAIN + "color"))) for f in find("fonts/font")]
        fills = []
        for f in find("fills/fill"):
            p = f.find(MAIN + "patternFill")
            fills.append(_color(p.find(MAIN + "fgColor")) if p is not None and p.get("patternType") not in (None, "none") else None)
        borders = [dict(zip(("bt", "bb", "bl", "br"), (_weight(b.find(MAIN + s)) for s in ("top", "bottom", "left", "right")))) for b in find("borders/border")]
        self.formats = []
        for x in find("cellXfs/xf"):
            n, align = int(x.get("numFmtId", 0)), x.find(MAIN + "alignment")
            out = {**(fonts[i] if (i := int(x.get("fontId", 0))) < len(fonts) else {}), **(borders[i] if (i := int(x.get("borderId", 0))) < len(borders) else {})}
            out["bg_color"] = fills[i] if (i := int(x.get("fillId", 0))) < len(fills) else None
            out["indent"] = int(align.get("indent", 0)) if align is not None else 0
            out["halign"] = align.get("horizontal") if align is not None else None
            self.formats.append((out, n in DATE_FORMATS or _is_date_code(codes.get(n, ""))))

    def of(self, index: int):
        return self.formats[index] if index < len(self.formats) else ({}, False)


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        root = self.xml("xl/workbook.xml")
        if root is None:
            raise ValueError("no workbook in the archive")
        rels = self.rels("xl/workbook.xml")
        self.sheets = [(s.get("name"), rels.get(s.get(REL + "id"), ""), s.get("state", "visible")) for s in root.iter(MAIN + "sheet")]
        pr = root.find(MAIN + "workbookPr")
        self.epoch = datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.defined = list(root.iter(MAIN + "definedName"))
        self.styles = Styles(self.xml("xl/styles.xml"))
        shared = self.xml("xl/sharedStrings.xml")
        self.shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in shared.iter(MAIN + "si")] if shared is not None else []

    def xml(self, name: str):
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def rels(self, part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            out[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        return out

    def value(self, c, is_date: bool) -> tuple[str | None, float | None, str, str | None]:
        """Text, number, type and formula of a cell element. Formulas are kept as text."""
        kind, v, f = c.get("t", "n"), c.findtext(MAIN + "v"), c.find(MAIN + "f")
        if f is not None:
            text = "=" + (f.text or "")
            return text, None, "string", text
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in c.iter(MAIN + "t"))
            return text, None, "string", None
        if v is None:
            return None, None, "empty", None
        if kind == "s":
            return self.shared[int(v)], None, "string", None
        if kind == "b":
            return ("true" if v in ("1", "true") else "false"), None, "boolean", None
        if kind == "d":
            return v, None, "datetime", None
        if kind in ("str", "e"):
            return v, None, "string", None
        number = float(v)
        if is_date:
            return (self.epoch + timedelta(days=number)).isoformat(sep=" ", timespec="seconds"), number, "datetime", None
        return v, number, "number", None

    def cells(self, index: int) -> Iterator[dict]:
        name, part, _ = self.sheets[index]
        if part not in self.names:
            return
        root = self.xml(part)
        merges = [m.get("ref") for m in root.iter(MAIN + "mergeCell")]
        boxes = [(ref, *(x for p in ref.split(":") for m in [CELL_REF.fullmatch(p)] if m for x in (int(m[2]) - 1, _index(m[1])))) for ref in merges]
        boxes = [b for b in boxes if len(b) == 5]
        wide = [b for b in boxes if (b[3] - b[1] + 1) * (b[4] - b[2] + 1) > LISTED]
        covered = {(r, c): b[0] for b in boxes if b not in wide for r in range(b[1], b[3] + 1) for c in range(b[2], b[4] + 1)}
        row = -1
        for r_ in root.iter(MAIN + "row"):
            row = int(r_.get("r")) - 1 if r_.get("r") else row + 1
            col = -1
            for c_ in r_.iter(MAIN + "c"):
                m = CELL_REF.fullmatch(c_.get("r", ""))
                col = _index(m[1]) if m else col + 1
                look, is_date = self.styles.of(int(c_.get("s", 0)))
                text, number, kind, formula = self.value(c_, is_date)
                if text is None and c_.get("s") in (None, "0"):
                    continue
                ref = covered.get((row, col)) or next((b[0] for b in wide if b[1] <= row <= b[3] and b[2] <= col <= b[4]), None)
                yield {"sheet_idx": index, "sheet_name": name, "r": row, "c": col, "val_str": text, "val_num": number, "vtype": kind, "is_merged": ref is not None, "merge_range": ref, "has_formula": formula is not None, "formula": formula, **look}

    def hints(self) -> Iterator[tuple]:
        """(kind, name, refers_to, confidence, headers, hidden): tables, named ranges, print areas, pivots."""
        for name, part, _ in self.sheets:
            for target in self.rels(part).values():
                if re.search(r"tables/table[^/]*\.xml$", target) and (t := self.xml(target)) is not None:
                    yield "table", t.get("displayName") or t.get("name"), f"{name}!{t.get('ref')}", 0.95, [c.get("name") for c in t.iter(MAIN + "tableColumn")], False
        for d in self.defined:
            title, text, hidden = d.get("name", ""), (d.text or "").replace("$", ""), d.get("hidden") == "1"
            if title == "_xlnm.Print_Area":
                yield "print_area", title, text, 0.5, None, hidden
            elif not title.startswith("_xlnm."):
                yield "named_range", title, text, 0.7, None, hidden
        if any(n.startswith("xl/pivotTables/") for n in self.names):
            yield "pivot", None, None, 0.0, None, False


#: What a damaged workbook may raise while it is read.
FAULTS = (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError, IndexError, TypeError, OverflowError, NotImplementedError, RuntimeError, OSError, EOFError, zlib.error)


def _defaults() -> dict:
    return {"is_bold": False, "is_italic": False, "is_underline": False, "is_merged": False, "has_formula": False, "indent": 0, "vtype": "string", "sheet_idx": 0}


def _cells(max_sheets: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = dict.fromkeys(NAMES) | _defaults()
        for df in batches:
            for path, content in zip(df.path, df.content):
                out: list[dict] = []
                tell = lambda i, e: base | {"file_id": path, "sheet_idx": i, "r": FAULT, "c": 0, "val_str": f"{type(e).__name__}: {e}", "vtype": "error"}  # noqa: B023,E731
                try:
                    book = Workbook(content)
                except FAULTS as e:
                    yield pd.DataFrame([tell(-1, e)], columns=NAMES)
                    continue
                for i in range(len(book.sheets) if max_sheets is None else min(max_sheets, len(book.sheets))):
                    try:  # a damaged sheet leaves the others as they are
                        for cell in book.cells(i):
                            out.append(base | {"file_id": path} | cell)
                            if len(out) >= 50_000:
                                yield pd.DataFrame(out, columns=NAMES)
                                out = []
                    except FAULTS as e:
                        out.append(tell(i, e))
                if out:
                    yield pd.DataFrame(out, columns=NAMES)

    return run


def read_workbooks(files: DataFrame, max_sheets: int | None = None) -> DataFrame:
    """cells of identified workbooks."""
    return parse_workbooks(files, max_sheets).where(F.col("r") != FAULT)


def parse_workbooks(files: DataFrame, max_sheets: int | None = None) -> DataFrame:
    """The same with rows at FAULT that tell of what could not be read."""
    return files.where(F.col("file_type").isin("xlsx", "xlsm")).select("path", "content").mapInPandas(_cells(max_sheets), CELLS)


def _hints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in HINTS.split(", ")]
    for df in batches:
        out = []
        for path, content in zip(df.path, df.content):
            try:
                out += [(path, *h) for h in Workbook(content).hints()]
            except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError):
                continue
        yield pd.DataFrame(out, columns=names)


def workbook_metadata(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_type").isin("xlsx", "xlsm")).select("path", "content").mapInPandas(_hints, HINTS)


def detection_hints(metadata: DataFrame) -> DataFrame:
    """Where a workbook itself says that tables are: tables, named ranges of more than one cell, print areas."""
    return metadata.where((F.col("kind").isin("table", "print_area")) | ((F.col("kind") == "named_range") & is_data_range(F.col("refers_to")))).select("file_id", "kind", "name", "refers_to", "confidence")


def sheets_of(files: DataFrame) -> DataFrame:
    """file_id, sheet_idx, sheet_name, is_visible of every sheet, empty ones too; file_id and error of files that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for path, content in zip(df.path, df.content):
                try:
                    out += [(path, i, n, state == "visible", None) for i, (n, _, state) in enumerate(Workbook(content).sheets)]
                except Exception as e:  # noqa: BLE001  any fault of the file is its own row
                    out.append((path, 0, None, True, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file_id", "sheet_idx", "sheet_name", "is_visible", "error"])

    return files.where(F.col("file_type").isin("xlsx", "xlsm")).select("path", "content").mapInPandas(run, "file_id string, sheet_idx int, sheet_name string, is_visible boolean, error string")
