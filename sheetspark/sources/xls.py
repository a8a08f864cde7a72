"""Legacy workbooks (xls, BIFF8 in an OLE container) to cells, with nothing but the bytes.

The container is a file system of sectors: a table says which sector follows which, small streams lie in a stream of
their own. The workbook stream is a row of records; each sheet's records start where its entry in the globals says.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CELLS, FAULT
from .xlsx import DATE_FORMATS, NAMES, _defaults, _is_date_code

FREE = 0xFFFFFFFC  # this and above are marks, not sectors
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}
ALIGN = {1: "left", 2: "center", 3: "right", 4: "fill", 5: "justify"}
#: Border styles by weight; any other than 0 is thin.
WEIGHT = {0: None, 2: "medium", 5: "thick", 6: "thick", 8: "medium", 10: "medium", 12: "medium"}
FAULTS = (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error, UnicodeDecodeError)


def _chain(table: list[int], first: int) -> Iterator[int]:
    seen = 0
    while first < FREE:
        if seen > len(table):
            raise ValueError("sectors of the container go round in a circle")
        yield first
        first, seen = table[first], seen + 1


def stream_of(data: bytes, *names: str) -> bytes:
    """The first of the named streams in an OLE container."""
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("no OLE container")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, = struct.unpack_from("<I", data, 48)
    limit, mini, _, more, n_more = struct.unpack_from("<IIIII", data, 56)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    parts = numbers(data[76:512])
    for _ in range(n_more):  # further places of the table's own sectors
        *here, more = numbers(sector(more))
        parts += here
    table = [n for p in parts if p < FREE for n in numbers(sector(p))]
    read = lambda first: b"".join(map(sector, _chain(table, first)))
    entries, root, found = read(directory), b"", {}
    for at in range(0, len(entries) - 127, 128):
        length = struct.unpack_from("<H", entries, at + 64)[0]
        name, kind = entries[at : at + max(0, length - 2)].decode("utf-16-le"), entries[at + 66]
        first, n = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = read(first)
        elif kind == 2:
            found.setdefault(name, (first, n))
    for name in names:
        if name in found:
            first, n = found[name]
            if n >= limit:
                return read(first)[:n]
            small_table = numbers(read(mini))
            return b"".join(root[i * small : (i + 1) * small] for i in _chain(small_table, first))[:n]
    raise ValueError(f"no stream {' or '.join(names)} in the container")


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    """(kind, body, place) of each record from a place on."""
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + n], at
        at += 4 + n


class _Strings:
    """Reads the shared strings, which go on over several records; within a text a new record starts with its width again."""

    def __init__(self, bodies: list[bytes]):
        self.bodies, self.k, self.at = bodies, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.bodies[self.k]):
                self.k, self.at = self.k + 1, 0
            part = self.bodies[self.k][self.at : self.at + n]
            out, self.at, n = out + part, self.at + len(part), n - len(part)
        return out

    def text(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while count:
            if self.at >= len(self.bodies[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = self.bodies[self.k][0] & 1
            n = min(count, (len(self.bodies[self.k]) - self.at) // (1 + wide))
            if not n:
                raise ValueError("a text is cut inside a character")
            out += self.take(n * (1 + wide)).decode("utf-16-le" if wide else "latin-1")
            count -= n
        self.take(4 * runs + extra)
        return out


def _short_text(body: bytes, at: int, wide_count: bool) -> str:
    count = struct.unpack_from("<H", body, at)[0] if wide_count else body[at]
    at += 2 if wide_count else 1
    return body[at + 1 : at + 1 + 2 * count].decode("utf-16-le") if body[at] & 1 else body[at + 1 : at + 1 + count].decode("latin-1")


def _rk(n: int) -> float:
    """A number in 30 bits: whole or the top of a double, perhaps times 100."""
    value = float((n - (1 << 32) if n >> 31 else n) >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & ~3) << 32))[0]
    return value / 100 if n & 1 else value


class Workbook:
    def __init__(self, data: bytes):
        self.data = stream_of(data, "Workbook", "Book")
        self.sheets: list[tuple[str, int]] = []
        self.strings: list[str] = []
        self.epoch = datetime(1899, 12, 30)
        formats, fonts, looks, shared, last = {}, [], [], [], 0
        for kind, body, _ in _records(self.data):
            if kind == 0x809 and struct.unpack_from("<H", body)[0] != 0x600:
                raise ValueError("the workbook is older than BIFF8")
            if kind == 0x2F:
                raise ValueError("the workbook is encrypted")
            if kind == 0x0A:
                break
            if kind == 0x85 and body[5] == 0:  # a sheet of cells
                self.sheets.append((_short_text(body, 6, False), struct.unpack_from("<I", body)[0]))
            elif kind == 0x22 and body[0]:
                self.epoch = datetime(1904, 1, 1)
            elif kind == 0x41E:
                formats[struct.unpack_from("<H", body)[0]] = _short_text(body, 2, True)
            elif kind == 0x31:
                height, flags, _, weight = struct.unpack_from("<HHHH", body)
                fonts.append({"font_size": height / 20, "is_italic": bool(flags & 2), "is_bold": weight >= 600, "is_underline": body[10] != 0})
            elif kind == 0xE0:
                looks.append(body)
            elif kind == 0xFC or kind == 0x3C and last in (0xFC, 0x3C) and shared:
                shared.append(body)
            last = kind
        if shared:
            reader = _Strings(shared)
            _, unique = struct.unpack("<II", reader.take(8))
            self.strings = [reader.text() for _ in range(unique)]
        self.looks = []
        for body in looks:
            font, form = struct.unpack_from("<HH", body)
            own = dict(fonts[font - (font > 4)]) if font - (font > 4) < len(fonts) else {}  # font 4 is never written
            lines = struct.unpack_from("<H", body, 10)[0]
            own |= {side: WEIGHT.get(lines >> 4 * k & 15, "thin") for k, side in enumerate(("bl", "br", "bt", "bb"))}
            own |= {"halign": ALIGN.get(body[6] & 7), "indent": body[8] & 15}
            self.looks.append((own, form in DATE_FORMATS or _is_date_code(formats.get(form, ""))))

    def cells(self, index: int) -> Iterator[dict]:
        name, start = self.sheets[index]
        found, merges, waiting = [], [], None
        for kind, body, at in _records(self.data, start):
            if kind == 0x0A:
                break
            if kind == 0xE5:
                n = struct.unpack_from("<H", body)[0]
                merges += [struct.unpack_from("<HHHH", body, 2 + 8 * k) for k in range(n)]  # first and last row, first and last column
            elif kind == 0x207 and waiting:
                found.append((*waiting, _short_text(body, 0, True), None, "string"))
                waiting = None
            elif kind == 0xBD:
                r, c = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    look, n = struct.unpack_from("<HI", body, 4 + 6 * k)
                    found.append((r, c + k, look, None, _rk(n), "number"))
            elif kind in (0x203, 0x27E, 0xFD, 0x204, 0x205, 0x06):
                r, c, look = struct.unpack_from("<HHH", body)
                if kind == 0x203:
                    found.append((r, c, look, None, struct.unpack_from("<d", body, 6)[0], "number"))
                elif kind == 0x27E:
                    found.append((r, c, look, None, _rk(struct.unpack_from("<I", body, 6)[0]), "number"))
                elif kind == 0xFD:
                    found.append((r, c, look, self.strings[struct.unpack_from("<I", body, 6)[0]], None, "string"))
                elif kind == 0x204:
                    found.append((r, c, look, _short_text(body, 6, True), None, "string"))
                elif kind == 0x205:
                    found.append((r, c, look, ERRORS.get(body[6], "#ERR"), None, "string") if body[7] else (r, c, look, "true" if body[6] else "false", None, "boolean"))
                elif body[12:14] != b"\xff\xff":
                    found.append((r, c, look, None, struct.unpack_from("<d", body, 6)[0], "number"))
                elif body[6] == 0:
                    waiting = (r, c, look)  # the text of the result is the next record
                elif body[6] == 1:
                    found.append((r, c, look, "true" if body[8] else "false", None, "boolean"))
                elif body[6] == 2:
                    found.append((r, c, look, ERRORS.get(body[8], "#ERR"), None, "string"))
        inside = lambda r, c: next((m for m in merges if m[0] <= r <= m[1] and m[2] <= c <= m[3]), None)
        for r, c, look, text, number, kind in found:
            own, is_date = self.looks[look] if look < len(self.looks) else ({}, False)
            if number is not None and is_date:
                kind, text = "datetime", (self.epoch + timedelta(days=number)).isoformat(sep=" ", timespec="seconds")
            elif number is not None:
                text = str(int(number)) if number == int(number) else repr(number)
            m = inside(r, c)
            ref = f"{_letters(m[2])}{m[0] + 1}:{_letters(m[3])}{m[1] + 1}" if m else None
            yield {"sheet_idx": index, "sheet_name": name, "r": r, "c": c, "val_str": text, "val_num": number, "vtype": kind, "is_merged": ref is not None, "merge_range": ref, **own}


def _letters(c: int) -> str:
    out = ""
    while c >= 0:
        out, c = chr(65 + c % 26) + out, c // 26 - 1
    return out


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    base = dict.fromkeys(NAMES) | _defaults()
    for df in batches:
        for path, content in zip(df.path, df.content):
            tell = lambda i, e: base | {"file_id": path, "sheet_idx": i, "r": FAULT, "c": 0, "val_str": f"{type(e).__name__}: {e}", "vtype": "error"}  # noqa: B023,E731
            try:
                book = Workbook(content)
            except FAULTS as e:
                yield pd.DataFrame([tell(-1, e)], columns=NAMES)
                continue
            for i in range(len(book.sheets)):  # a sheet has 65,536 rows and 256 columns at most
                try:
                    rows = [base | {"file_id": path} | cell for cell in book.cells(i)]
                except FAULTS as e:
                    rows = [tell(i, e)]
                for at in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[at : at + 50_000], columns=NAMES)


def parse_xls(files: DataFrame, max_sheets: int | None = None) -> DataFrame:
    """cells of identified legacy workbooks, with rows at FAULT that tell of what could not be read."""
    cells = files.where(F.col("file_type") == "xls").select("path", "content").mapInPandas(_cells, CELLS)
    return cells if max_sheets is None else cells.where(F.col("sheet_idx") < max_sheets)
