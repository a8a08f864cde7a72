"""Legacy workbooks from bytes put together here, record by record."""

import struct

import pytest

from sheetspark import api
from sheetspark.functions import addr
from sheetspark.model import Config
from sheetspark.sources import xls


def rec(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def short(text, wide_count=False, wide=False):
    return struct.pack("<H" if wide_count else "<B", len(text)) + bytes([wide]) + text.encode("utf-16-le" if wide else "latin-1")


def container(stream, small=False):
    """An OLE container with one stream; a small one lies in the stream of small sectors."""
    size = 64 if small else 512
    whole = stream.ljust(-(-len(stream) // size) * size if small else max(4096, -(-len(stream) // 512) * 512), b"\0")
    parts = [whole[i : i + 512].ljust(512, b"\0") for i in range(0, len(whole), 512)]
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    sectors = [0xFFFFFFFD, end] + [3 + i for i in range(len(parts) - 1)] + [end]
    entry = lambda name, kind, first, n: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", free, free, 1 if kind == 5 else free)).ljust(116, b"\0") + struct.pack("<III", first, n, 0)
    mini = end
    if small:
        mini = len(sectors)
        sectors.append(end)
        k = len(whole) // 64
        parts.append(struct.pack(f"<{k}I", *range(1, k), end).ljust(512, b"\xff"))
    directory = (entry("Root Entry", 5, 2 if small else end, len(whole) if small else 0) + entry("Workbook", 2, 0 if small else 2, len(stream) if small else len(whole))).ljust(512, b"\0")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, mini, int(small), end, 0) + struct.pack("<109I", 0, *[free] * 108)
    assert len(head) == 512 and len(sectors) <= 128
    return head + struct.pack("<128I", *sectors, *[free] * (128 - len(sectors))) + directory + b"".join(parts)


def book(split=None, sheets=("First", "Zweites ß")):
    """Two sheets: names, numbers of all kinds, a date, formulas, a merge; shared strings may be split between records."""
    strings = ["Name", "Age", "Größe", "日本", "Alice"]
    sst = struct.pack("<II", 9, len(strings)) + b"".join(short(t, True, t == "日本") for t in strings)
    table = rec(0xFC, sst) if split is None else rec(0xFC, sst[:split]) + rec(0x3C, (b"\0" if split in range(11, 15) else b"") + sst[split:])
    font = lambda weight: rec(0x31, struct.pack("<HHHHHBBBB", 220, 0, 0, weight, 0, 0, 0, 0, 0) + short("Arial"))
    xf = lambda f, form, align=0, lines=0: rec(0xE0, struct.pack("<HHHBBBB", f, form, 0, align, 0, 0, 0) + struct.pack("<IIH", lines, 0, 0))
    bof = lambda kind: rec(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    front = bof(5) + b"".join(font(w) for w in (400, 700, 400, 400, 700)) + rec(0x41E, struct.pack("<H", 200) + short("yyyy-mm-dd", True)) + xf(0, 0) + xf(1, 0, 2, 0x1152) + xf(0, 200) + xf(5, 14)
    cell = lambda kind, r, c, look, body: rec(kind, struct.pack("<HHH", r, c, look) + body)
    one = bof(0x10) + b"".join(cell(0xFD, 0, c, 1, struct.pack("<I", c)) for c in range(4)) + cell(0xFD, 1, 0, 0, struct.pack("<I", 4)) + cell(0x203, 1, 1, 0, struct.pack("<d", 25.5))
    rk = lambda v: (int(v) << 2 | 2) & 0xFFFFFFFF
    one += cell(0x27E, 1, 2, 0, struct.pack("<I", rk(-7))) + rec(0xBD, struct.pack("<HH", 2, 0) + b"".join(struct.pack("<HI", 0, n) for n in (rk(150) | 1, struct.unpack("<Q", struct.pack("<d", 3.0))[0] >> 32)) + struct.pack("<H", 1))
    one += cell(0x203, 3, 0, 2, struct.pack("<d", 45000.5)) + cell(0x203, 3, 1, 3, struct.pack("<d", 1.0)) + cell(0x205, 3, 2, 0, b"\1\0") + cell(0x205, 3, 3, 0, b"\x07\1")
    one += cell(0x06, 4, 0, 0, struct.pack("<d", 9.25) + bytes(8)) + cell(0x06, 4, 1, 0, b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + rec(0x207, short("made", True)) + cell(0x06, 4, 2, 0, b"\1\0\1\0\0\0\xff\xff" + bytes(8))
    one += rec(0xE5, struct.pack("<HHHHH", 1, 0, 0, 2, 3)) + rec(0x0A)
    two = bof(0x10) + cell(0x204, 5, 2, 0, short("lone", True)) + rec(0x0A)
    bounds = lambda at: b"".join(rec(0x85, struct.pack("<IBB", p, 0, 0) + short(n)) for p, n in zip(at, sheets))
    length = len(front) + len(bounds((0, 0))) + len(table) + 4
    return front + bounds((length, length + len(one))) + table + rec(0x0A) + one + two


WANT = {(0, 0): "Name", (0, 1): "Age", (0, 2): "Größe", (0, 3): "日本", (1, 0): "Alice", (1, 1): "25.5", (1, 2): "-7", (2, 0): "1.5", (2, 1): "3", (3, 0): "2023-03-15 12:00:00", (3, 1): "1899-12-31 00:00:00", (3, 2): "true", (3, 3): "#DIV/0!", (4, 0): "9.25", (4, 1): "made", (4, 2): "true"}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("split", [None, 8, 13, 15])
def test_cells(small, split):
    b = xls.Workbook(container(book(split), small))
    assert [n for n, _ in b.sheets] == ["First", "Zweites ß"]
    got = {(x["r"], x["c"]): x for x in b.cells(0)}
    assert {k: v["val_str"] for k, v in got.items()} == WANT
    assert got[0, 0]["is_bold"] and got[0, 0]["halign"] == "center" and (got[0, 0]["bl"], got[0, 0]["br"], got[0, 0]["bt"], got[0, 0]["bb"]) == ("medium", "thick", "thin", "thin")
    assert not got[1, 0]["is_bold"] and got[3, 1]["is_bold"] and got[3, 0]["vtype"] == "datetime" and got[1, 2]["val_num"] == -7.0 and got[3, 2]["vtype"] == "boolean"
    assert got[0, 2]["merge_range"] == "C1:D1" and not got[0, 1]["is_merged"]
    assert [(x["r"], x["c"], x["val_str"], x["sheet_idx"]) for x in b.cells(1)] == [(5, 2, "lone", 1)]


def test_faults():
    for data in (b"", b"no container", container(book())[:700], container(book()[:40])):
        rows = list(xls._cells(iter([xls.pd.DataFrame([("a.xls", data)], columns=["path", "content"])])))
        assert all(r.r.iloc[0] == -1 for r in rows)
    with pytest.raises(ValueError):
        list(xls._chain([1, 0], 0))


def test_files(spark, tmp_path):
    (tmp_path / "old.xls").write_bytes(container(book()))
    (tmp_path / "hurt.xls").write_bytes(container(book())[:900])
    read = api.read_folder(spark, str(tmp_path), Config())
    assert {(r.r, r.c): r.val_str for r in read.cells.where("sheet_idx = 0").collect()} == WANT
    assert [r.file_id.rsplit("/", 1)[-1] for r in read.errors.collect()] == ["hurt.xls"]
    found = api.detect_tables(spark, str(tmp_path), Config())
    assert ("old.xls", "A1:D5") in {(r.file_id.rsplit("/", 1)[-1], r.range) for r in found.withColumn("range", addr.format_range(*[addr.F.col(x) for x in ("r0", "c0", "r1", "c1")])).collect()}
