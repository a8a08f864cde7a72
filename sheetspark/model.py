"""Schema of cells, options and the thresholds that define results."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What identifies a sheet.
KEY = ["file_id", "sheet_idx"]
#: Row of the rows in which readers tell of what they could not read; sheet_idx -1 stands for the whole file.
FAULT = -1

CELLS = (
    "file_id string, sheet_idx int, sheet_name string, r int, c int, val_str string, val_num double, vtype string, fmt_str string, "
    "is_bold boolean, is_italic boolean, is_underline boolean, font_size double, font_color string, bg_color string, "
    "bt string, bb string, bl string, br string, is_merged boolean, merge_range string, has_formula boolean, formula string, indent int, halign string"
)
#: Columns of cells that table detection looks at.
LOOKED = [*KEY, "r", "c", "val_str", "val_num", "vtype", "is_bold", "font_size", "font_color", "bg_color", "bt", "bb", "bl", "br", "halign"]
#: Value of a column that a source does not give.
DEFAULTS = {"vtype": "string", "is_bold": False, "is_italic": False, "is_underline": False, "is_merged": False, "has_formula": False, "indent": 0, "sheet_idx": 0}

TABLES = "file_id string, sheet_idx int, table_id string, r0 int, c0 int, r1 int, c1 int, confidence double, method string, headers array<string>"

# Thresholds of detection.
GOOD_SIZE, SMALL_SIZE = 20, 4
BLANK_SHARE, TOTAL_BOLD, SAME_COLUMN, MIN_PATTERN_ROWS, SAMPLE_ROWS, FIRST_ROWS = 0.9, 0.5, 0.8, 4, 20, 10
PLATES = {6: (2, 3), 24: (4, 6), 96: (8, 12), 384: (16, 24), 1536: (32, 48)}
SUBTOTAL_WORDS = ("subtotal", "sub-total")
TOTAL_WORDS = ("grand total", "total", "sum")
SECTION_WORDS = ("section", "category", "group")


@dataclass(frozen=True)
class Config:
    """Options of detection; a Config is never changed, `with_` makes another."""

    confidence_threshold: float = 0.7
    adaptive_thresholds: bool = True
    min_table_percentage: float = 0.005
    prefer_large_tables: bool = True
    empty_row_tolerance: int = 1
    use_border_detection: bool = True
    max_file_size_mb: float = 2000.0
    max_gap: int = 1
    min_island_size: int = SMALL_SIZE
    max_tables_per_sheet: int | None = None
    min_table_size: tuple[int, int] | None = None
    max_sheets: int | None = None
    file_detection_buffer_size: int = 8192
    strict_format_checking: bool = False
    column_gap_prevents_merge: bool = False
    min_column_overlap_for_merge: float = 0.5
    enable_simple: bool = True
    enable_boxes: bool = True
    enable_islands: bool = True

    def __post_init__(self):
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError(f"confidence_threshold must be in [0, 1], got {self.confidence_threshold}")
        if not 0 <= self.empty_row_tolerance <= 5:
            raise ValueError(f"empty_row_tolerance must be in 0..5, got {self.empty_row_tolerance}")
        if self.file_detection_buffer_size < 512 or not 0 <= self.min_column_overlap_for_merge <= 1:
            raise ValueError("file_detection_buffer_size must be 512 or more and min_column_overlap_for_merge in [0, 1]")
        if self.max_gap < 0 or self.min_island_size < 1:
            raise ValueError("max_gap must not be negative and min_island_size must be positive")

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    @classmethod
    def from_env(cls, prefix: str = "SHEETSPARK_") -> "Config":
        """Fields from environment variables by upper-case name; those of other kinds than number and switch are left."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            if kind is bool:
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif kind in (int, float):
                found[f.name] = kind(raw)
        return cls(**found)


def complete(cells: DataFrame) -> DataFrame:
    """cells with every column of CELLS, those that were missing at their defaults."""
    out = []
    for part in CELLS.split(", "):
        name, kind = part.split()
        out.append((F.col(name) if name in cells.columns else F.lit(DEFAULTS.get(name))).cast(kind).alias(name))
    return cells.select(*out)


def filled(prefix: str = "") -> Column:
    """Not empty: a value that is more than white space."""
    v = F.col(f"{prefix}val_str")
    return v.isNotNull() & (F.trim(v) != "")


def valued(prefix: str = "") -> Column:
    return F.col(f"{prefix}val_str").isNotNull()


def truthy(prefix: str = "") -> Column:
    """A value that is not empty text, zero or false."""
    v, n, t = F.col(f"{prefix}val_str"), F.col(f"{prefix}val_num"), F.col(f"{prefix}vtype")
    return v.isNotNull() & (v != "") & ~((t == "number") & (F.coalesce(n, F.lit(1.0)) == 0)) & ~((t == "boolean") & (F.lower(v) == "false"))
