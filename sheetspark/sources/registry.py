"""Readers by file type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identify import EXTENSIONS, SUPPORTED
from .text import parse_text
from .xls import parse_xls
from .xlsx import parse_workbooks

Reader = Callable[[DataFrame], DataFrame]
_READERS: dict[str, Reader] = {}


class UnsupportedFormatError(ValueError):
    """No reader for the file type."""


def reset() -> None:
    _READERS.clear()
    _READERS.update({"xls": parse_xls, **dict.fromkeys(("xlsx", "xlsm"), parse_workbooks), **dict.fromkeys(("csv", "tsv", "txt"), parse_text)})


def register(file_type: str, reader: Reader) -> None:
    """reader: identified files (path, content, file_type, encoding) of its type to cells, with faults as rows at FAULT if it tells of any."""
    _READERS[file_type] = reader


def unregister(file_type: str) -> None:
    _READERS.pop(file_type, None)


def reader_for(file_type: str) -> Reader:
    if file_type not in _READERS:
        raise UnsupportedFormatError(f"no reader for {file_type!r}; there are readers for {', '.join(sorted(_READERS))}")
    return _READERS[file_type]


def supported_types() -> list[str]:
    return sorted(_READERS)


def reader_info() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for kind, reader in _READERS.items():
        out.setdefault(getattr(reader, "__name__", str(reader)), []).append(kind)
    return out


def is_supported(path: str) -> bool:
    """By the name alone."""
    kind = EXTENSIONS.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "", "unknown")
    return kind in SUPPORTED and kind in _READERS


def read_cells(files: DataFrame, max_sheets: int | None = None) -> DataFrame:
    """cells of all identified files that have a reader, of their first max_sheets sheets."""
    return read_all(files, max_sheets).where(F.col("r") >= 0)


def read_all(files: DataFrame, max_sheets: int | None = None) -> DataFrame:
    """The same with a row at FAULT for each file or sheet that could not be read whole: vtype error, the reason in val_str."""
    by_reader: dict[Reader, list[str]] = {}
    for kind, reader in _READERS.items():
        by_reader.setdefault(reader, []).append(kind)
    out = None
    for reader, kinds in by_reader.items():
        part = reader(files.where(files.file_type.isin(*kinds)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise UnsupportedFormatError("no readers are registered")
    return out if max_sheets is None else out.where(F.col("sheet_idx") < max_sheets)


reset()
