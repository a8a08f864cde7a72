"""Text files to cells: csv, tsv and txt, each file parsed by one task, columns typed with DataFrame functions after."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.typing import infer_text
from ..model import FAULT, complete

#: Rows of a text file that are read, as a sheet has them; a file with more has an error row too.
MAX_ROWS = 1_000_001
RAW = "file_id string, sheet_name string, file_type string, r int, c int, raw string"


def _weight(kinds: Counter, rows: int, mean: float) -> float:
    """What a field of a line counts for, by how even the lines are: widths (fields of a line) and how many lines have each."""
    if len(kinds) == 1:
        return 0.1
    if len(kinds) > 5:
        return 1 / (mean * rows) if mean >= 10 else 0.0
    if mean >= 5:
        wide = sum(lines for width, lines in kinds.items() if width >= 10)
        return 0.096 if 2 * wide >= rows else 0.08
    common = max(kinds.values()) / rows
    return 0.1 if common >= 0.6 else 0.1 * common


def score_text_delimiter(lines: list[str], delimiter: str) -> float:
    """How well a delimiter makes columns of lines: their fields, weighed by evenness; 1.5 is enough for a table."""
    widths = (len(x.split(None if delimiter == " " else delimiter)) for x in lines)
    kinds = Counter(n for n in widths if n > 1)
    rows, fields = kinds.total(), sum(n * k for n, k in kinds.items())
    return fields * _weight(kinds, rows, fields / rows) if rows > 1 else 0.0


def pick_text_delimiter(text: str) -> str | None:
    lines = [x[:2000].strip() for x in text.splitlines() if x.strip()][:15]
    scored = [(score_text_delimiter(lines, d), -i, d) for i, d in enumerate(("\t", ",", "|", ";", " "))]
    best = max(scored)
    return best[2] if best[0] >= 1.5 else None


def pick_csv_dialect(sample: str, fallback: str):
    """The sniffer's dialect, else a delimiter by counts of the first ten lines."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|")
    except csv.Error:
        pass
    lines = [x for x in sample.splitlines()[:10] if x.strip()]
    best, most = fallback, 0
    for d in (",", ";", "\t", "|", ":"):
        n = lines[0].count(d) if lines else 0
        score = sum(x.count(d) == n for x in lines) * n
        if n and score > most:
            best, most = d, score
    return best


def decode(data: bytes, encoding: str | None) -> str:
    for name in (encoding, "utf-8", "latin-1"):
        if name:
            try:
                return data.decode(name).removeprefix("﻿")
            except (UnicodeDecodeError, LookupError):
                continue
    return data.decode("latin-1")


def rows_of(data: bytes, kind: str, encoding: str | None) -> Iterator[list[str]]:
    text = decode(data, encoding)
    if kind == "txt":
        delimiter = pick_text_delimiter(text)
        lines = [x for x in text.splitlines() if x.strip()]
        for line in lines if delimiter else ():
            yield re.split(r"\s+", line.strip()) if delimiter == " " else next(csv.reader([line], delimiter=delimiter), [])
        return
    dialect = pick_csv_dialect(text[:8192], "\t" if kind == "tsv" else ",")
    source = io.StringIO(text, newline="")
    reader = csv.reader(source, delimiter=dialect) if isinstance(dialect, str) else csv.reader(source, dialect)
    yield from reader


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(1 << 30)
    columns = [x.split()[0] for x in RAW.split(", ")]
    for df in batches:
        for f in df.itertuples(index=False):
            name = re.sub(r"\.[^.]*$", "", f.path.rsplit("/", 1)[-1])
            out: list[tuple] = []
            fault = None
            try:
                for r, row in enumerate(rows_of(f.content, f.file_type, f.encoding)):
                    if r > MAX_ROWS:
                        fault = f"rows from {MAX_ROWS + 2} on are not read"
                        break
                    out += [(f.path, name, f.file_type, r, c, v) for c, v in enumerate(row) if v]
                    if len(out) > 100_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            except csv.Error as e:
                fault = f"text after the rows read is no {f.file_type}: {e}"
            if fault:
                out.append((f.path, name, f.file_type, FAULT, 0, fault))
            if out:
                yield pd.DataFrame(out, columns=columns)


def read_text(files: DataFrame) -> DataFrame:
    """cells of identified text files. csv and tsv fields are typed; txt fields are trimmed strings."""
    return parse_text(files).where(F.col("r") != FAULT)


def parse_text(files: DataFrame) -> DataFrame:
    """The same with rows at FAULT that tell of what could not be read."""
    text = files.where(F.col("file_type").isin("csv", "tsv", "txt"))
    raw = text.select("path", "content", "file_type", "encoding").mapInPandas(_parse, RAW)
    kind = infer_text(F.col("raw"))
    plain = F.col("file_type") == "txt"
    trimmed = F.regexp_replace("raw", r"^\s+|\s+$", "")
    cells = raw.withColumn("k", kind)
    cells = cells.select("file_id", F.lit(0).alias("sheet_idx"), "sheet_name", "r", "c", F.when(plain | (F.col("k.vtype") != "string"), F.when(trimmed != "", trimmed)).otherwise(F.col("raw")).alias("val_str"), F.when(~plain, F.col("k.num")).alias("val_num"), F.when(plain, "string").otherwise(F.col("k.vtype")).alias("vtype"), F.col("raw").alias("fmt_str"))
    return complete(cells.where("val_str is not null").withColumn("vtype", F.when(F.col("r") == FAULT, "error").otherwise(F.col("vtype"))))
