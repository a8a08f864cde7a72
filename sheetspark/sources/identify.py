"""What a file is, from its name and its first bytes. Methods are struct columns; the most confident one wins."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

BUFFER = 8192
EXTENSIONS = {".xlsx": "xlsx", ".xls": "xls", ".xlsm": "xlsm", ".xlsb": "xlsb", ".csv": "csv", ".tsv": "tsv", ".txt": "txt"}
SUPPORTED = ("xlsx", "xls", "xlsm", "csv", "tsv", "txt")
DELIMITERS = ("\t", ",", ";", "|", " ")
#: Members that a workbook archive has.
WORKBOOK_MEMBERS = ("xl/workbook.xml", "xl/sharedStrings.xml", "xl/styles.xml", "[Content_Types].xml", "_rels/.rels")
# Media types of the file types.
MIME_TYPES = {
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    "xlsb": "application/vnd.ms-excel.sheet.binary.macroEnabled.12",
    "xls": "application/vnd.ms-excel",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "txt": "text/plain",
}
#: Detectors by name for libraries that may be at hand: (path, bytes) columns to a struct(file_type, confidence), tried first.
PLUGINS: dict = {}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]*$", 0))


def by_extension(path: Column) -> Column:
    e = extension(path)
    out = F.lit("unknown")
    for suffix, kind in EXTENSIONS.items():
        out = F.when(e == suffix, kind).otherwise(out)
    return out


def magic(content: Column) -> Column:
    """ole, zip, pdf, png or null by the first bytes."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("D0CF11E0A1B11AE1"), "ole").when(h.startswith("504B0304"), "zip").when(h.startswith("25504446"), "pdf").when(h.startswith("89504E47"), "png")


def latin(content: Column, n: int = BUFFER) -> Column:
    """The first bytes as text of one character a byte."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def printable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\n\r]", "")) / F.length(text)


def is_likely_text(text: Column) -> Column:
    """Over 0.8 of it prints; nothing at all is no text."""
    return F.coalesce(F.when(F.length(text) > 0, printable_share(text) > 0.8), F.lit(False))


def counts_of(lines: Column, delimiter: str) -> Column:
    return F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))


def delimiter_score(lines: Column, delimiter: str) -> Column:
    """Even counts of a delimiter over at least two lines score count times lines; up to three different counts score less."""
    used = F.filter(counts_of(lines, delimiter), lambda n: n > 0)
    k, kinds = F.size(used), F.size(F.array_distinct(used))
    mean = F.aggregate(used, F.lit(0).cast("long"), lambda a, n: a + n) / k
    return F.when(k < 2, 0.0).when(kinds == 1, F.get(used, F.lit(0)) * k.cast("double")).when(kinds <= 3, mean * k * (1 - kinds * 0.1)).otherwise(0.0)


def text_lines(text: Column, n: int = 16) -> Column:
    """The first n lines, stripped, without empty ones."""
    return F.filter(F.transform(F.slice(F.split(F.trim(text), "\n"), 1, n), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def best_delimiter(text: Column) -> Column:
    """struct(score, delimiter) of the best one, ties in the order of DELIMITERS."""
    lines = text_lines(text)
    return F.array_max(F.array(*[F.struct(delimiter_score(lines, d).alias("score"), F.lit(-i).alias("o"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)]))


def by_text(text: Column) -> Column:
    """struct(file_type, confidence) by delimiters; null where the text shows no table and is hardly there."""
    b = best_delimiter(text)
    s, d = b["score"], b["delimiter"]
    kind = F.when(d == "\t", "tsv").when(d == " ", "tsv").otherwise("csv")
    top = F.when(d == "\t", F.least(F.lit(0.95), s / 15)).when(d == ",", F.least(F.lit(0.9), s / 20)).when(d == " ", F.least(F.lit(0.8), s / 25)).otherwise(F.least(F.lit(0.85), s / 20))
    filled = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return F.when(s >= 2, F.struct(kind.alias("file_type"), top.alias("confidence"))).when((filled >= 2) & (F.length(text) > 50), F.struct(F.lit("txt").alias("file_type"), F.lit(0.7).alias("confidence")))


@pandas_udf(ArrayType(StringType()))
def zip_members(content: pd.Series) -> pd.Series:
    """Names in a zip archive; null for what is none."""

    def one(data):
        try:
            return zipfile.ZipFile(io.BytesIO(data)).namelist()
        except (zipfile.BadZipFile, OSError, TypeError, ValueError):
            return None

    return content.map(one)


def by_zip(members: Column) -> Column:
    """struct(file_type, confidence) of a workbook archive from its members."""
    n = sum((_has(members, x) for x in WORKBOOK_MEMBERS[1:]), _has(members, WORKBOOK_MEMBERS[0]))
    macro = F.exists(members, lambda m: F.contains(m, F.lit("vbaProject")))
    binary = F.exists(members, lambda m: m.endswith("workbook.bin")) & F.exists(members, lambda m: m.rlike(r"sheet[^/]*\.bin$")) & ~F.exists(members, lambda m: m.rlike(r"sheet[^/]*\.xml$"))
    kind = F.when(macro, "xlsm").when(binary, "xlsb").otherwise("xlsx")
    return F.when(n >= 3, F.struct(kind.alias("file_type"), F.lit(0.95).alias("confidence"))).when(n >= 1, F.struct(F.lit("xlsx").alias("file_type"), F.lit(0.7).alias("confidence")))


def _has(members: Column, name: str) -> Column:
    return F.exists(members, lambda m: m == name).cast("int")


# ---- encodings


def bom(content: Column) -> Column:
    """Encoding that a byte-order mark names; the four-byte marks first."""
    h = F.hex(F.substring(content, 1, 4))
    return F.when(h == "FFFE0000", "utf-32-le").when(h == "0000FEFF", "utf-32-be").when(h.startswith("FFFE"), "utf-16-le").when(h.startswith("FEFF"), "utf-16-be").when(h.startswith("EFBBBF"), "utf-8")


def by_patterns(content: Column) -> Column:
    """struct(encoding, confidence): zeros at odd places, many high bytes, or plain ASCII."""
    h = F.hex(F.substring(content, 1, 100))
    zeros = F.size(F.filter(F.sequence(F.lit(1), F.lit(49)), lambda i: F.substring(h, 4 * i - 1, F.lit(2)) == "00"))
    text = latin(content)
    high = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    pair = lambda e, c: F.struct(F.lit(e).alias("encoding"), F.lit(c).alias("confidence"))
    return F.when(zeros > 10, pair("utf-16-le", 0.8)).when(high > 0.1 * F.length(text), pair("latin-1", 0.6)).when(high == 0, pair("utf-8", 0.7))


FALLBACKS = ("utf-8", "utf-16-le", "utf-16-be", "utf-16", "latin-1", "cp1252", "iso-8859-1", "ascii", "cp437", "cp850", "utf-32-le", "utf-32-be")


@pandas_udf(StringType())
def decodes_as(content: pd.Series) -> pd.Series:
    """The first encoding that decodes the first bytes strictly to text of which over 0.7 prints."""

    def one(data):
        data = (data or b"")[:BUFFER]
        for name in FALLBACKS:
            for cut in range(4):  # the buffer may end inside a character
                try:
                    text = data[: len(data) - cut].decode(name)
                except (UnicodeDecodeError, LookupError):
                    continue
                if not text or sum(c.isprintable() or c.isspace() for c in text) / len(text) > 0.7:
                    return name
                break
        return None

    return content.map(one)


def encoding(content: Column) -> Column:
    """struct(encoding, confidence, method): mark, byte patterns above .7, first encoding that fits, or utf-8."""
    mark, pattern, fit = bom(content), by_patterns(content), decodes_as(content)
    s = lambda e, c, m: F.struct(e.alias("encoding"), c.alias("confidence"), F.lit(m).alias("method"))
    return (
        F.when(mark.isNotNull(), s(mark, F.lit(1.0), "bom"))
        .when(pattern["confidence"] > 0.7, s(pattern["encoding"], pattern["confidence"], "patterns"))
        .when(fit.isNotNull(), s(fit, F.when(fit == "utf-8", 0.6).otherwise(0.5), "fallback"))
        .otherwise(s(F.lit("utf-8"), F.lit(0.1), "fallback"))
    )


# ---- the vote


def identify(files: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """files (path, content, length) with file_type, confidence, method, mime_type, extension_type, format_mismatch, encoding of text types. Texts are judged by their first buffer bytes."""
    c = F.col("content")
    ext = by_extension(F.col("path"))
    f = files.withColumns({"_magic": magic(c), "extension_type": ext})
    f = f.withColumn("_members", F.when(F.col("_magic") == "zip", zip_members(F.when(F.col("_magic") == "zip", c))))
    text = latin(c, buffer)
    byte = F.when(F.col("_magic") == "ole", F.struct(F.lit("xls").alias("file_type"), F.lit(0.9).alias("confidence"))).when(F.col("_magic") == "zip", by_zip(F.col("_members"))).when(F.col("_magic").isNotNull(), F.struct(F.lit("unknown").alias("file_type"), F.lit(0.9).alias("confidence")))
    methods = [(name, make(F.col("path"), c)) for name, make in PLUGINS.items()]
    methods += [("magic_bytes", byte), ("content", F.when(F.col("_magic").isNull() & is_likely_text(text), by_text(text)))]
    methods.append(("extension", F.struct(ext.alias("file_type"), F.when(ext == "unknown", 0.1).otherwise(0.3).alias("confidence"))))
    votes = F.array(*[F.struct(v["confidence"].alias("confidence"), F.lit(-i).alias("o"), v["file_type"].alias("file_type"), F.lit(name).alias("method")) for i, (name, v) in enumerate(methods)])
    best = F.array_max(F.filter(votes, lambda v: v["confidence"].isNotNull()))
    f = f.withColumn("_b", best).withColumns({"file_type": F.col("_b")["file_type"], "confidence": F.col("_b")["confidence"], "method": F.col("_b")["method"]})
    f = f.withColumns({"format_mismatch": F.col("file_type") != F.col("extension_type"), "is_supported": F.col("file_type").isin(*SUPPORTED), "magic_hex": F.lower(F.hex(F.substring(c, 1, 16)))})
    found = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    raw = F.when(F.col("_magic").isin("zip", "ole"), found[F.when(F.col("_magic") == "ole", "xls").otherwise(F.col("file_type"))]).when(F.col("_magic") == "pdf", "application/pdf").when(F.col("_magic") == "png", "image/png")
    plain = F.when(is_likely_text(text), F.when(F.col("file_type").isin("csv", "tsv"), found[F.col("file_type")]).otherwise("text/plain"))
    f = f.withColumn("mime_type", F.coalesce(raw, F.when(F.col("_magic") == "zip", "application/zip"), plain, F.when(c.isNotNull(), "application/octet-stream")))
    return f.withColumn("encoding", F.when(F.col("file_type").isin("csv", "tsv", "txt"), encoding(c)["encoding"])).drop("_magic", "_members", "_b")


def encrypted(content: Column) -> Column:
    """An OLE container that holds an encrypted package: its stream names are in the directory as UTF-16."""
    name = lambda n: "".join(f"{ord(x):02X}00" for x in n)
    h = F.hex(content)
    return (magic(content) == "ole") & (F.contains(h, F.lit(name("EncryptedPackage"))) | F.contains(h, F.lit(name("EncryptionInfo"))))


def read_files(spark, path, recursive: bool = True, patterns: str = "*.{xlsx,xls,xlsm,csv,tsv,txt}", max_mb: float | None = None) -> DataFrame:
    """Files as rows (path, length, content); hidden and lock files are passed over. Files over max_mb have null content, which is never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if patterns:
        r = r.option("pathGlobFilter", patterns)
    shown = ~F.regexp_extract("path", r"[^/]*$", 0).rlike(r"^[.~]")
    found = r.load(path).where(shown)
    df = found.select("path", "length", "modificationTime", "content")
    if max_mb is None:
        return df
    fits = F.col("length") <= int(max_mb * 1024 * 1024)
    return df.where(fits).unionByName(found.where(~fits).select("path", "length", "modificationTime", F.lit(None).cast("binary").alias("content")))
