"""From files to tables and frames in a few calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.addr import format_range
from .model import FAULT, KEY, Config
from .operators import extract
from .plans.cascade import detect_tables as detect_cells
from .sources import identify as ident
from .sources.registry import UnsupportedFormatError, read_all
from .sources.xlsx import sheets_of
from .store import keep


def identify(spark: SparkSession, path, config: Config = Config(), **options) -> DataFrame:
    """Files under a path, or a list of paths, with what they are; the rows of one file have its error where it has one."""
    files = ident.identify(ident.read_files(spark, path, max_mb=config.max_file_size_mb, **options), config.file_detection_buffer_size)
    if config.strict_format_checking and (bad := files.where(~F.col("is_supported") & F.col("content").isNotNull()).select("path", "file_type").first()):
        raise UnsupportedFormatError(f"{bad.path}: {bad.file_type} is not supported")
    error = F.when(F.col("length") > int(config.max_file_size_mb * 1024 * 1024), "file too large").when(F.col("length") == 0, "empty file").when(ident.encrypted(F.col("content")), "password protected").when(~F.col("is_supported"), F.concat(F.lit("unsupported type "), "file_type"))
    return files.withColumn("error", error)


def detect_tables(spark: SparkSession, path, config: Config = Config(), **options) -> DataFrame:
    """Tables of all files under path: file_id, sheet_idx, range bounds, confidence, method, headers."""
    read = read_folder(spark, path, config, **options)
    return detect_cells(read.cells, read.sheets, config)


@dataclass(frozen=True)
class Read:
    """What a folder holds: files with their types and errors, cells, sheets with their file's type, and what could not be read (file_id, sheet_idx, error)."""

    files: DataFrame
    cells: DataFrame
    sheets: DataFrame
    errors: DataFrame


def read_folder(spark: SparkSession, path, config: Config = Config(), **options) -> Read:
    """Files are identified once and parsed once; cells and errors are kept."""
    files = identify(spark, path, config, **options)
    known = files.drop("content").transform(keep)
    good = files.where("error is null")
    found = read_all(good, config.max_sheets).transform(keep)
    cells = found.where(F.col("r") != FAULT)
    sheets = cells.select(*KEY).distinct().join(known.select(F.col("path").alias("file_id"), "file_type"), "file_id").transform(keep)
    whole = known.where("error is not null").select(F.col("path").alias("file_id"), F.lit(-1).alias("sheet_idx"), "error")
    return Read(known, cells, sheets, whole.unionByName(found.where(F.col("r") == FAULT).select(*KEY, F.col("val_str").alias("error"))))


def extract_tables(spark: SparkSession, path, config: Config = Config(), **options) -> DataFrame:
    """Long form of every table found under path."""
    read = read_folder(spark, path, config)
    return extract.extract(read.cells, detect_cells(read.cells, read.sheets, config), **options)


def extraction_results(spark: SparkSession, path, config: Config = Config(), **options) -> tuple[DataFrame, DataFrame]:
    """Per table: file, sheet, range, orientation, headers, quality and status; and the long form of those that succeeded."""
    read = read_folder(spark, path, config)
    tables = detect_cells(read.cells, read.sheets, config).transform(keep)
    facts = extract.analyse(read.cells, tables, **options).transform(keep)
    names = extract.headers(read.cells, tables, facts).groupBy(*KEY, "table_id").agg(F.sort_array(F.collect_list(F.struct("col", "header"))).alias("x"))
    names = names.select(*KEY, "table_id", F.transform("x", lambda x: x["header"]).alias("columns"))
    ranged = tables.select(*KEY, "table_id", format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")).alias("range"), "method", F.col("confidence").alias("detection_confidence"))
    results = ranged.join(facts, [*KEY, "table_id"]).join(names, [*KEY, "table_id"], "left")
    return results, extract.extract(read.cells, tables, facts)


def summary(files: DataFrame, tables: DataFrame) -> DataFrame:
    """Per file: type, sheets with errors, number of tables, share of sheets read without error."""
    bad = sheets_of(files).where("error is not null").groupBy("file_id").agg(F.first("error").alias("sheet_error"))
    n = tables.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_tables"), F.count_distinct("sheet_idx").alias("n_sheets_with_tables"))
    out = files.select(F.col("path").alias("file_id"), "file_type", "confidence", "method", "format_mismatch", "encoding", "error").join(n, "file_id", "left").join(bad, "file_id", "left")
    return out.select("file_id", "file_type", "confidence", "method", "format_mismatch", "encoding", F.coalesce("error", "sheet_error").alias("error"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.when(F.coalesce("error", "sheet_error").isNull(), 1.0).otherwise(0.0).alias("success_rate"))


def report(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Per sheet: method used (none without tables), stored cells, density, number of tables, of them large, medium and small, ranges with confidence in order."""
    size = cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sheet_cells"), ((F.max("r") + 1) * (F.max("c") + 1).cast("long")).alias("cell_count"))
    shown = F.format_string("%s %.2f%% %s", format_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")), 100 * F.col("confidence"), F.col("method"))
    n = tables.groupBy(*KEY).agg(F.min_by("method", "seq").alias("method_used"), F.count(F.lit(1)).alias("table_count"), *[F.count_if(F.col("size_class") == x).alias(f"{x}_tables") for x in ("large", "medium", "small")], F.sort_array(F.collect_list(F.struct("seq", shown.alias("t")))).alias("x"))
    out = size.join(n.withColumn("tables", F.transform("x", lambda t: t["t"])).drop("x"), KEY, "left").fillna({"method_used": "none", "table_count": 0, "large_tables": 0, "medium_tables": 0, "small_tables": 0})
    return out.withColumn("sheet_density", F.col("sheet_cells") / F.col("cell_count"))


def write_tables(long: DataFrame, path: str) -> None:
    """Extracted tables as CSV, a folder for each file, sheet and table."""
    long.write.mode("overwrite").partitionBy("file_id", "sheet_idx", "table_id").option("header", True).csv(path)
