"""Table detection over a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import KEY, Config
from ..plans.cascade import detect_tables
from ..sources.identify import identify
from ..sources.registry import read_cells


def detect_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, config: Config = Config(), pattern: str = "*.{xlsx,xlsm,xls,csv,tsv,txt}", **trigger) -> StreamingQuery:
    """Each new file's tables are written to out as Parquet, once: every batch writes a folder of its own number."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def write(batch, number: int) -> None:
        known = identify(batch.select("path", "length", "content")).where("is_supported")
        cells = read_cells(known)
        sheets = cells.select(*KEY).distinct().join(known.selectExpr("path as file_id", "file_type"), "file_id")
        detect_tables(cells, sheets, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
