"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ("cell_unpivot", "sheet_bounds", "simple_detect", "cascade_tables", "infer_csv_type", "island_components", "island_scores", "row_groups", "box_tables", "format_boundaries", "semantic_rows", "extract_frame", "delimiter_score", "likely_text")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sheetspark.queries import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()  # the JVM is up before the first clock starts
    times, cells = {}, {}
    for name in HEADLINE:
        began = time.time()
        cells[name] = QUERIES[name](spark, sf_dir).count()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows": cells, "sf": sf_dir.rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
