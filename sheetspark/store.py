"""Tables between steps: written as Parquet to the folder that all executors share, so plans stay short and nothing is lost with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and all runs in one place."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sheetspark.work.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sheetspark-")
        spark.conf.set("spark.sheetspark.work.dir", found)
    return found.rstrip("/")


def keep_buckets(df: DataFrame, by: list[str], dealt: bool = False) -> DataFrame:
    """df written in buckets by the columns and read back, so that joins and sums on them move none of its rows. dealt: it lies by them already."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sheetspark_{uuid.uuid4().hex}"
    out = df if dealt else df.repartition(n, *by)
    out.write.format("parquet").bucketBy(n, *by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay
    return found


def keep(df: DataFrame) -> DataFrame:
    """df written and read back."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
