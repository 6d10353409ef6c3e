"""Folders that driver and executors share, and tables kept there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FOLDERS: list[tuple[SparkSession, str]] = []
_TABLES: dict[str, str] = {}


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder not used before: below spark.checkpoint.dir, or, where that is unset, on one machine, a
    temporary one. It is removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trackspark-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/trackspark-scratch/{kind}-{uuid.uuid4().hex}")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _FOLDERS.append((spark, folder))
    return folder


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Computes df once and keeps it as a table in the shared folder, so that what reads it more than once
    neither computes it again nor depends on an executor that may be lost. With by the table lies in as many
    buckets of that column as a shuffle has partitions: windows, groups and joins on it take its rows as they
    lie. Rows that lie by it already are not shuffled for that."""
    spark = df.sparkSession
    folder = new_folder(spark, "table")
    if by is None:
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)
    _TABLES[folder] = name = f"trackspark_{uuid.uuid4().hex}"
    # a window asks for rows by the column, if they don't lie so yet; a task then writes its own buckets only
    rows = df.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(by)))
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", folder).format("parquet").saveAsTable(name)
    return spark.table(name).drop("__rows")


@atexit.register
def drop_folders() -> None:
    """Removes the folders made so far."""
    while _FOLDERS:
        spark, folder = _FOLDERS.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            if folder in _TABLES:
                spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(folder)}")
        except Exception:  # noqa: BLE001  the driver's JVM is gone already
            return
