"""Cutting lineage with a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table, deleted when the driver ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_written() -> None:
    for spark, path in _written:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue


atexit.register(_delete_written)


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        written(spark.range(1))
        folder = spark.conf.get("spark.checkpoint.dir")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path
