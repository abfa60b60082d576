"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.readers import dealt_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch: with texts of a few kB a batch is some MB, with the longest ones some tens of MB.
BATCH_ROWS = 512

#: Rows, and compressed bytes, up to which a written table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where it is unset and the master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.scratch_path = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once nothing that is still to run reads them."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows and bytes, as written to the shared folder, allow it."""
    held = df if hasattr(df, "scratch_path") else written(df, "bounded")
    small = _bytes(held.sparkSession, held.scratch_path) <= BROADCAST_BYTES and held.count() <= BROADCAST_ROWS
    return F.broadcast(held) if small else held


def release(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _delete_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue


atexit.register(_delete_written)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt_table(spark, f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def columns(df: DataFrame) -> list:
    """All columns of a table, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """The table with its columns named by number, as functions on Arrow batches take no names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])
