"""Snapshots of tables as Parquet, and state files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that a table may be read from; the next append brings them together in one.
MOST_PATHS = 50


def folder(spark: SparkSession) -> str:
    """Where snapshots go: spark.checkpoint.dir, or a temporary folder of a local session without one."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lumenql-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back: later plans read files instead of repeating the change."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{name.lower().replace('.', '_')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lq_paths = [path]
    return out


def appended(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Both, of which only new is written if old is a snapshot or several: its files are read on."""
    paths = getattr(old, "_lq_paths", None)
    if not paths or len(paths) >= MOST_PATHS:
        return snapshot(old.unionByName(new), name)
    out = snapshot(new.select(*old.columns), name)
    paths = [*paths, *out._lq_paths]
    out = old.sparkSession.read.schema(old.schema).parquet(*paths)
    out._lq_paths = paths
    return out
