"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and everything runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("corpusloom.shared.folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("corpusloom.shared.folder", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its rows stay as they are, and its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, parent: str, prefix: str) -> list[int]:
    """Numbers n, ascending, of the folders parent/<prefix>n that were written to their end."""
    p, files = _folder(spark, parent)
    if not files.exists(p):
        return []
    found = [x.getPath() for x in files.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith(prefix)]
    return sorted(int(x.getName()[len(prefix) :]) for x in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def removed(spark: SparkSession, path: str) -> None:
    p, files = _folder(spark, path)
    files.delete(p, True)


def is_file(spark: SparkSession, path: str) -> bool:
    p, files = _folder(spark, path)
    return files.exists(p) and files.getFileStatus(p).isFile()
