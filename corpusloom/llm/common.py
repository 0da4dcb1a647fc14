"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("corpusloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("corpusloom.shared.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def stored_in_buckets(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """As stored(), with the rows in buckets by key: a join on key moves only the other side."""
    spark, unique = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/corpusloom/{unique}").saveAsTable(unique)
    return spark.table(unique)


def discard(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; a null identifier counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def slices(text: pa.Array, max_bytes: int):
    """(first, last, bytes, offsets) for runs of rows with about max_bytes of text; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(text))
        lo, hi = offsets[first], offsets[last]
        yield first, last, data[lo:hi], offsets[first : last + 1] - lo
        first = last


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive runs of counts items of flat (1-D of any type, or 2-D bytes)."""
    width = flat.dtype.itemsize * (flat.shape[1] if flat.ndim == 2 else 1)
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * width, out=ends[1:])
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def pack5(x: np.ndarray, width: int = 5) -> np.ndarray:
    """The low bytes of unsigned 64-bit values, as rows of width bytes."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def unpack5(raw, width: int = 5) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.view("<u8").reshape(-1)
