"""Upserts of a stream into a table of versions: the row with the greatest order of each key, compacted as it grows.

A batch writes the rows it brings, one a key, under its own number; a batch that is repeated after a failure writes the same folder again. Every
few batches the rows of all deltas since the last base are merged into a new base, so reading costs the base and a bounded number of deltas. A key's row
is the greatest by order, wherever it came from, so batches may come in any order or twice and the table is the same. Only folders
written to their end count; a base is put aside only when the one after it is complete, so readers of the older one go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.storage import finished, removed


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by order, of equal ones by the other columns; columns in the order of rows."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def current(spark: SparkSession, table: str, schema: StructType, key: list[str], order: list[str]) -> DataFrame:
    """The table as it is: the last base and the deltas after it."""
    bases, deltas = finished(spark, table, "base-"), finished(spark, table, "delta-")
    base = bases[-1] if bases else -1
    folders = [f"{table}/base-{base}"] * bool(bases) + [f"{table}/delta-{n}" for n in deltas if n > base]
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return latest(rows, key, order)


def upsert(rows: DataFrame, number: int, table: str, key: list[str], order: list[str], compact: int = 8) -> None:
    """Batch `number` of the table; after every `compact` deltas a new base is written."""
    spark = rows.sparkSession
    latest(rows, key, order).write.mode("overwrite").parquet(f"{table}/delta-{number}")
    bases, deltas = finished(spark, table, "base-"), finished(spark, table, "delta-")
    base = bases[-1] if bases else -1
    if len([n for n in deltas if n > base]) < compact:
        return
    current(spark, table, rows.schema, key, order).write.mode("overwrite").parquet(f"{table}/base-{deltas[-1]}")
    for n in bases[:-1]:
        removed(spark, f"{table}/base-{n}")
    for n in deltas:
        if n <= base:
            removed(spark, f"{table}/delta-{n}")


def merged(stream: DataFrame, table: str, checkpoint: str, key: list[str], order: list[str], compact: int = 8) -> DataFrame:
    """Merges all that a stream has for now, and the table after it."""
    writer = stream.writeStream.foreachBatch(lambda rows, number: upsert(rows, number, table, key, order, compact))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return current(stream.sparkSession, table, stream.schema, key, order)
