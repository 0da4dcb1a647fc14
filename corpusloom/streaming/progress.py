"""Progress over a stream of event files, each batch counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import is_file
from corpusloom.streaming import live_merge


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events and value sums per hour and type; on a stream, rows up to a day late count."""
    per = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type")
    return per.agg(F.count(F.lit(1)).alias("events"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "cents")


def run_available(spark: SparkSession, path: str, checkpoint: str, compact: int = 8) -> DataFrame:
    """Reads what there is of a Parquet file, or of a folder of them, as a stream. Each batch merges the counts that it changed into a table of versions, which keeps the last
    count of every key and is compacted as it grows; a batch that is repeated changes nothing."""
    table = f"{checkpoint}-counts"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_file(spark, path):  # a stream reads folders
        folder, _, name = path.rpartition("/")
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = reader.parquet(path)
    stream = hourly_counts(rows)
    key, schema = ["hour", "event_type"], stream.schema.add("batch", "long")
    keep = lambda rows, number: live_merge.upsert(rows.withColumn("batch", F.lit(number).cast("long")), number, table, key, ["batch"], compact)
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return live_merge.current(spark, table, schema, key, ["batch"]).drop("batch")
