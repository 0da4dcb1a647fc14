"""Results written back into the texts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_back(files: DataFrame, file: str, text: str, memory: DataFrame, identify) -> DataFrame:
    """(file, text, written): every line whose recomputed identifier the memory (id, original, translated) has is replaced.

    A replacement counts only where the memory's original is the line itself, so two lines of one identifier can't be mixed up.
    Lines meet the memory by identifier and come together again per file; a null text stays null.
    """
    lines = files.filter(F.col(text).isNotNull()).select(file, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    found = lines.withColumn("id", identify(F.col("line"))).join(memory.select("id", "original", "translated"), "id", "left")
    hit: Column = F.col("original").eqNullSafe(F.col("line")) & F.col("translated").isNotNull()
    # two originals under one identifier give a line two rows: the one that hits, if any, stays
    best = found.groupBy(file, "pos").agg(F.max(F.struct(hit.cast("int").alias("hit"), F.when(hit, F.col("translated")).otherwise(F.col("line")).alias("line"))).alias("r"))
    whole = best.groupBy(file).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("r.line").alias("line")))).alias("all"), F.sum("r.hit").alias("written"))
    out = whole.select(file, F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias(text), "written")
    return out.unionByName(files.filter(F.col(text).isNull()).select(file, F.lit(None).cast("string").alias(text), F.lit(0).cast("bigint").alias("written")))
