"""Which folders of a unit count, and what is wrong with files of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.sources.nested import whole_json


def version_of(path: Column) -> Column:
    """The first whole segment of a path that is a number with a point, as a number (so 1.10 is before 1.9); null without one."""
    return F.regexp_extract(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), r"/(\d+\.\d+)/", 1).try_cast("double")


def latest_folders(rows: DataFrame, unit: str, path: str) -> DataFrame:
    """Of each unit the rows in folders of its greatest version; of units without versions all rows, each path once.

    The greatest version of a unit is a partial maximum that is joined back, so a unit with a third of all rows is no hot task."""
    marked = rows.withColumn("_version", version_of(F.col(path)))
    best = marked.groupBy(F.col(unit).alias("_unit")).agg(F.max("_version").alias("_best"))
    kept = marked.join(best, F.col(unit).eqNullSafe(F.col("_unit"))).filter(F.col("_version").eqNullSafe(F.col("_best")))
    return kept.dropDuplicates([unit, path]).drop("_version", "_unit", "_best")


def file_faults(files: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line, severity, message): JSON files that are no JSON (line null), and lines of settings that are neither blank nor a comment, a head or key and value."""
    broken = files.filter(F.col(file).endswith(".json") & F.col(text).isNotNull()).select(file, whole_json(F.col(text)).isNull().alias("bad")).filter("bad")
    broken = broken.select(file, F.lit(None).cast("int").alias("line"), F.lit("error").alias("severity"), F.lit("JSON parse error").alias("message"))
    lines = files.filter(F.col(file).endswith(".ini") | F.col(file).endswith(".properties")).select(file, F.posexplode(F.split(text, "\r\n|[\n\r]", -1)).alias("line", "raw"))
    lines = lines.select(file, (F.col("line") + 1).alias("line"), strip(F.col("raw")).alias("raw")).filter("raw != '' and not startswith(raw, '#') and not startswith(raw, '[') and not contains(raw, '=') and not contains(raw, ':')")
    suspect = lines.select(file, "line", F.lit("warning").alias("severity"), F.concat(F.lit("Suspect line (no key=value): "), F.substring("raw", 1, 60)).alias("message"))
    return broken.unionByName(suspect)
