"""Progress, risk and integrity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_progress(rows: DataFrame, unit: str, done: Column) -> DataFrame:
    """Totals, done and percent (half up) of each unit, with the tier that lists show first."""
    out = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("translated"))
    percent = F.when(F.col("total") > 0, F.floor(F.col("translated") * 100 / F.col("total") + 0.5)).otherwise(0).cast("bigint")
    tier = F.when(F.col("total") == 0, 2).when(F.col("translated") == F.col("total"), 1).otherwise(0)
    return out.select(F.col(unit).alias("unit"), "total", "translated", percent.alias("percent"), tier.cast("int").alias("tier"))


def key_progress(rows: DataFrame, keys: list[str], done: Column) -> DataFrame:
    """Distinct keys: all, with at least one open row, and the rest."""
    per = rows.groupBy(*keys).agg(F.bool_or(~done).alias("open"))
    return per.agg(F.count(F.lit(1)).alias("total"), F.count_if("open").alias("todo")).withColumn("done", F.col("total") - F.col("todo"))


def risk_report(rows: DataFrame, unit: str, text: str, pos: str, long_chars: int = 3000) -> DataFrame:
    """Lines, long lines, the longest line (the first of equals) and a verdict for each unit."""
    n = F.length(text)
    out = rows.groupBy(F.col(unit).alias("unit")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(n >= long_chars).alias("long_lines"), F.max(n).cast("bigint").alias("longest"), F.substring(F.max_by(text, F.struct(n, -F.col(pos))), 1, 120).alias("sample"))
    verdict = F.when(F.col("lines") == 0, "none").when(F.col("long_lines") * 4 > F.col("lines"), "high").when(F.col("long_lines") > 0, "low").otherwise("none")
    return out.withColumn("verdict", verdict)


def fingerprint(rows: DataFrame, unit: str, line: Column) -> DataFrame:
    """SHA-256 over each unit's sorted lines."""
    lists = rows.groupBy(F.col(unit).alias("unit")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lists.select("unit", F.sha2(F.array_join("lines", "\n"), 256).alias("fingerprint"))


def small_files(rows: DataFrame, file: list[str], few: int = 5, least: int = 8, share: float = 0.7) -> DataFrame:
    """Should small files be put together?"""
    per = rows.groupBy(*file).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("n") < few).alias("small"))
    return out.withColumn("together", (F.col("small") >= least) & (F.col("small") >= F.col("files") * share))


def slot_users(rows: DataFrame, slot: str, value: Column) -> DataFrame:
    """Distinct values and rows without one for each slot."""
    return rows.groupBy(F.col(slot).alias("slot")).agg(F.countDistinct(value).alias("versions"), F.count_if(value.isNull()).alias("keepers"))


def shrink_factor(ratio: Column) -> Column:
    """What a text that is ratio times as wide as its box is scaled by; null if it fits."""
    # Tolerance and least scale.
    return F.when(ratio > 1.03, F.greatest(F.lit(0.6), F.lit(1.0) / ratio * 1.03))


def block_digest(rows: DataFrame, block: str, pos: str, code: str) -> DataFrame:
    """First 8 digits of the MD5 over a block's lines, each with its line end."""
    lists = rows.groupBy(F.col(block).alias("block")).agg(F.sort_array(F.collect_list(F.struct(pos, F.coalesce(code, F.lit("")).alias("c")))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: F.concat(x["c"], F.lit("\r\n"))), "")
    return lists.select("block", F.substring(F.md5(joined), 1, 8).alias("digest"))
