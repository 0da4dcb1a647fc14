"""Consecutive numbers over a whole table in an order, without one window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import written


def dense_numbers(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """rows with a column of consecutive numbers from first on, in the order of the columns given (rows equal in them in any order).

    Rows are dealt to sorted ranges and written with their range's number and their place in it; the counts of the ranges before
    are then added: one row a range goes through one task, the rows themselves never do.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of this identifier count the rows of a partition in order, the others are the partition's number
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftrightunsigned("_id", 33)).withColumn("_place", F.expr("_id & 8589934591"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place") + first).drop("_id", "_range", "_place", "_start")  # one row a partition
