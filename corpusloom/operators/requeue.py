"""Work that is tried in rounds until nothing is left or the rounds are used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import written


def in_rounds(items: DataFrame, key: str, attempt: Callable[[DataFrame, int, bool], DataFrame], rounds: int, sweep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results: key, value, attempts; items that have none, with their attempts).

    attempt(pending, number, final) answers some of the pending items as rows (key, value): pending has the columns of items and attempts, the number of tries before.
    Whatever has no answer goes into the next round, ahead of what was never tried (more attempts first). Blank and null values
    and keys that were not asked for are no answers; of several for a key the greatest counts. After the rounds a sweep, if asked for, is one more round in which the caller uses
    what still works. Each round is an anti-join over written tables, so a lost executor repeats no attempt.
    """
    pending = written(items.withColumn("attempts", F.lit(0).cast("bigint")), "pending")
    results = None
    for number in range(rounds + bool(sweep)):
        if pending.isEmpty():
            break
        said = attempt(pending.orderBy(F.desc("attempts")) if number else pending, number, number >= rounds)
        said = said.filter(F.trim(F.coalesce(F.col("value").cast("string"), F.lit(""))) != "").groupBy(key).agg(F.max("value").alias("value"))
        got = written(said.join(pending.select(key, "attempts"), key).select(key, "value", (F.col("attempts") + 1).alias("attempts")), "answers")
        results = got if results is None else results.unionByName(got)
        pending = written(pending.join(got.select(key), key, "left_anti").withColumn("attempts", F.col("attempts") + 1), "pending")
    if results is None:
        results = pending.select(key, F.lit(None).cast("string").alias("value"), "attempts").filter("false")
    return results, pending
