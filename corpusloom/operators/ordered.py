"""Operators that depend on an order that the rows carry: ordinals, carry-forward, gaps, folds, packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.numbering import dense_numbers


def ordinal(partition: list[str], order: list[str]) -> Column:
    """Count so far per key, from 0."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1


def unique_names(base: Column, partition: list[str], order: list[str]) -> Column:
    """base, base_1, base_2, ... in order."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return F.when(n == 0, base).otherwise(F.concat(base, F.lit("_"), n.cast("string")))


def previous_context(text: Column, partition: list[str], order: list[str], most: int = 250, keep: int = 150) -> Column:
    """The text before, long ones shortened."""
    before = F.lag(text).over(Window.partitionBy(*partition).orderBy(*order))
    return F.when(F.length(before) > most, F.concat(F.substring(before, 1, keep), F.lit("..."))).otherwise(before)


def flow_context(rows: DataFrame, file: str, order: str, text: str, speaker: str, reset: Column, most: int = 250, keep: int = 150) -> DataFrame:
    """rows with the text before (long ones shortened) and its speaker, both null where the flow begins anew: at a file's start and at each
    row for which reset holds. The flow's number is the count of resets so far."""
    flow = F.sum(F.coalesce(reset.cast("int"), F.lit(0))).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("flow", flow)
    w = Window.partitionBy(file, "flow").orderBy(order)
    return marked.withColumn("previous", previous_context(F.col(text), [file, "flow"], [order], most, keep)).withColumn("previous_speaker", F.lag(speaker).over(w))


def carry_forward(value: Column, partition: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def window_count(partition: list[str], seconds: int, ts: str = "ts") -> Column:
    """Rows of the key in (t - seconds, t]."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.count(F.lit(1)).over(Window.partitionBy(*partition).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0))


def overlaps(offset: Column, length: Column, partition: list[str]) -> Column:
    """Does an edit begin before the one before it ends?"""
    w = Window.partitionBy(*partition).orderBy(offset, length)
    return F.coalesce(F.lag(offset + length).over(w) > offset, F.lit(False))


def positions(rows: DataFrame, key: str, order: list[str], name: str = "_at") -> DataFrame:
    """rows with their place in their key's order, from 0, and the key's number of rows (_all), without a window over a key's rows."""
    numbered = dense_numbers(rows, [key, *order], "_number")
    firsts = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_all"))
    return numbered.join(firsts, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_number") - F.col("_first")).drop("_key", "_first", "_number")


def ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.4) -> DataFrame:
    """Exponential average per key, the first sample as the start.

    A sample's weight follows from its place in its key's order and the key's number of samples, so averages are sums, which combine before they are shuffled.
    """
    placed = positions(rows.select(key, *order, F.col(value).alias("_v")), key, order)
    weight = F.pow(F.lit(1 - alpha), F.col("_all") - 1 - F.col("_at")) * F.when(F.col("_at") == 0, 1.0).otherwise(alpha)
    return placed.groupBy(key).agg(F.sum(F.col("_v") * weight).alias("ema"), F.count(F.lit(1)).alias("samples"))


def _ends(costs: np.ndarray, budget: int, most: int) -> np.ndarray:
    """Where the batch that begins at each item ends."""
    total = np.concatenate([[0], np.cumsum(costs)])
    at = np.arange(len(costs))
    return np.clip(np.searchsorted(total, total[:-1] + budget, side="right") - 1, at + 1, np.minimum(at + most, len(costs)))


def greedy_batches(rows: DataFrame, key: str, order: str, cost: str, budget: int, most: int, block: int = 10_000) -> DataFrame:
    """(key, order, batch): batches in order, closed when full or when the next item would pass the budget; never empty. Costs aren't negative.

    A key's items are cut into blocks, which know the first items of the next one. A batch holds at most `most` items, so a block can only be
    entered at one of its first `most` items: for each of these it tells where the next block is entered then and how many batches that
    makes. These small maps are chained per key, and every block, told where it is entered, numbers its own batches. So one
    key's items span as many tasks as it has blocks.
    """
    kinds, block = dict(rows.dtypes), max(block, most)
    placed = positions(rows.select(key, order, F.col(cost).alias("cost")), key, [order])
    placed = placed.withColumn("_block", F.floor(F.col("_at") / block)).drop("_all")
    early = placed.filter((F.col("_block") > 0) & (F.col("_at") % block < most - 1)).withColumn("_block", F.col("_block") - 1)
    items = placed.unionByName(early)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        own = int((pdf["_at"] // block == pdf["_block"]).sum())
        ends = _ends(pdf["cost"].to_numpy(), budget, most).tolist()
        exits, batches = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            e = ends[i]
            exits[i], batches[i] = (e - own, 1) if e >= own else (exits[e], batches[e] + 1)
        return pd.DataFrame({key: pdf[key].iloc[:1], "_block": pdf["_block"].iloc[:1], "exits": [exits[:most]], "batches": [batches[:most]]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        entry, batch, out = 0, 0, []
        for exits, batches in zip(pdf["exits"], pdf["batches"]):
            out.append((entry, batch))
            entry, batch = (exits[entry], batch + batches[entry]) if entry < len(exits) else (entry - len(exits), batch)
        return pdf.assign(_entry=[e for e, _ in out], _batch=[b for _, b in out])[[key, "_block", "_entry", "_batch"]]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        ends, i, batch = _ends(pdf["cost"].to_numpy(), budget, most), int(pdf["_entry"].iloc[0]), int(pdf["_batch"].iloc[0])
        number = np.full(len(pdf), batch - 1)  # what stands before the entry belongs to the batch that came in
        while i < len(pdf):
            number[i : ends[i]] = batch
            i, batch = int(ends[i]), batch + 1
        own = (pdf["_at"] // block == pdf["_block"]).to_numpy()
        return pdf.assign(batch=number)[own][[key, order, "batch"]]

    found = items.groupBy(key, "_block").applyInPandas(maps, f"{key} {kinds[key]}, _block bigint, exits array<bigint>, batches array<bigint>")
    entries = found.groupBy(key).applyInPandas(chain, f"{key} {kinds[key]}, _block bigint, _entry bigint, _batch bigint")
    entries = entries.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), "_entry", "_batch")
    told = items.join(entries, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    return told.drop("_key", "_b").groupBy(key, "_block").applyInPandas(assign, f"{key} {kinds[key]}, {order} {kinds[order]}, batch bigint")


def siblings(rows: DataFrame, block: str, order: str, text: str, most: int = 15, room: int = 800, least: int = 10) -> DataFrame:
    """(block, text, siblings): for each different string of a block its other strings in order, as many as fit.

    At most `most` strings, of which each takes its length and 2; the list ends before the first that would pass `room`. Strings without a blank
    or of `least` characters or less get no list (null). A string that stands several times counts at its first place. A list can only hold
    the block's first most + 1 strings, so these alone come together, with their running sums; a string is left out of its own list by
    taking its cost back.
    """
    first = rows.filter(F.col(text).isNotNull()).groupBy(F.col(block).alias("block"), F.col(text).alias("text")).agg(F.min(order).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("at", "text"))).filter(F.col("n") <= most + 1)
    heads = ranked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("n", F.col("text").alias("s")))).alias("head"))
    heads = heads.withColumn("head", F.transform("head", lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), F.aggregate(F.filter("head", lambda y: y["n"] <= x["n"]), F.lit(0), lambda a, y: a + F.length(y["s"]) + 2).alias("sum"))))
    heads = heads.withColumnRenamed("block", "_block")
    joined = first.join(heads, F.col("block").eqNullSafe(F.col("_block")))
    own = F.coalesce(F.get(F.filter("head", lambda x: x["s"] == F.col("text")), F.lit(0))["n"], F.lit(most + 2))
    joined = joined.withColumn("own", own)
    before = lambda x: F.col("own") < x["n"]
    fits = lambda x: (x["s"] != F.col("text")) & (x["n"] - F.when(before(x), 1).otherwise(0) <= most) & (x["sum"] - F.when(before(x), F.length("text") + 2).otherwise(0) <= room)
    listed = F.transform(F.filter("head", fits), lambda x: x["s"])
    return joined.select(F.col("block").alias(block), F.col("text").alias(text), F.when(F.col("text").contains(" ") & (F.length("text") > least), listed).alias("siblings"))


def rank_among(free: Column, partition: list[str], order: list[str]) -> Column:
    """How many rows before this one are free."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(free.cast("bigint")).over(w), F.lit(0))


def engage(rank: Column, remaining: Column, average: Column) -> Column:
    """Is the worker of this rank still needed for what remains, at the average batch?"""
    return rank < F.greatest(F.lit(1), F.ceil(remaining / average))
