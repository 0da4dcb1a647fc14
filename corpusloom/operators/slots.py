"""Write-back into tables of shared values: one value (slot) may serve many keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.numbering import dense_numbers


def copy_on_write(slots: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots: file, slot, value; keys: file, key, slot) after new values are written.

    slots: file, slot (from 0 without gaps is usual, not needed), value. keys: file, key, pos, slot, fresh (null: keep). If all keys of a slot want
    the same fresh value it is changed in place. Else the keys that want one move to new slots, one for each distinct value of a file, numbered
    after the file's last slot in the order in which the keys first ask for them; the others keep the old slot. Keys whose
    slot isn't there are treated alike. Positions order the keys of a file and must differ.
    """
    # sums of a slot combine before the shuffle, so a slot that a third of all keys share is no hot task
    users = keys.groupBy("file", "slot").agg(F.count_if(F.col("fresh").isNull()).alias("keepers"), F.min("fresh").alias("least"), F.max("fresh").alias("most"))
    in_place = (F.col("keepers") == 0) & (F.col("least") == F.col("most"))
    users = users.filter("least is not null").select("file", "slot", in_place.alias("in_place"), F.when(in_place, F.col("least")).alias("changed"))
    joined = keys.join(users, ["file", "slot"], "left")
    moving = joined.filter("fresh is not null and not in_place")
    wanted = moving.groupBy("file", "fresh").agg(F.min("pos").alias("pos"))
    numbered = dense_numbers(wanted, ["file", "pos"], "number")
    firsts = numbered.groupBy("file").agg(F.min("number").alias("first"))
    base = slots.groupBy("file").agg((F.max("slot") + 1).alias("base"))
    added = numbered.join(firsts, "file").join(base, "file", "left").select("file", F.col("fresh").alias("value"), (F.coalesce("base", F.lit(0)) + F.col("number") - F.col("first")).alias("new_slot"))
    moved = joined.join(added.withColumnRenamed("value", "fresh"), ["file", "fresh"], "left")
    out_keys = moved.select("file", "key", F.when(F.col("fresh").isNotNull() & ~F.coalesce("in_place", F.lit(False)), F.col("new_slot")).otherwise(F.col("slot")).alias("slot"))
    out_slots = slots.join(users.select("file", "slot", "changed"), ["file", "slot"], "left").select("file", "slot", F.coalesce("changed", "value").alias("value"))
    return out_slots.unionByName(added.select("file", F.col("new_slot").alias("slot"), "value")), out_keys
