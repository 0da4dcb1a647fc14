"""Replies of a model that hold results in one of several shapes, perhaps with words around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.sources.nested import whole_json
from corpusloom.storage import written


def json_part(raw: Column) -> Column:
    """What of a reply is JSON: the inside of its first code fence, if any, from the first bracket or brace on to the last one of its kind."""
    fenced = F.regexp_extract(raw, r"(?s)^.*?```(?:json)?\s*(.*?)```", 1)
    inside = F.transform(F.array(F.when(raw.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(raw)), strip)
    # the first bracket or brace tells the kind; a text without the closing one after it stays as it is
    part = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)^[^\[{]*(\[.*\]|\{.*\})", 1), F.lit("")), t)
    return F.get(F.transform(inside, part), F.lit(0))


def parse_replies(replies: DataFrame, wanted: DataFrame, reply: str, raw: str) -> DataFrame:
    """(reply, id, value) of the wanted results (reply, id) that each reply gives.

    A reply is a list of objects with id and translated, an object whose `items` is such a list, or an object of results by id, each a text or an object with translated or
    text. Identifiers are stripped and lower-cased; blank results are none; of several for one id the last of a list
    counts (of an object's keys that differ in case only, the last by name). Replies that are no JSON give nothing; neither do null results.
    """
    v = whole_json(json_part(F.col(raw)))
    kind = lambda c: F.regexp_extract(F.schema_of_variant(c), "^[A-Z]+", 0)
    parsed = written(replies.select(F.col(reply).alias("reply"), v.alias("v")), "replies").filter("v is not null")  # read more than once
    items = F.try_variant_get("v", "$.items", "variant")
    parsed = parsed.withColumn("items", F.when(kind(F.col("v")) == "ARRAY", F.col("v")).when(kind(items) == "ARRAY", items))
    text = lambda c, path: F.try_variant_get(c, path, "string")
    entries = parsed.filter(F.col("items").isNotNull() | (kind(F.col("v")) == "OBJECT")).select("reply", F.col("items").isNotNull().alias("listed"), F.coalesce("items", "v").alias("v"))
    each = written(entries.lateralJoin(entries.sparkSession.tvf.variant_explode(F.col("v").outer())).drop("v"), "reply-entries")
    listed = each.filter("listed").select("reply", "pos", text("value", "$.id").alias("id"), text("value", "$.translated").alias("text"))
    keyed = each.filter("not listed").select("reply", "pos", F.col("key").alias("id"), F.when(kind(F.col("value")) == "OBJECT", F.coalesce(text("value", "$.translated"), F.when(F.try_variant_get("value", "$.translated", "variant").isNull(), text("value", "$.text")))).otherwise(text("value", "$")).alias("text"))
    found = listed.unionByName(keyed).withColumn("id", F.lower(strip(F.col("id")))).filter(strip(F.coalesce("text", F.lit(""))) != "")
    last = found.groupBy("reply", "id").agg(F.max_by("text", "pos").alias("value"))
    return wanted.select(F.col(reply).alias("reply"), "id").distinct().join(last, ["reply", "id"]).select(F.col("reply").alias(reply), "id", "value")
