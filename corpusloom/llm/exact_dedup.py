"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is normalised, then cut where its own content says so (a cut depends on a few characters before it, so equal
passages are cut alike wherever they stand). Chunks are reduced to their distinct contents under an identifier of two 64-bit hashes,
and the contents themselves are compared to verify that none stands for two; if one did, recipes would carry the contents too.
A document is then the ordered list of its chunks' identifiers, 16 bytes for about a thousand characters, and only these lists are
written, grouped and joined; a list that more than a thousandth of all rows have is dealt over several parts of the join.

Defined results: null texts count as empty, and all empty texts are equal; rows that repeat a doc_id are rows of their own and
share their verdict; a null doc_id never is the one that stays unless its whole group has none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

#: 512 to 4,096 characters, ending where the text has this pattern if it has it there.
CHUNK = r"(?s).{512,4090}?[aeiou0-9\x{e0}-\x{ff}][nrstl][ ][a-fA-F]|.{1,4096}"
#: A recipe with over 1 / HOT of all rows is hot (so at most HOT are); its rows are dealt over SALTS parts.
HOT, SALTS = 1000, 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks_of(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(7), chunk).alias("b"))


def any_collision(chunks: DataFrame, identify) -> bool:
    """Does an identifier stand for several contents? chunks: a column chunk."""
    distinct = chunks.select(identify(F.col("chunk")).alias("h"), "chunk").distinct()
    return not distinct.groupBy("h").count().filter("count > 1").isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify=identifier, pattern: str = CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    collided = any_collision(texts.select(F.explode(chunks_of(F.col("text"), pattern)).alias("chunk")), identify)

    def entry(chunk: Column) -> Column:
        return F.struct(identify(chunk).alias("h"), chunk.alias("content")) if collided else identify(chunk)

    recipes = texts.select("doc_id", F.transform(chunks_of(F.col("text"), pattern), entry).alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    recipes = stored(recipes.withColumn("mark", F.xxhash64("recipe")), "recipes")
    groups = recipes.groupBy("recipe", "mark").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # rows of hot recipes are salted; a mark that two recipes share only salts both
    marks = recipes.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(marks.filter(F.col("n") > F.lit(max(1000, recipes.count() // HOT))).select("mark", F.lit(True).alias("hot")))  # at most HOT rows
    salted = recipes.join(hot, "mark", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0))
    groups = groups.join(hot, "mark", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint")))))
    joined = salted.join(groups.drop("mark", "hot"), ["recipe", "salt"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id is not distinct from min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
"""
