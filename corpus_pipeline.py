"""A training-data pipeline over the table documents: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each stage's result as Parquet
into the shared folder and reads it again. All but the last stage return the columns of documents. The stages that drop copies
give every row a key of its own first, so rows that share a doc_id, or have none, are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, jaccard_join, packing, pii, quality
from corpusloom.llm.common import stored, table


_ROW = "corpusloom row"


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a written row key, the same whenever it is read."""
    return stored(docs.withColumn(_ROW, F.monotonically_increasing_id()), name)


def _order() -> Column:
    """What decides which row of a group stays: the smallest doc_id, a null one last, then the row key."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(f"`{_ROW}`").alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score under 0.3)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = ("corpusloom score", "corpusloom predicted")
    return quality.scored(docs, model, names=names).filter(F.col(f"`{names[1]}`") == 1).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised texts, the one with the smallest doc_id stays; one row of each text."""
    rows = _keyed(docs, "exact-dedup-rows")
    found = exact_dedup.exact_dedup(rows.select(_order().alias("id"), "text"), id_col="id")
    stay = found.filter("kept").select(F.col("doc_id.row").alias(_ROW))
    return rows.join(stay, _ROW, "left_semi").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of shingle similarity 0.8 connect, the one with the smallest doc_id stays."""
    rows = _keyed(docs, "near-dedup-rows")
    components = jaccard_join.jaccard_components(rows.select(F.col(f"`{_ROW}`").alias("row"), "text"), id_col="row").select(F.col("doc_id").alias(_ROW), "component_id")
    stay = rows.select(F.col(f"`{_ROW}`"), "doc_id").join(components, _ROW).groupBy("component_id").agg(F.min(_order()).alias("first")).select(F.col("first.row").alias(_ROW))
    return rows.join(stay, _ROW, "left_semi").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4,096 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: A trained classifier, boosted trees and a tokenizer have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
