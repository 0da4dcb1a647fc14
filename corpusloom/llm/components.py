"""Connected components of a graph given by its edges, by contraction; everything stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (columns a, b), label being the same for nodes that are connected.

    Each round every node takes the least of itself and its neighbours as parent (counts combine before the shuffle, so a hub
    costs no more than other nodes), parents are shortened by one jump, and the edges are rewritten between parents. The
    number of edges between different labels shrinks geometrically; rounds end when none is left.
    """
    edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = stored(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "parents")
        if labels is None:
            fresh = stored(parent.select(F.col("u").alias("node"), F.col("p").alias("label")), "labels")
        else:
            moved = labels.join(parent.select(F.col("u").alias("label"), "p"), "label", "left")
            fresh = stored(moved.select("node", F.coalesce("p", "label").alias("label")), "labels")
            discard(labels)
        labels = fresh
        ends = edges.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        ends = ends.filter("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        rest = stored(ends, "edges")
        discard(edges)
        discard(parent)
        edges = rest
    discard(edges)
    if labels is None:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.range(0).select(F.col("id").cast(kind).alias("node"), F.col("id").cast(kind).alias("label"))
    return labels
