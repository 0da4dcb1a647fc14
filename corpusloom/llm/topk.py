"""Exact top-k by inner product with the no-random-access algorithm over sorted lists, in blocks.

Vectors are turned into integers, floor(scale * x), and dealt into blocks by a hash of their identifiers; queries likewise. Each
pair of a query block and a vector block is one row. In a vector block every dimension has a sorted list of its values. For a
query the lists are read in step from the end that is best for the sign of the query's component, `step` entries at a time.
A vector's lower bound takes the worst value of each list not yet read for it, its upper bound the value the list has
reached. When only vectors whose upper bound reaches the k-th lower bound could still count, and reading on would not pay
(at most `few` of them, or the lists' end), their scores are resolved. Ties go to the smaller identifier, so vectors whose
bound equals the k-th are kept. The best k of each block are ranked once more per query.

Defined results: vectors that are null, or hold null or non-finite components, take no part as queries or candidates; vectors
of a length other than the queries' take no part for them; a query's own identifier never is a candidate; repeated rows are candidates
each; queries that share an identifier are asked one by one if their vectors differ, and once if these are equal too; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

BLOCK_ROWS = 4096
QUERY_ROWS = 512


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


class Lists:
    """The sorted lists of a block: ranks of each value in its dimension, from above and from below."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, m = ids, x, len(ids)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.from_below = np.empty(x.shape, np.int32)
        np.put_along_axis(self.from_below, order, np.arange(m, dtype=np.int32)[:, None], axis=0)
        self.from_above = m - 1 - self.from_below

    def exact_type(self, queries: np.ndarray) -> type:
        """float32 where every bound is an integer that it holds exactly, else float64."""
        most = 4 * self.x.shape[1] * int(np.abs(self.x).max()) * int(np.abs(queries).max())
        return np.float32 if most < 1 << 24 else np.float64

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, few: int, step: int):
        """(place of the query, identifier, score) of each query's k best but own; all queries read their lists in step, so bounds are matrix products."""
        kind, m = self.exact_type(queries), len(self.ids)
        lowest, highest = self.sorted[0], self.sorted[-1]
        over, under = (self.x - lowest).astype(kind), (self.x - highest).astype(kind)
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        worst = (up @ lowest.astype(kind) + down @ highest.astype(kind))[None, :]
        going, depth, out = np.arange(len(queries)), 0, []
        while len(going):
            depth = min(depth + step, m)
            above, below = self.from_above < depth, self.from_below < depth
            u, d = up[going].T, down[going].T
            lower = (over * above) @ u
            lower += (under * below) @ d
            lower += worst[:, going]
            # what unread lists can still add: no more than the value that each has reached
            upper = (~above).astype(kind) @ (u * (self.sorted[m - depth] - lowest).astype(kind)[:, None])
            upper += (~below).astype(kind) @ (d * (self.sorted[depth - 1] - highest).astype(kind)[:, None])
            upper += lower
            row, column = np.nonzero(self.ids[:, None] == own[going][None, :])
            lower[row, column] = upper[row, column] = -np.inf
            bar = np.partition(lower, m - min(k, m), axis=0)[m - min(k, m)]
            left = (upper >= bar[None, :]) & (upper > -np.inf)
            done = np.ones(len(going), bool) if depth == m else left.sum(axis=0) <= few
            for j in np.flatnonzero(done):
                rows = np.flatnonzero(left[:, j])
                scores = self.x[rows] @ queries[going[j]]
                order = np.lexsort((self.ids[rows], -scores))[:k]
                out.append((np.full(len(order), going[j]), self.ids[rows][order], scores[order]))
            going = going[~done]
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _packed(table: pa.Table) -> pa.Table:
    """One block as one row: identifiers and components as bytes, in order of identifiers."""
    ids = table.column("vec_id").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    return pa.table([table.column("block")[:1], table.column("width")[:1], pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([x[order].astype("<i8").tobytes()], pa.binary())], names=["block", "width", "ids", "x"])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of about size rows by a hash of identifier and vector, so that one identifier's vectors spread too."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int")).withColumn("width", F.size("x"))
    return stored(keyed.groupBy("block", "width").applyInArrow(_packed, "block int, width int, ids binary, x binary"), "vector-blocks")


def _search(k: int, few: int, parts: int):
    def run(batches):
        for batch in batches:
            get = lambda name, r: batch.column(batch.schema.get_field_index(name))[r]
            for r in range(batch.num_rows):
                width = get("width", r).as_py()
                read = lambda name: np.frombuffer(get(name, r).as_buffer(), "<i8")  # noqa: E731, B023
                lists = Lists(read("ids"), read("x").reshape(-1, width))
                own = read("query_ids")
                at, ids, scores = lists.best(read("q").reshape(-1, width), own, k, few, max(1, len(lists.ids) // parts))
                asked = (get("query_block", r).as_py() << 32) + at
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (asked, np.full(len(at), width), own[at], ids, scores)], names=["asked", "width", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, few: int = 64, parts: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row where is_query holds."""
    rows = vectors.filter(valid(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("x"), is_query.alias("is_query"))
    lists = _blocks(rows.select("vec_id", "x"), BLOCK_ROWS)
    asked = _blocks(rows.filter("is_query").dropDuplicates(["vec_id", "x"]).select("vec_id", "x"), QUERY_ROWS)
    # every block meets every query block: both are dealt out by the pair, and joined by a merge at every size, as a broadcast would hold the
    # queries once for each block in the driver
    last = lambda df: df.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    blocks, query_blocks = last(lists), last(asked)
    asked = asked.select("width", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("x").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block"))
    lists = lists.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks))))
    pairs = lists.join(asked.hint("merge"), ["block", "query_block", "width"])
    near = pairs.mapInArrow(_search(k, few, parts), "asked long, width long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked", "width").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.x, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
      from (select distinct * from v where vec_id % 50 = 0) q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x)),
r as (select *, cast(row_number() over (partition by query_id, x order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
