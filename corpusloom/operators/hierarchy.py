"""Resolution along parent links and containment of paths, as iterated equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import written


def nearest_ancestors(nodes: DataFrame, node: str, parent: str, values: list[str]) -> DataFrame:
    """Every node with, for each of its values, the nearest one on the way up: own, then its parent's, and so on.

    Adds <value>_owner and <value>_depth (0: own). The way ends at a null parent, at a parent that is no node, and where it comes to a node again. Pointer doubling: what
    a node knows of its first 2^k ancestors is joined with what the last of these knows of its own, so a chain of depth d takes log2(d) joins. Only nodes whose way goes on
    are joined: a node is done when it has all values, when its way ends or meets a node that is done, and when both halves of its way have the same least node, as it then
    has gone round a cycle and seen all of it. So the rounds follow the longest way and not the number of nodes. The nearest value wins, so seeing a member of a cycle
    again changes nothing. nodes holds one row a node. Each round is written, as the next reads it twice.
    """
    fact = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("value"), F.col(node).alias("owner"), F.lit(0).cast("bigint").alias("depth")))
    state = written(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.col(node).alias("least"), *[fact(v).alias(v) for v in values]), "ancestors")
    known = state.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    unknown = F.lit(False)
    for v in values:
        unknown = unknown | F.col(v).isNull()
    state = written(state.join(known, "up", "left").withColumn("up", F.when(F.col("there") & unknown, F.col("up"))).drop("there"), "ancestors")
    done, going, reach = state.filter("up is null"), state.filter("up is not null"), 1
    while not going.isEmpty():
        above = done.unionByName(going).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("least").alias("other"), *[F.col(v).alias(f"_{v}") for v in values])
        further = lambda v: F.when(F.col(f"_{v}").isNotNull(), F.struct(F.col(f"_{v}.value").alias("value"), F.col(f"_{v}.owner").alias("owner"), (F.lit(reach) + F.col(f"_{v}.depth")).alias("depth")))  # noqa: B023, E731
        joined = going.join(above, "up").select("node", F.when(~F.col("least").eqNullSafe(F.col("other")), F.col("next")).alias("up"), F.least("least", "other").alias("least"), *[F.coalesce(F.col(v), further(v)).alias(v) for v in values])
        state = written(joined.withColumn("up", F.when(unknown, F.col("up"))), "ancestors")
        done, going, reach = done.unionByName(state.filter("up is null")), state.filter("up is not null"), 2 * reach
    return done.select(F.col("node").alias(node), *[c for v in values for c in (F.col(f"{v}.value").alias(v), F.col(f"{v}.owner").alias(f"{v}_owner"), F.col(f"{v}.depth").alias(f"{v}_depth"))])


def within_any(rows: DataFrame, path: str, known: DataFrame, part: str, separator: str = "/") -> DataFrame:
    """Rows whose path is one of the known paths, lies below one, or holds one as whole consecutive segments.

    Each row's runs of consecutive segments, up to the longest known path's, meet the known paths by an equi-join; a semi join with an or would compare all with all.
    """
    known = known.select(F.col(part).alias("_run")).filter("_run is not null").distinct()
    longest = known.agg(F.coalesce(F.max(F.size(F.split("_run", separator, -1))), F.lit(0))).first()[0]
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    keyed = written(keyed, "paths")
    parts = F.split(F.col(path), separator, -1)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(parts) - i + 1)), lambda n: F.array_join(F.slice(parts, i, n), separator))))
    held = keyed.filter(F.col(path).isNotNull() & F.lit(longest > 0)).select("_row", F.explode(F.array_distinct(runs)).alias("_run")) if longest else keyed.select("_row", F.lit(None).cast("string").alias("_run")).filter("false")
    return keyed.join(held.join(known, "_run", "left_semi").select("_row").distinct(), "_row", "left_semi").drop("_row")
