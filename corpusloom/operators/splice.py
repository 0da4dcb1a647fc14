"""Edits at offsets, checked against the text and written into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import written


def splice(files: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files: file, text, applied; edits: file, offset, seq, status, moved_to).

    files: file, text, one row each. edits: file, offset (characters from 0), seq (orders edits of one offset), expected, fresh; nulls in
    either text count as empty. A file's edits are applied together or not at all: each must lie in the text, the text there must be what
    is expected, and none may begin before the one before it ends. status is `applied`, or `overlap`, `range`, `mismatch`
    for the edit that is wrong, or `refused` for the other edits of its file; `no file` where there is none. moved_to is where an applied edit's text begins in the new text:
    its offset and the running sum of all changes of length before it.
    """
    e = edits.select("file", F.col("offset").cast("bigint").alias("offset"), "seq", F.coalesce("expected", F.lit("")).alias("expected"), F.coalesce("fresh", F.lit("")).alias("fresh"))
    lists = e.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "seq", "expected", "fresh"))).alias("es"))  # edits of a file that don't overlap are no longer than its text
    both = lists.join(files.select("file", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("there")), "file", "left")
    # the text is split into characters once for all its edits: t.c holds them, t.n is their number
    once = lambda each: F.expr(f"get(transform(array(struct(split(text, '') as c, length(text) as n)), t -> {each}), 0)")
    judged = once("""transform(es, (x, i) -> case
        when i > 0 and get(es, i - 1).offset + length(get(es, i - 1).expected) > x.offset or i < size(es) - 1 and x.offset + length(x.expected) > get(es, i + 1).offset then 'overlap'
        when x.offset is null or x.offset < 0 or x.offset + length(x.expected) > t.n then 'range'
        when array_join(slice(t.c, cast(x.offset + 1 as int), length(x.expected)), '') != x.expected then 'mismatch'
        else 'applied' end)""")
    both = both.withColumn("states", F.when(F.col("there"), judged).otherwise(F.expr("transform(es, x -> 'no file')"))).withColumn("good", F.expr("forall(states, s -> s = 'applied')"))
    both = written(both, "splices")
    # what lies between the edit before and this one, then the edit's text
    pieces = """transform(es, (x, i) -> concat(array_join(slice(t.c, cast(case when i = 0 then 1 else get(es, i - 1).offset + length(get(es, i - 1).expected) + 1 end as int),
        cast(x.offset - case when i = 0 then 0 else get(es, i - 1).offset + length(get(es, i - 1).expected) end as int)), ''), x.fresh))"""
    tail = "substring(text, cast(element_at(es, -1).offset + length(element_at(es, -1).expected) + 1 as int))"
    edited = both.filter("there and good").select("file", F.concat(F.array_join(once(pieces), ""), F.expr(tail)).alias("edited"))
    out = files.join(edited, "file", "left").select("file", F.coalesce("edited", "text").alias("text"), F.col("edited").isNotNull().alias("applied"))
    each = both.select("file", "good", F.posexplode(F.arrays_zip("es", "states")).alias("i", "z")).select("file", "good", "i", "z.es.*", F.col("z.states").alias("state"))
    shift = F.sum(F.length("fresh") - F.length("expected")).over(Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    status = F.when((F.col("state") == "applied") & ~F.col("good"), "refused").otherwise(F.col("state"))
    report = each.select("file", "offset", "seq", status.alias("status"), F.when(F.col("good"), F.col("offset") + F.coalesce(shift, F.lit(0))).alias("moved_to"))
    return out, report
