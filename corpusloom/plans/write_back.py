"""Queries of inheritance, containment, slots and splices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import hierarchy, slots, splice
from corpusloom.registry import query, table

# Orders of a customer are a chain, each with the one before as its parent; every fifth customer's first order has its last one as parent (a cycle),
# every seventh customer's an order that isn't there.
_CHAIN = """(select o_orderkey, case when c % 5 = 0 and up is null then last when c % 7 = 0 and up is null then -o_orderkey else up end as parent,
  case when o_orderstatus = 'P' or o_orderkey % 9 = 0 then o_orderpriority end as priority, case when o_totalprice > 300000 then o_orderdate::date::varchar end as day
  from (select *, o_custkey as c, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as up, max(o_orderkey) over (partition by o_custkey) as last from orders))"""


@query(f"""with recursive chain as {_CHAIN},
walk as (select o_orderkey as start, o_orderkey as node, parent, priority, day, 0 as depth, [o_orderkey] as seen from chain
  union all select w.start, c.o_orderkey, c.parent, c.priority, c.day, w.depth + 1, list_append(w.seen, c.o_orderkey) from walk w join chain c on c.o_orderkey = w.parent where not list_contains(w.seen, c.o_orderkey)),
p as (select start, min_by(priority, depth) as priority, min_by(node, depth) as owner, min(depth) as depth from walk where priority is not null group by start),
k as (select start, min_by(day, depth) as day, min_by(node, depth) as owner, min(depth) as depth from walk where day is not null group by start)
select o_orderkey, p.priority, p.owner as priority_owner, p.depth::bigint as priority_depth, k.day, k.owner as day_owner, k.depth::bigint as day_depth
from orders left join p on p.start = o_orderkey left join k on k.start = o_orderkey""")
def inherit_any_depth(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("up", F.lag("o_orderkey").over(w)).withColumn("last", F.max("o_orderkey").over(Window.partitionBy("o_custkey")))
    parent = F.when((F.col("o_custkey") % 5 == 0) & F.col("up").isNull(), F.col("last")).when((F.col("o_custkey") % 7 == 0) & F.col("up").isNull(), -F.col("o_orderkey")).otherwise(F.col("up"))
    nodes = o.select("o_orderkey", parent.alias("parent"), F.when((F.col("o_orderstatus") == "P") | (F.col("o_orderkey") % 9 == 0), F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_totalprice") > 300000, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return hierarchy.nearest_ancestors(nodes, "o_orderkey", "parent", ["priority", "day"])


@query("""with known as (select distinct regexp_extract(url, '/([0-9]+)$', 1) as p from pages where page_id % 3 = 0 union select distinct regexp_extract(url, '^https?://(.*)/[^/]*$', 1) from pages where page_id % 4 = 1 union select regexp_extract(url, '[^./]+/[a-z]+/[0-9]+') from pages)
select page_id from (select page_id, regexp_replace(url, '^https?://', '') as path from pages) where exists (select 1 from known where p != '' and (path = p or starts_with(path, p || '/') or contains('/' || path || '/', '/' || p || '/')))""")
def pages_within(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    number = pages.filter("page_id % 3 = 0").select(F.regexp_extract("url", "/([0-9]+)$", 1).alias("p"))
    folder = pages.filter("page_id % 4 = 1").select(F.regexp_extract("url", "^https?://(.*)/[^/]*$", 1).alias("p"))
    tail = pages.select(F.regexp_extract("url", "[^./]+/[a-z]+/[0-9]+", 0).alias("p"))  # begins within a segment, so it stands for no path
    rows = pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return hierarchy.within_any(rows, "path", number.union(folder).union(tail).filter("p != ''"), "p").select("page_id")


# Customers by remainder are a file's slots, their orders the keys; the status tells what a key wants written.
_FRESH = "case when o_custkey % 6 = 0 then 'all ' || o_custkey when o_orderstatus = 'P' then o_orderpriority when o_orderstatus = 'F' then case when o_custkey % 4 = 0 then 'same' else 'order ' || o_orderkey % 100 end end"


@query(f"""with keys as (select o_custkey % 40 as file, o_orderkey as key, o_custkey // 40 as slot, {_FRESH} as fresh from orders),
g as (select file, slot, count(*) filter (fresh is null) = 0 and count(distinct fresh) = 1 as in_place, min(fresh) as changed from keys group by all having count(fresh) > 0),
moving as (select k.file, k.key, k.fresh from keys k join g using (file, slot) where k.fresh is not null and not in_place),
wanted as (select file, fresh, min(key) as pos from moving group by all),
added as (select w.file, w.fresh, (select max(slot) from keys k where k.file = w.file) + row_number() over (partition by w.file order by pos) as slot from wanted w)
select k.file, k.key, coalesce(a.slot, k.slot)::bigint as slot, case when a.slot is not null then a.fresh when g.in_place then g.changed else 'slot ' || k.slot end as value
from keys k left join g using (file, slot) left join moving m on m.file = k.file and m.key = k.key left join added a on a.file = m.file and a.fresh = m.fresh""")
def copy_on_write_slots(spark, sf_dir):
    """Every key with the slot it has afterwards and the value that stands there."""
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("file"), F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("pos"), F.expr("o_custkey div 40").alias("slot"), F.expr(_FRESH).alias("fresh"))
    old = keys.select("file", "slot").distinct().withColumn("value", F.concat(F.lit("slot "), F.col("slot").cast("string")))
    after, moved = slots.copy_on_write(old, keys)
    return moved.join(after, ["file", "slot"]).select("file", "key", F.col("slot").cast("bigint").alias("slot"), "value")


# Words of nine letters or more are put into brackets. One edit of every fifth document expects another word, one of every seventh lies
# beyond the end, and one of every eleventh begins within the one before.
@query(r"""with w as (select doc_id, text, string_split(text, ' ') as ws from documents where text is not null),
n as (select doc_id, text, ws, len(list_filter(ws, lambda x: length(x) >= 9)) as hits from w)
select doc_id, hits::bigint as edits, case when hits = 0 then 'no edits' when doc_id % 11 = 0 then 'overlap' when doc_id % 7 = 0 then 'range' when doc_id % 5 = 0 then 'mismatch' else 'applied' end as status,
case when hits = 0 or doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 5 = 0 then length(text) else length(text) + 2 * hits end as chars,
md5(case when hits = 0 or doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 5 = 0 then text else array_to_string(list_transform(ws, lambda x: case when length(x) >= 9 then '[' || x || ']' else x end), ' ') end) as digest,
case when hits = 0 or doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 5 = 0 then null else 2 * (hits - 1) end as last_shift from n""")
def splice_edits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("file"), "text")
    words = docs.select("file", F.posexplode(F.split("text", " ", -1)).alias("seq", "word"))
    before = F.sum(F.length("word") + 1).over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    hits = words.withColumn("offset", F.coalesce(before, F.lit(0))).filter("length(word) >= 9")
    first = F.row_number().over(Window.partitionBy("file").orderBy("seq")) == 1
    hits = hits.withColumn("first", first).select("file", "seq", F.when(F.col("first") & (F.col("file") % 5 == 0), F.concat(F.lit("#"), F.substring("word", 2, 1 << 30))).otherwise(F.col("word")).alias("expected"), F.when(F.col("first") & (F.col("file") % 7 == 0), F.col("offset") + 100_000_000).otherwise(F.col("offset")).alias("offset"), F.concat(F.lit("["), "word", F.lit("]")).alias("fresh"), "first", "word")
    # the one that begins within the first comes beside it, so hits are worked out once
    own = F.struct("seq", "expected", "offset", "fresh")
    within = F.struct((F.col("seq") + 1).alias("seq"), F.substring("word", 2, 1 << 30).alias("expected"), (F.col("offset") + 1).alias("offset"), F.lit("").alias("fresh"))
    edits = hits.select("file", F.explode(F.when(F.col("first") & (F.col("file") % 11 == 0), F.array(own, within)).otherwise(F.array(own))).alias("e")).select("file", "e.*")
    done, report = splice.splice(docs, edits)
    rank = F.when(F.col("status") == "range", 4).when(F.col("status") == "overlap", 3).when(F.col("status") == "mismatch", 2).otherwise(1)
    per = report.groupBy("file").agg(F.count(F.lit(1)).alias("all"), F.max_by("status", rank).alias("status"), F.max(F.when(F.col("status") == "applied", F.col("moved_to") - F.col("offset"))).alias("last_shift"))
    edits = F.coalesce(F.col("all"), F.lit(0)) - F.when((F.col("file") % 11 == 0) & F.col("all").isNotNull(), 1).otherwise(0)
    return done.join(per, "file", "left").select(F.col("file").alias("doc_id"), edits.cast("bigint").alias("edits"), F.coalesce("status", F.lit("no edits")).alias("status"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"), "last_shift")
