"""Queries of streams merged into tables, work in rounds, replies and styles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import replies, requeue, styles
from corpusloom.registry import query, table
from corpusloom.storage import shared_folder
from corpusloom.streaming import live_merge


@query("select user_id, event_type, max(ts) as ts, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as value from events group by user_id, event_type")
def live_merge_events(spark, sf_dir):
    """Events that come file by file in no order, merged to the last one of each user and type."""
    place = f"{shared_folder(spark)}/corpusloom/merge-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    events.repartition(6).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    return live_merge.merged(stream, f"{place}/table", f"{place}/checkpoint", ["user_id", "event_type"], ["ts", "event_id"], compact=3)


_ROUND = "case when {d} % 4 = 3 and {r} > 0 then false else ({d} * 7 + {r} * 13) % 11 < 4 end"


@query(f"""select doc_id, case {" ".join(f"when {_ROUND.format(d='doc_id', r=r)} then {r + 1}" for r in range(3))} when doc_id % 2 = 0 then 4 else 4 end::bigint as attempts,
case {" ".join(f"when {_ROUND.format(d='doc_id', r=r)} then 'round ' || {r} || ' ' || md5(coalesce(text, ''))" for r in range(3))} when doc_id % 2 = 0 then 'sweep ' || md5(coalesce(text, '')) end as value from documents""")
def requeue_rounds(spark, sf_dir):
    """A fourth of the documents belong to a worker that answers in the first round only; a sweep takes up half of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))

    def attempt(pending, number, final):
        good = F.col("doc_id") % 2 == 0 if final else F.expr(_ROUND.format(d="doc_id", r=number))
        return pending.filter(good).select("doc_id", F.concat(F.lit("sweep " if final else f"round {number} "), "digest").alias("value"))

    done, left = requeue.in_rounds(docs, "doc_id", attempt, 3)
    return done.select("doc_id", "attempts", "value").unionByName(left.select("doc_id", "attempts", F.lit(None).cast("string").alias("value")))


# A reply about each document, in eight shapes: a fenced list, items with prose around, by id, by id with objects, blank and foreign ones, broken ones.
_REPLY = """case doc_id % 8 when 0 then 'Sure:' || chr(10) || '```json' || chr(10) || '[{"id": " D' || doc_id || ' ", "translated": "' || m || '"}, {"id": "other", "translated": "x"}]' || chr(10) || '```'
when 1 then 'Here it is: {"items": [{"id": "d' || doc_id || '", "translated": "early"}, {"id": "d' || doc_id || '", "translated": "' || m || '"}, {"id": 5}, "odd"]} and that is all'
when 2 then '{"D' || doc_id || '": "' || m || '", "x": {"text": "y"}}' when 3 then '{"d' || doc_id || '": {"text": "' || m || '"}}' when 4 then '{"d' || doc_id || '": {"translated": "' || m || '", "text": "no"}}'
when 5 then '[{"id": "d' || doc_id || '", "translated": "  "}]' when 6 then '{"d' || doc_id || '": 12.5}' else '{"d' || doc_id || '": "' || m end"""


@query(f"""with r as (select doc_id, m, {_REPLY} as raw from (select doc_id, md5(coalesce(text, '')) as m from documents)),
f as (select *, case when contains(raw, '```') then regexp_extract(raw, '```(?:json)?\\s*((?s:.*?))```', 1) else raw end as t from r),
j as (select doc_id, 'd' || doc_id as id, case when starts_with(trim(t), '[') then t else regexp_extract(t, '(?s:\\{{.*\\}})') end as j from f where doc_id % 8 != 7),
o as (select doc_id, id, case when json_type(j) = 'ARRAY' then j::json when json_type(j, '$.items') = 'ARRAY' then json_extract(j, '$.items') end as items, j::json as j from j),
x as (select doc_id, id, unnest(json_extract(items, '$[*]')) as e, unnest(range(json_array_length(items)::bigint)) as pos from o where items is not null),
l as (select doc_id, id, max_by(json_extract_string(e, '$.translated'), pos) as value from x where lower(trim(json_extract_string(e, '$.id'))) = id and trim(coalesce(json_extract_string(e, '$.translated'), '')) != '' group by all),
k as (select doc_id, id, unnest(json_keys(j)) as key, j from o where items is null),
d as (select doc_id, id, case when json_type(json_extract(j, '$."' || key || '"')) = 'OBJECT' then coalesce(json_extract_string(j, '$."' || key || '".translated'), json_extract_string(j, '$."' || key || '".text')) else json_extract_string(j, '$."' || key || '"') end as value from k where lower(trim(key)) = id)
select * from l union all select * from d where trim(coalesce(value, '')) != ''""")
def reply_shapes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    said = docs.select("doc_id", F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("raw"))
    wanted = docs.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"))
    return replies.parse_replies(said, wanted, "doc_id", "raw")


_WIDGETS = """select p_partkey, p_brand as file, p_partkey % 97 as line, case when p_partkey % 5 = 0 then p_size else 0 end as width, case when p_partkey % 7 = 0 then p_size + 1 end as height,
case when p_partkey % 3 = 0 then p_brand when p_partkey % 11 = 0 then 'gone' end as style, case when p_partkey % 4 != 1 then p_type end as prefix from part"""
_STYLES = """select p_brand as style, max(case when p_size % 2 = 0 then p_size end) as width, 0 as height from part group by p_brand
union all select p_type || '_button', 0, min(p_size) from part group by p_type union all select p_type, max(p_size) + 100, max(p_size) + 200 from part where p_type < 'P' group by p_type"""


@query(f"""with w as ({_WIDGETS}), s as (select style, nullif(width, 0) as width, nullif(height, 0) as height from ({_STYLES})),
r as (select w.*, coalesce(nullif(w.width, 0), a.width, b.width, c.width) as bw, coalesce(nullif(w.height, 0), a.height, b.height, c.height) as bh,
  case when nullif(w.width, 0) is not null and nullif(w.height, 0) is not null then case when w.style is not null then a.style else b.style end else coalesce(a.style, b.style, c.style) end as box_style
  from w left join s a on a.style = w.style left join s b on b.style = w.prefix || '_button' left join s c on c.style = w.prefix),
best as (select file, line, max({{'w': bw, 'h': bh, 's': coalesce(box_style, '')}}) as b from r where bw is not null and bh is not null group by all)
select w.p_partkey, b.w::bigint as width, b.h::bigint as height, nullif(b.s, '') as box_style from w left join best on best.file = w.file and best.line = w.line""")
def style_boxes(spark, sf_dir):
    """The size of the largest widget at each part's file and line."""
    table(spark, sf_dir, "part").createOrReplaceTempView("_corpusloom_part")
    widgets, known = (spark.sql(x.replace("from part", "from _corpusloom_part")) for x in (_WIDGETS, _STYLES))
    boxes = styles.resolve_boxes(widgets, known, "p_partkey").join(widgets.select("p_partkey", "file", "line"), "p_partkey")
    out = styles.at_lines(widgets.select("p_partkey", "file", "line"), boxes, "file", "line")
    return out.select("p_partkey", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), "box_style")
