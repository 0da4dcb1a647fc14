"""Queries of lists, contexts, lookups, versions and checks of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import listing, ordered, reconcile
from corpusloom.registry import query, table
from corpusloom.sources import versions

_KEPT = "(doc_id % 97 = 0 or (coalesce(quality, 0) = 0 and doc_id % 5 != 0 and (contains(lower(coalesce(text, '')), 'licen') or contains(lower(source), 'src1') or contains('doc ' || lang, 'licen'))))"


@query(f"""select doc_id, doc_id % 97 = 0 as pinned, length(coalesce(text, ''))::bigint as chars from documents left join labels using (doc_id) where {_KEPT}
order by doc_id % 97 = 0 desc, chars desc, doc_id limit 100 offset (select least(2, greatest(0, (count(*) - 1) // 100)) * 100 from documents left join labels using (doc_id) where {_KEPT})""")
def list_view(spark, sf_dir):
    """The third page of a filtered list (a page is the feature): pinned rows, then by length, then as they were."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise(" ").alias("translated"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("path", F.array(F.when(F.col("doc_id") % 5 == 0, "uscore").otherwise("doc"), F.col("lang")))
    search = listing.by_search("Licen", F.col("text"), F.lit(None).cast("string"), F.col("path")) | listing.by_search("SRC1", F.col("source"), F.lit(""), F.array().cast("array<string>"))
    keep = listing.by_status(F.col("translated"), "untranslated") & listing.by_kind(F.col("path"), "regular") & search
    pinned = table(spark, sf_dir, "documents").filter("doc_id % 97 = 0").select("doc_id")
    rows = rows.withColumn("chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    shown, order = listing.listed(rows, "doc_id", keep, [F.desc("chars"), F.col("doc_id")], pinned)
    return listing.page(shown, order, 2, 100).select("doc_id", "pinned", "chars")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null),
f as (select *, split_part(line, ' ', 1) as who, sum(case when length(line) < 25 then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as flow from l),
p as (select *, lag(line) over w as b, lag(who) over w as previous_speaker from f window w as (partition by doc_id, flow order by pos))
select doc_id, pos, flow::bigint as flow, case when length(b) > 250 then substring(b, 1, 150) || '...' else b end as previous, previous_speaker from p""")
def flow_context(spark, sf_dir):
    """Lines with the one before, as far as no short line, which begins a new flow, lies between."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("who", F.substring_index("line", " ", 1)).withColumn("pos", F.col("pos").cast("bigint"))
    return ordered.flow_context(lines, "doc_id", "pos", "line", "who", F.length("line") < 25).select("doc_id", "pos", "flow", "previous", "previous_speaker")


@query("""select d.doc_id, coalesce(case when l.doc_id is not null and quality = 1 then 'label' end, case when d.doc_id % 3 != 0 then md5(d.text) end, case when d.doc_id % 6 = 0 then d.source end) as value,
case when l.doc_id is not null and quality = 1 then 'project' when d.doc_id % 3 != 0 and d.text is not null then 'cache' when d.doc_id % 6 = 0 then 'model' end as source from documents d left join labels l on l.doc_id = d.doc_id""")
def first_known_value(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    project = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "label").otherwise(" ").alias("value"))
    cache = docs.filter("doc_id % 3 != 0").select("doc_id", F.md5("text").alias("value"))
    model = docs.filter("doc_id % 6 = 0").select("doc_id", F.col("source").alias("value"))
    return reconcile.first_known(docs.select("doc_id"), "doc_id", [("project", project), ("cache", cache), ("model", model)])


@query("""select user_id % 50 as type, lower(event_type) as key, count(*) as made from (select distinct user_id, event_type, props from events) e
where not exists (select 1 from events c where c.value < 5 and c.event_id % 3 = 0 and c.user_id = e.user_id and c.event_type = e.event_type) group by all""")
def not_curated_counts(spark, sf_dir):
    """Distinct rows by unit that no curated row of the same whole key stands against; curated ones are rows of low value."""
    e = table(spark, sf_dir, "events")
    left = reconcile.not_curated(e.select("user_id", "event_type", "props"), e.filter("value < 5 and event_id % 3 = 0"), ["user_id", "event_type"])
    return left.groupBy((F.col("user_id") % 50).alias("type"), F.lower("event_type").alias("key")).agg(F.count(F.lit(1)).alias("made"))


@query("""select conv_id, turn, case when turn % 4 = 0 then 'narrator' when turn % 4 = 3 then 'v' || turn else coalesce(n.name, role) end as speaker from conversations left join (select 'user' as role, min(n_name) as name from nation) n using (role)""")
def line_speakers(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("case when turn % 4 = 0 then null when turn % 4 = 3 then 'v' || turn else role end").alias("who"))
    names = table(spark, sf_dir, "nation").select(F.lit("user").alias("who"), F.col("n_name").alias("name"))
    return reconcile.speakers(lines, names, "who").select("conv_id", "turn", "speaker")


_FOLDER = "split_part({h}, '.', 1) || case page_id % 4 when 0 then '/1.' || (page_id % 12) || '/texts' when 1 then '/0.9/sub/2.0' when 2 then '/common' else '/v1.5x' end"


@query(f"""with p as (select page_id, unit, path, try_cast(regexp_extract('/' || path || '/', '/([0-9]+\\.[0-9]+)/', 1) as double) as v from (select page_id, regexp_extract(url, '//([^/]+)/', 1) as unit, {_FOLDER.format(h="regexp_extract(url, '//([^/]+)/', 1)")} as path from pages)),
b as (select unit, max(v) as best from p group by unit) select distinct p.unit, path from p join b on b.unit = p.unit where v is not distinct from best""")
def latest_versions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("unit", F.regexp_extract("url", "//([^/]+)/", 1))
    return versions.latest_folders(pages.select("unit", F.expr(_FOLDER.format(h="unit")).alias("path")), "unit", "path")


@query(r"""with d as (select doc_id, text from documents where text is not null),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from d where doc_id % 2 = 0)
select 'd' || doc_id || '.ini' as file, pos::int as line, 'warning' as severity, 'Suspect line (no key=value): ' || substring(trim(line), 1, 60) as message from l where trim(line) != '' and not regexp_matches(trim(line), '^[#\[]') and not contains(line, '=') and not contains(line, ':')
union all select 'd' || doc_id || '.json', null, 'error', 'JSON parse error' from d where doc_id % 2 = 1 and doc_id % 3 = 0""")
def file_faults(spark, sf_dir):
    """Documents as settings and as JSON, of which a third is broken."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.to_json(F.struct("text")), F.lit("}"))).otherwise(F.to_json(F.struct("text")))
    even = F.col("doc_id") % 2 == 0
    files = docs.select(F.concat(F.lit("d"), "doc_id", F.when(even, ".ini").otherwise(".json")).alias("file"), F.when(even, F.col("text")).otherwise(made).alias("text"))
    return versions.file_faults(files, "file", "text")
