"""All registered queries of the library proper, by name, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ids, predicates, text
from corpusloom.operators import ordered, reconcile, report, sinks
from corpusloom.plans import judged, lists, order, rounds, small, sources, texts, write_back  # noqa: F401  registers its queries
from corpusloom.registry import ORACLES, QUERIES, query  # noqa: F401
from corpusloom.registry import table as _t
from corpusloom.sources import markup
from corpusloom.storage import shared_folder
from corpusloom.streaming import progress

def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


_FNV = "case when {k} = '' then '811c9dc5' else lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({k}, ''), lambda c: unicode(c)::bigint)), lambda h, c: ((xor(h, c) * 16777619) & 4294967295))), 8, '0')) end"
_KEY = "source || chr(0) || lang || chr(0) || doc_id::varchar || chr(0) || text"
_STRIP = r"regexp_replace({c}, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+$', '', 'g')"


def _text_key(c):
    """A text's digest and length: what is shuffled and compared in its place. Null stays null."""
    return F.sha2(c, 256).alias("h"), F.length(c).alias("n")


def _id(df):
    return ids.stable_id(F.col("source"), F.col("lang"), F.array(F.col("doc_id").cast("string")), F.col("text"))


@query(f"select doc_id, {_FNV.format(k='(' + _KEY + ')')} as id from documents where text is not null")
def stable_ids(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null")
    return d.select("doc_id", _id(d).alias("id"))


@query(f"select id, count(*) as texts from (select distinct text, {_FNV.format(k='text')} as id from documents where text is not null) group by id having count(*) > 1")
def id_collisions(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null").select("text").distinct().select(ids.fnv1a32(F.col("text")).alias("id"))
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")


@query("select lang, min(doc_id) as representative, count(*) as members, length(text) as chars from documents where trim(text) <> '' group by text, lang")
def dedup_representatives(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("trim(text) <> ''").select("doc_id", "lang", *_text_key("text"))
    return reconcile.representatives(d, ["h", "n", "lang"], "doc_id").select("lang", "representative", "members", F.col("n").cast("bigint").alias("chars"))


@query("select doc_id, min(doc_id) over (partition by text, lang) as representative, count(*) over (partition by text, lang) as members from documents where text is not null")
def fan_out(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null").select("doc_id", "lang", *_text_key("text"))
    reps = reconcile.representatives(d, ["h", "n", "lang"], "doc_id")
    return reconcile.fan_out(d, reps, ["h", "n", "lang"]).select("doc_id", "representative", "members")


_MEMORY = "(select doc_id, case when quality = 1 then 'done' else '' end as translated, toxic = 1 as approved from labels)"


def _memory(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("").alias("translated"), (F.col("toxic") == 1).alias("approved"))


@query(f"select d.doc_id, d.source, coalesce(m.translated, '') as translated, coalesce(m.approved, false) as approved from documents d left join {_MEMORY} m using (doc_id)")
def memory_merge(spark, sf_dir):
    return reconcile.merge_strings(_t(spark, sf_dir, "documents").select("doc_id", "source"), _memory(spark, sf_dir), "doc_id")


@query(f"select d.doc_id, d.source from documents d left join {_MEMORY} m using (doc_id) where not coalesce(m.approved, false) and coalesce(m.translated, '') = ''")
def work_selection(spark, sf_dir):
    merged = reconcile.merge_strings(_t(spark, sf_dir, "documents").select("doc_id", "source"), _memory(spark, sf_dir), "doc_id")
    return reconcile.pending(merged).select("doc_id", "source")


@query(f"select coalesce(m.doc_id, f.doc_id) as doc_id, coalesce(m.translated, f.source, '') as original, coalesce(f.lang, m.translated) as translated, coalesce(m.approved, false) as approved from {_MEMORY} m full join (select doc_id, source, lang from documents where lang <> 'en') f on m.doc_id = f.doc_id")
def memory_upsert(spark, sf_dir):
    memory = _memory(spark, sf_dir).withColumn("original", F.col("translated"))
    fresh = _t(spark, sf_dir, "documents").filter("lang <> 'en'").select("doc_id", F.col("source").alias("original"), F.col("lang").alias("translated"))
    return reconcile.merge_translations(memory, fresh, "doc_id")


@query("select doc_id from documents d where not exists (select 1 from conversations c where lower(c.role) = lower(d.source)) and not exists (select 1 from benchmark b where lower(trim(b.text)) = lower(trim(d.text)))")
def anti_existing(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.lower("source").alias("role"), *_text_key(F.lower(F.trim("text"))))
    b = _t(spark, sf_dir, "benchmark").select(*_text_key(F.lower(F.trim("text"))))
    roles = _t(spark, sf_dir, "conversations").select(F.lower("role").alias("role")).distinct()
    return reconcile.missing(reconcile.missing(d, b, ["h", "n"]), roles, ["role"]).select("doc_id")


@query("select doc_id from documents where text in (select text from documents where source = 'src1') and source <> 'src1'")
def duplicates_of_selection(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", *_text_key("text"))
    chosen = d.filter("source = 'src1'").select("h", "n").distinct()
    return d.filter("source <> 'src1'").join(chosen, ["h", "n"], "left_semi").select("doc_id")


@query("""with u as (select distinct lower(split_part(url, '/', 1) || '/' || split_part(url, '/', 2) || '/' || split_part(url, '/', 3)) as unit from pages
union select lower(split_part(url, '/', 1) || '/' || split_part(url, '/', 2) || '/' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4)) from pages group by all having count(*) > 1)
select page_id, max_by(unit, length(unit) * 1000000) as unit from pages join u on lower(url) = unit or starts_with(lower(url), unit || '/') group by page_id""")
def assign_unit_prefix(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", "url")
    head = lambda n: F.lower(F.array_join(F.slice(F.split("url", "/"), 1, n), "/"))
    deeper = p.groupBy(head(4).alias("unit")).count().filter("count > 1").select("unit")
    units = p.select(head(3).alias("unit")).unionByName(deeper).distinct()
    return reconcile.assign_unit(p, "url", units, "unit").select("page_id", "unit")


_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_ANY = lambda c, ps: "(" + " or ".join(f"regexp_matches({c}, '{p}')" for p in ps) + ")"
_HAS = lambda c, ms: "(" + " or ".join(f"contains({c}, '{m}')" for m in ms) + ")"

_GAME = f"""select i, s, case when length(t) < 2 or not regexp_matches(t, '\\p{{L}}') or {_ANY('t', predicates.NEVER)} then false
when contains(t, ' ') or contains(t, chr(10)) or lower(t) in {_IN(predicates.INTERFACE_WORDS)} then true
when {_ANY('t', predicates.IDENTIFIER)} or lower(t) in {_IN(predicates.CODE_WORDS)} then false
when upper(t) = t and length(t) <= 20 and not contains(t, '_') then true
else regexp_matches(t, '^\\p{{Lu}}[^\\p{{Lu}}]+$') and length(t) between 4 and 30 end as game_text
from (select *, {_STRIP.replace('{c}', 's')} as t from (select doc_id as i, text as s from documents where text is not null union all select p_partkey + 1000000000, p_name from part))"""


_BARE = r"regexp_replace(regexp_replace(t, '\{[^}]*\}', '', 'g'), '\[[^\]]*\]', '', 'g')"
_TECH = rf"""select i, (t = '' or {" or ".join(f"ends_with(lower(t), '{e}')" for e in predicates.ASSET_ENDINGS)} or (not contains(b, ' ') and (contains(b, '/') or contains(b, '\')) and contains(b, '.'))
 or regexp_matches(t, '^#[0-9a-fA-F]{{3,8}}$') or t in {_IN(predicates.STYLE_KEYS)} or not regexp_matches(b, '\p{{L}}')) as script_technical,
 (t = '' or not regexp_matches(s, '\p{{L}}') or ((contains(s, '/') or contains(s, '\')) and contains(l, '.') and lower(list_extract(string_split(l, '.'), -1)) in {_IN(predicates.PATH_ENDINGS)}) or (not contains(s, ' ') and contains(s, '_'))) as code_technical,
 not (t = '' or lower(t) in ('true', 'false') or regexp_matches(t, '^-?[0-9]+(\.[0-9]+)?$') or contains(t, '->') or regexp_matches(t, '^\[[^\]]+\]$') or regexp_matches(t, '^\([^)]*\)$')) as definition_text,
 regexp_matches(t, '\p{{L}}') and not regexp_matches(t, '^[\{{\[\(][A-Z0-9_\-\s]+[\}}\]\)]$') as localised_text
from (select *, {_BARE} as b, list_extract(string_split(replace(s, '\', '/'), '/'), -1) as l from (select *, {_STRIP.replace('{c}', 's')} as t from
(select page_id as i, url as s from pages union all select doc_id + 1000000000, text from documents where text is not null)))"""


@query("""select conv_id, turn, row_number() over (partition by conv_id, role order by turn) - 1 as ordinal,
case when row_number() over (partition by conv_id, role order by turn) = 1 then role else role || '_' || (row_number() over (partition by conv_id, role order by turn) - 1)::varchar end as name from conversations""")
def running_ordinal(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ordered.ordinal(["conv_id", "role"], ["turn"]).cast("bigint").alias("ordinal"), ordered.unique_names(F.col("role"), ["conv_id", "role"], ["turn"]).alias("name"))


@query("""select conv_id, turn, case when length(p) > 250 then substring(p, 1, 150) || '...' else p end as previous, s as speaker
from (select conv_id, turn, lag(text) over w as p, lag(role) over w as s from conversations window w as (partition by conv_id order by turn))""")
def prev_turn_context(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    before = lambda x: ordered.previous_context(x, ["conv_id"], ["turn"])
    return c.select("conv_id", "turn", before(F.col("text")).alias("previous"), before(F.col("role")).alias("speaker"))


@query("""select source as unit, count(*) as total, count(*) filter (quality = 1) as translated, cast(floor(count(*) filter (quality = 1) * 100 / count(*) + 0.5) as bigint) as percent,
case when count(*) filter (quality = 1) = count(*) then 1 else 0 end as tier from documents left join labels using (doc_id) group by source""")
def unit_progress(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return report.unit_progress(d, "source", F.coalesce(F.col("quality") == 1, F.lit(False)))


@query("""select count(*) as total, count(*) filter (o) as todo, count(*) - count(*) filter (o) as done
from (select bool_or(coalesce(quality, 0) <> 1) as o from documents left join labels using (doc_id) where text is not null group by text, lang)""")
def progress_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null").select("doc_id", "lang", *_text_key("text"))
    d = d.join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return report.key_progress(d, ["h", "n", "lang"], F.coalesce(F.col("quality") == 1, F.lit(False)))


@query("""select doc_id, greatest(1, length(text) // 3 + 1) as tokens, r as ratio, greatest(1, cast(floor((8192 - 220 - 0) / (1 + r) * 0.92) as bigint)) as budget
from (select doc_id, text, case lang when 'de' then 1.5::double when 'fr' then 1.6::double else 1.2::double end as r from documents) where text is not null""")
def token_budget(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null")
    language = F.when(F.col("lang") == "de", "Russian").when(F.col("lang") == "fr", "Korean").otherwise("English")
    ratio = text.output_ratio(language)
    return d.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), ratio.alias("ratio"), text.input_budget(F.lit(8192), F.lit(0), ratio).alias("budget"))


@query("""with recursive x as (select source, doc_id, greatest(1, length(coalesce(text, '')) // 3 + 1) + 1 + 12 as c, row_number() over (partition by source order by doc_id) as rn from documents),
r as (select source, doc_id, rn, c as u, 1 as n, 0::bigint as b from x where rn = 1 union all
select x.source, x.doc_id, x.rn, case when r.n >= 30 or r.u + x.c > 2933 then x.c else r.u + x.c end, case when r.n >= 30 or r.u + x.c > 2933 then 1 else r.n + 1 end, case when r.n >= 30 or r.u + x.c > 2933 then r.b + 1 else r.b end
from r join x on x.source = r.source and x.rn = r.rn + 1)
select source, doc_id, b as batch from r""")
def greedy_batches(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    d = _docs(spark, sf_dir).select("source", "doc_id", text.item_cost(t, F.lit("")).alias("cost"))
    return ordered.greedy_batches(d, "source", "doc_id", "cost", 2933, 30)


@query("""select count(*) as files, count(*) filter (n < 5) as small, count(*) filter (n < 5) >= 8 and count(*) filter (n < 5) >= count(*) * 0.7 as together
from (select count(*) as n from documents group by source, lang)""")
def small_file_rule(spark, sf_dir):
    return report.small_files(_t(spark, sf_dir, "documents"), ["source", "lang"])


@query("select user_id, round(list_reduce(list(value order by ts, event_id), lambda a, x: a * (1 - 0.4::double) + x * 0.4::double), 6) as ema, count(*) as samples from events group by user_id")
def ema_calibration(spark, sf_dir):
    e = ordered.ema(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return e.select("user_id", F.round("ema", 6).alias("ema"), "samples")


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 21599999999 preceding and current row) as in_window from events")
def rate_window(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", ordered.window_count(["user_id"], 21600).alias("in_window"))


@query("select event_id, gap from (select event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events) where gap < 600000000")
def pacing_violations(spark, sf_dir):
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, sf_dir, "events").select("event_id", gap.alias("gap")).filter("gap < 600000000")


_MESSAGE = "event_type || case event_id % 7 when 0 then ' HTTP 429 Too Many Requests' when 1 then ' 401 Unauthorized' when 2 then ' Failed to connect' when 3 then ' quota exceeded, invalid api key' when 4 then ' billing' when 5 then ' SSL error' else ' done' end"


@query(f"""select event_id, case when {_HAS('m', predicates.RATE_MARKERS)} then 'rate' when {_HAS('m', predicates.AUTH_MARKERS)} then 'auth' else 'other' end as error_class,
not {_HAS('m', predicates.CONNECTION_MARKERS)} as reached from (select event_id, lower({_MESSAGE}) as m from events)""")
def error_classes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.expr(_MESSAGE).alias("m"))
    return e.select("event_id", predicates.error_class(F.col("m")).alias("error_class"), predicates.reached_server(F.col("m")).alias("reached"))


@query("""select source as unit, count(*) as lines, count(*) filter (length(text) >= 3000) as long_lines, max(length(text)) as longest, substring(arg_max(text, length(text) * 10000000000 - doc_id), 1, 120) as sample,
case when count(*) filter (length(text) >= 3000) * 4 > count(*) then 'high' when count(*) filter (length(text) >= 3000) > 0 then 'low' else 'none' end as verdict from documents where text is not null group by source""")
def risk_report(spark, sf_dir):
    return report.risk_report(_docs(spark, sf_dir).filter("text is not null"), "source", "text", "doc_id")


@query(r"""select page_id, kind, count(*) as tokens, sum(length(token))::bigint as chars from (select page_id, kind, trim(regexp_replace(regexp_replace(raw, '^\[\[|\]\]$', '', 'g'), '[\s]+', ' ', 'g')) as token from
(select page_id, raw, case when starts_with(raw, '[[') then 'link' when starts_with(raw, '<<') then 'macro' when starts_with(raw, '<') then 'tag' else 'text' end as kind from
(select page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<<.*?>>|<[^>]*>|\[\[[^\]]*\]\]|[^<\[]+|[<\[]')) as raw from pages)))
where kind <> 'tag' and regexp_matches(token, '[a-zA-Zа-яА-Я]') group by page_id, kind""")
def html_tokens(spark, sf_dir):
    t = markup.markup_tokens(_t(spark, sf_dir, "pages"), "page_id", "html")
    return t.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.length("token")).alias("chars"))


def _sql_tokens(c, k):
    return f"list_sort(regexp_extract_all({c}, '{text.TOKENS[k]}'))"


@query("select event_id, unnest(json_keys(props)) as path, json_extract_string(props, '$.k') as value from events where props is not null")
def json_flatten(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("props is not null").select("event_id", F.explode(markup.map_leaves(F.col("props"))).alias("kv"))
    return e.select("event_id", F.col("kv.key").alias("path"), F.col("kv.value").alias("value"))


@query("""select doc_id, coalesce(json_extract_string(j, '$.items[0].text'), json_extract_string(j, '$.text')) as translated from
(select doc_id, case doc_id % 3 when 0 then '{"items": [{"id": "a", "text": "' || source || '"}]}' when 1 then '{"id": "a", "text": "' || lang || '"}' else '{"other": 1}' end as j from documents)""")
def reply_parse(spark, sf_dir):
    fence = F.expr("""case doc_id % 3 when 0 then '```json\n{"items": [{"id": "a", "text": "' || source || '"}]}\n```' when 1 then 'Here: {"id": "a", "text": "' || lang || '"} done' else '{"other": 1}' end""")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(fence, r"(?s)(\{.*\})", 1).alias("j"))
    items, flat = F.from_json("j", "items array<struct<id:string,text:string>>"), F.from_json("j", "id string, text string")
    return d.select("doc_id", F.coalesce(F.get(items["items"], F.lit(0))["text"], flat["text"]).alias("translated"))


@query("select d.doc_id, c.v as cached, c.v is not null as hit from documents d left join (select doc_id, doc_id % 3 as version, 'q' || quality::varchar as v from labels) c on c.doc_id = d.doc_id and c.version = d.doc_id % 2")
def cache_split(spark, sf_dir):
    units = _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("version"))
    cache = _t(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3).alias("version"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    return reconcile.cache_split(units, cache, ["doc_id", "version"], "v").select("doc_id", "cached", "hit")


@query(r"select doc_id, list_sum(list_transform(w, lambda x: length(x)))::bigint as foreign_chars, len(w) as foreign_words from (select doc_id, regexp_extract_all(regexp_replace(text, '\{[^}]*\}|\[[^\]]*\]', '', 'g'), '[a-zA-Z]*[à-öø-ÿ]+[a-zA-Zà-öø-ÿ]*') as w from documents where lang = 'en' and text is not null) where len(w) > 0")
def foreign_words(spark, sf_dir):
    bare = F.regexp_replace("text", r"\{[^}]*\}|\[[^\]]*\]", "")
    d = _docs(spark, sf_dir).filter("lang = 'en' and text is not null").select("doc_id", F.regexp_extract_all(bare, F.lit("[a-zA-Z]*[à-öø-ÿ]+[a-zA-Zà-öø-ÿ]*"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    total = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return d.select("doc_id", total.alias("foreign_chars"), F.size("w").cast("bigint").alias("foreign_words"))


@query("select doc_id, source from documents where contains(lower(text), lower('Licensed')) or contains(lower(source), lower('Licensed')) order by doc_id offset 5 limit 500")
def search_page(spark, sf_dir):
    """The second-and-later rows of a page of a search: the limit is the feature."""
    hit = F.lower("text").contains("licensed") | F.lower("source").contains("licensed")
    return _docs(spark, sf_dir).filter(hit).select("doc_id", "source").orderBy("doc_id").offset(5).limit(500)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_items(spark, sf_dir):
    return reconcile.missing(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), ["doc_id"])


@query("select source as unit, sha256(string_agg(line, chr(10) order by line)) as fingerprint from (select source, lang || ':' || n_chars::varchar || ':' || doc_id::varchar as line from documents) group by source")
def fingerprint(spark, sf_dir):
    line = F.concat_ws(":", "lang", F.col("n_chars").cast("string"), F.col("doc_id").cast("string"))
    return report.fingerprint(_t(spark, sf_dir, "documents"), "source", line)


@query("select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from conversations")
def section_carry_forward(spark, sf_dir):
    head = F.when(F.col("role") == "user", F.col("turn"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", ordered.carry_forward(head, ["conv_id"], ["turn"]).alias("section"))


@query("""select c_custkey, coalesce(case when c_acctbal > 5000 then c_mktsegment end, case when n_nationkey % 2 = 0 then n_name end, r_name) as value, case when c_acctbal > 5000 then 0 when n_nationkey % 2 = 0 then 1 else 2 end as depth
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def inherit_nearest(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    own, parent = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return c.select("c_custkey", F.coalesce(own, parent, "r_name").alias("value"), F.when(own.isNotNull(), 0).when(parent.isNotNull(), 1).otherwise(2).alias("depth"))


@query("select l_orderkey, o as at, n as chars, coalesce(lag(o + n) over (partition by l_orderkey order by o, n) > o, false) as overlap from (select *, cast(l_quantity as bigint) as n, l_linenumber::bigint * 20 as o from lineitem)")
def edit_overlaps(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("bigint")).withColumn("o", F.col("l_linenumber").cast("bigint") * 20)
    return l.select("l_orderkey", F.col("o").alias("at"), F.col("n").alias("chars"), ordered.overlaps(F.col("o"), F.col("n"), ["l_orderkey"]).alias("overlap"))


@query("""select doc_id, case when regexp_matches(text, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]') then 'cjk' when regexp_matches(text, '[\\x{0600}-\\x{06FF}]') then 'arabic' when regexp_matches(text, '[\\x{0590}-\\x{05FF}]') then 'hebrew'
when regexp_matches(text, '[\\x{0E00}-\\x{0E7F}]') then 'thai' when regexp_matches(text, '[\\x{0900}-\\x{097F}]') then 'devanagari' when regexp_matches(text, '[\\x{0400}-\\x{04FF}]') then 'cyrillic' else 'latin' end as script from documents where text is not null""")
def script_detection(spark, sf_dir):
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", text.script_of(F.col("text")).alias("script"))


@query("""select date_trunc('hour', ts) as hour, event_type, count(*) as events, sum(cast(round(value * 100) as bigint))::bigint as cents from events group by 1, 2""")
def progress_stream(spark, sf_dir):
    """A stream over the table's files, run until all of them are read."""
    return progress.run_available(spark, f"{sf_dir}/events.parquet", f"{shared_folder(spark)}/corpusloom/progress-{uuid.uuid4().hex}")


# The four queries above that see a part of their tables or texts, over all of them.
@query(_GAME)
def game_text_filter(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null").select(F.col("doc_id").alias("i"), F.col("text").alias("s"))
    p = _t(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000000).alias("i"), F.col("p_name").alias("s"))
    return d.unionByName(p).select("i", "s", predicates.game_text(F.col("s")).alias("game_text"))


@query(_TECH)
def technical_filter(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("i"), F.col("url").alias("s"))
    d = _docs(spark, sf_dir).filter("text is not null").select((F.col("doc_id") + 1000000000).alias("i"), F.col("text").alias("s"))
    s = F.col("s")
    return p.unionByName(d).select("i", predicates.script_technical(s).alias("script_technical"), predicates.code_technical(s).alias("code_technical"), predicates.definition_text(s).alias("definition_text"), predicates.localised_text(s).alias("localised_text"))


@query("select doc_id, list_filter([" + ", ".join(f"case when {_sql_tokens('text', k)} <> {_sql_tokens('upper(text)', k)} then '{k}' end" for k in text.TOKENS) + "], lambda x: x is not null) as violations from documents where text is not null")
def token_multiset_check(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null")
    return d.select("doc_id", text.token_violations(F.col("text"), F.upper("text")).alias("violations"))


@query("""select key, origin, chars from (select *, row_number() over (partition by key order by priority) as rn from
(select doc_id as key, 'loose' as origin, 0 as priority, length(text) as chars from documents union all
select item_id, 'archive', 1, length(text) from benchmark union all select page_id, 'page', 2, length(url) from pages)) where rn = 1""")
def priority_union(spark, sf_dir):
    part = lambda t, k, o, c: _t(spark, sf_dir, t).select(F.col(k).alias("key"), F.lit(o).alias("origin"), F.length(c).cast("bigint").alias("chars"))
    return reconcile.priority_union(part("documents", "doc_id", "loose", "text"), part("benchmark", "item_id", "archive", "text"), part("pages", "page_id", "page", "url"), key="key").select("key", "origin", "chars")


@query("select doc_id, row_number() over (partition by text, lang order by doc_id) = 1 as first_seen from documents where text is not null")
def first_seen(spark, sf_dir):
    """The first of rows with one text and context; the others are repeats. Texts are told apart by hash and length."""
    from pyspark.sql import Window

    d = _docs(spark, sf_dir).filter("text is not null").select("doc_id", "lang", *_text_key("text"))
    return d.select("doc_id", (F.row_number().over(Window.partitionBy("h", "n", "lang").orderBy("doc_id")) == 1).alias("first_seen"))


@query("""select user_id, arg_min(event_type, r) as value, max(n) as times from (select *, row_number() over (partition by user_id order by n desc, f) as r from
(select user_id, event_type, count(*) as n, min(event_id) as f from events group by user_id, event_type)) where r = 1 group by user_id""")
def most_common_value(spark, sf_dir):
    """The value that is most common for each key; of equally common ones the one seen first. Counts combine before the shuffle."""
    counts = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    best = counts.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("f")).alias("f"), "event_type")).alias("x"))
    return best.select("user_id", F.col("x.event_type").alias("value"), F.col("x.n").alias("times"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as requests, count(distinct user_id) as users from events group by 1")
def utc_days(spark, sf_dir):
    """Requests by day; sessions are assumed to be in UTC."""
    e = _t(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("users"))


@query("select source as unit, total, cast(row_number() over (order by total = 0, total desc, lower(source)) as integer) as place from (select source, count(*) filter (quality = 1) as total from documents left join labels using (doc_id) group by source)")
def unit_order(spark, sf_dir):
    """Units with nothing to do last, then by size, then by name; one row a unit is ordered."""
    from pyspark.sql import Window

    d = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    units = d.groupBy(F.col("source").alias("unit")).agg(F.count_if(F.col("quality") == 1).alias("total"))
    return units.withColumn("place", F.row_number().over(Window.orderBy(F.col("total") == 0, F.desc("total"), F.lower("unit"))))


@query(rf"""select doc_id, md5(case when o_lead then u else regexp_replace(u, '^{text.SPACE_OR_LINE}*\n', '') end) as digest from (select doc_id, o_lead, case when o_trail then t else regexp_replace(t, '\n{text.SPACE_OR_LINE}*\z', '') end as u from
(select doc_id, chr(10) || text || chr(10) || ' ' || chr(10) as t, regexp_matches(text, '^{text.BLANK}*(\n|\z)') as o_lead, regexp_matches(text, '\n{text.BLANK}*\z') as o_trail from documents where text is not null))""")
def newline_repair(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null")
    return d.select("doc_id", F.md5(text.match_newlines(F.concat(F.lit("\n"), F.col("text"), F.lit("\n \n")), F.col("text"))).alias("digest"))


@query(rf"select doc_id, md5(regexp_replace(text || ' 100% of %s %(n)s %9d %(x', '{text.PERCENT}', '\1\2\2', 'g')) as digest from documents where text is not null")
def percent_repair(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null")
    return d.select("doc_id", F.md5(text.escape_percent(F.concat("text", F.lit(" 100% of %s %(n)s %9d %(x")))).alias("digest"))


@query("""select d.doc_id, md5(string_agg(case when length(line) between 20 and 60 then '<' || line || '>' else line end, chr(10) order by pos)) as digest, count(*) filter (length(line) between 20 and 60) as written
from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null) d group by d.doc_id
union all select doc_id, null, 0 from documents where text is null""")
def write_back(spark, sf_dir):
    """Lines of 20 to 60 characters go into a memory once, under their identifiers, and come back into every text in brackets."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    lines = d.select(F.explode(F.split("text", "\n", -1)).alias("original")).filter("length(original) between 20 and 60").distinct()
    memory = lines.select(ids.fnv1a32(F.col("original")).alias("id"), "original", F.concat(F.lit("<"), "original", F.lit(">")).alias("translated"))
    return sinks.write_back(d, "doc_id", "text", memory, ids.fnv1a32).select("doc_id", F.md5("text").alias("digest"), "written")


@query("select conv_id::varchar as id, arg_max(text, turn) as text from conversations where trim(coalesce(text, '')) <> '' group by conv_id")
def reply_join(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    replies = c.select(F.concat(F.lit("  "), F.col("conv_id").cast("string"), F.lit(" ")).alias("id"), "turn", "text")
    return reconcile.reply_results(c.select(F.col("conv_id").cast("string").alias("id")).distinct(), replies, "turn")


@query("select doc_id, 'loose' as origin from documents where n_chars > 20000 union all select doc_id, 'packed' from documents where source not in (select source from documents where n_chars > 20000)")
def loose_or_packed(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    loose, packed = d.filter("n_chars > 20000").withColumn("origin", F.lit("loose")), d.withColumn("origin", F.lit("packed"))
    return reconcile.unless_loose(loose, packed, "source").select("doc_id", "origin")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rank, rank < greatest(1, ceil(q / 40.0)) as engaged from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sum(l_quantity::double) over (partition by l_orderkey) as q,
coalesce(sum(case when l_returnflag = 'N' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0)::bigint as rank from lineitem)""")
def worker_ramp(spark, sf_dir):
    from pyspark.sql import Window

    place = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", *place, "l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    l = l.withColumn("rank", ordered.rank_among(F.col("l_returnflag") == "N", ["l_orderkey"], place)).withColumn("q", F.sum("q").over(Window.partitionBy("l_orderkey")))
    return l.select("l_orderkey", *place, "rank", ordered.engage(F.col("rank"), F.col("q"), F.lit(40.0)).alias("engaged"))


@query("select l_suppkey as slot, count(distinct nullif(l_returnflag, 'N')) as versions, count(*) filter (nullif(l_returnflag, 'N') is null) as keepers from lineitem group by l_suppkey")
def slot_users(spark, sf_dir):
    return report.slot_users(_t(spark, sf_dir, "lineitem"), "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))


@query("select l_orderkey, round(min(case when l_quantity::double / 20 > 1.03 then greatest(0.6::double, 1.0::double / (l_quantity::double / 20) * 1.03::double) end), 6) as worst from lineitem group by l_orderkey")
def worst_shrink(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", report.shrink_factor(F.col("l_quantity").cast("double") / 20).alias("factor"))
    return l.groupBy("l_orderkey").agg(F.round(F.min("factor"), 6).alias("worst"))


@query("select conv_id as block, substring(md5(string_agg(coalesce(text, '') || chr(13) || chr(10), '' order by turn)), 1, 8) as digest from conversations group by conv_id")
def block_digests(spark, sf_dir):
    return report.block_digest(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(r"select page_id, list_extract(string_split(replace(url, '\', '/'), '/'), -1) as leaf, split_part(url || '!' || page_id::varchar, '!', 1) as container, list_has_any(string_split(lower(url), '/'), ['page', 'blog', 'news', 'docs', 'a']) as known from pages where url is not null")
def path_parts(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").filter("url is not null")
    member = F.concat("url", F.lit("!"), F.col("page_id").cast("string"))
    return p.select("page_id", text.path_leaf(F.col("url")).alias("leaf"), text.container(member).alias("container"), text.has_segment(F.col("url"), ["page", "blog", "news", "docs", "a"]).alias("known"))
