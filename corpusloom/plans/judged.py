"""Queries of decisions about strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import judgements as j
from corpusloom.registry import query, table

_LIST = lambda words: "(" + ", ".join("'" + w + "'" for w in words) + ")"
_HAS = lambda c, words: "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"
_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]"

# Lines of all documents stand for values of properties, cells, lines of code and findings.
_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null)"
_NAME = "case pos % 5 when 0 then 'Title' when 1 then 'StrID' when 2 then 'Pin_3_0123456789abcdef01' when 3 then 'keepLevel' end"
_VALUE = "case pos % 4 when 0 then line when 1 then replace(line, ' ', '.') when 2 then split_part(line, ' ', 1) else '[' || translate(split_part(line, ' ', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ']' end"
_CELL = "case pos % 5 when 0 then length(line) || '|12||{' || split_part(line, ' ', 1) || '}' when 1 then '{' || line || '} {x}' when 2 then '???' when 3 then line else '1|x' || line end"
_STRIPPED = lambda c: rf"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


@query(rf"""with v as (select doc_id, pos, line, {_NAME} as name, {_VALUE} as value, {_CELL} as cell from {_LINES}),
s as (select *, {_STRIPPED('value')} as t from v),
w as (select *, list_filter(regexp_split_to_array(lower({_STRIPPED('line')}), '{_SPACES}+'), lambda x: x != '') as ws from s)
select doc_id, pos, coalesce(lower(name) in {_LIST(j.TECHNICAL_PROPERTIES)} or regexp_matches(name, '{j.GENERATED_END}'), false) as technical,
  not contains(t, ' ') and (length(t) - length(replace(t, '.', '')) >= 2 or regexp_matches(t, '{j.GENERATED_END}')) as identifier,
  not (coalesce(lower(name) in {_LIST(j.TECHNICAL_PROPERTIES)} or regexp_matches(name, '{j.GENERATED_END}'), false)) and pos % 9 != 4 and regexp_matches(t, '\p{{L}}') and not regexp_matches(t, '^[\{{\[\(][A-Z0-9_\-\s]+[\}}\]\)]$')
    and not (not contains(t, ' ') and (length(t) - length(replace(t, '.', '')) >= 2 or regexp_matches(t, '{j.GENERATED_END}'))) as shown,
  len(string_split(cell, '|')) > 1 and len(list_filter(string_split(cell, '|'), lambda x: not regexp_matches(x, '^([0-9]*|(?s:\{{.*\}}))$'))) = 0 as coded,
  cell not in {_LIST(j.CELL_NAMES)} and regexp_replace(regexp_replace(cell, '\{{[^}}]*\}}', '', 'g'), '{_SPACES}+', '', 'g') != '' as cell_text,
  len(ws) >= 6 and len(list_distinct(ws)) < len(ws) * 0.4 as repetitive from w""")
def property_judgements(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))
    made = lines.select("doc_id", "pos", "line", F.expr(_NAME).alias("name"), F.expr(_VALUE).alias("value"), F.expr(_CELL).alias("cell"))
    return made.select("doc_id", "pos", j.technical_property(F.col("name")).alias("technical"), j.identifier_like(F.col("value")).alias("identifier"), j.property_text(F.col("name"), F.col("value"), F.col("pos") % 9 == 4).alias("shown"), j.coded_cell(F.col("cell")).alias("coded"), j.cell_text(F.col("cell")).alias("cell_text"), j.repetitive(F.col("line")).alias("repetitive"))


_INLINE = """case pos % 6 when 0 then 'notes' when 1 then 'label' when 2 then 'message' end as parameter, case pos % 4 when 0 then 'append' when 1 then 'insert' when 2 then 'print' end as function, case pos % 3 when 0 then 'user_chat' when 1 then 'other' end as variable"""


@query(rf"""with v as (select doc_id, pos, line, {_INLINE} from {_LINES}), s as (select *, {_STRIPPED('line')} as t from v)
select doc_id, pos, t = '' or contains(line, '/') or contains(line, chr(92)) or regexp_matches(t, '^#[0-9a-fA-F]{{3,8}}$') or (t != '' and (contains('{j.CODE_SIGNS}', t[1]) or contains('{j.CODE_SIGNS}', t[-1]))) or {_HAS('line', j.SKIPPED_CONTEXTS)} as never,
  coalesce(parameter, '') in {_LIST(j.SHOWN_PARAMETERS)} or (coalesce(function, '') in {_LIST(j.LIST_CALLS)} and {_HAS("coalesce(variable, '')", j.SHOWN_LISTS)}) as always,
  contains(t, ' ') or contains(line, '<<') or ends_with(regexp_replace(line, '{_SPACES}+$', ''), ':') as prose, false as runs from s""")
def inline_judgements(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))
    made = lines.selectExpr("doc_id", "pos", "line", _INLINE.split(" as parameter, ")[0] + " as parameter", _INLINE.split(" as parameter, ")[1].split(" as function, ")[0] + " as function", _INLINE.split(" as function, ")[1])
    return made.select("doc_id", "pos", j.never_shown(F.col("line"), F.col("line")).alias("never"), j.always_shown(F.col("parameter"), F.col("function"), F.col("variable")).alias("always"), j.prose(F.col("line")).alias("prose"), j.runs_code(F.col("line")).alias("runs"))


_BODY = "case when event_id % 7 = 0 then 'Your REGION is blocked' when event_id % 7 = 1 then 'Invalid API key' when event_id % 7 = 2 then null else props end"
_STATUS = "case event_id % 9 when 0 then 200 when 1 then 403 when 2 then 401 when 3 then 500 when 4 then 451 when 5 then 299 when 6 then 407 when 7 then 404 else 502 end"


@query(f"""with e as (select event_id, user_id, {_STATUS} as status, lower(coalesce({_BODY}, '')) as b, event_type from events)
select event_id, case when status between 200 and 299 then 'ok' when status in (403, 451) or {_HAS('b', j.REGION_MARKS)} then 'geoblock' when status in (401, 407) or {_HAS('b', j.KEY_MARKS)} then 'auth' else 'ok' end as probe,
not contains(case event_id % 3 when 0 then 'label x is not used' when 1 then 'Could not evaluate ' || event_type || ' in the who part' else 'may be ' || event_type end, case event_id % 3 when 0 then 'is not used' when 1 then 'in the who part' else 'never so' end) as actionable,
case when user_id % 5 > 0 then round((event_id % 8) * 60.0 / (user_id % 5), 6) else 0 end as delay from e""")
def probe_judgements(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    finding = F.expr("case event_id % 3 when 0 then 'label x is not used' when 1 then 'Could not EVALUATE ' || event_type || ' in the who part' else 'may be ' || event_type end")
    return e.select("event_id", j.probe_class(F.expr(_STATUS), F.expr(_BODY)).alias("probe"), j.actionable(finding).alias("actionable"), F.round(j.request_delay(F.col("user_id") % 5, F.col("event_id") % 8), 6).alias("delay"))
