"""Queries of escapes and repairs, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import escapes, repairs
from corpusloom.registry import query, table

# Replacements that plant defects, as a result brings them and as they must stand in the end.
_BARE = "translate(text, '%{}[]\\\"', '')"
_PLANTED = [(" the ", " {i}the{/iX} ", " {i}the{/i} "), (" de ", " [de] ", " [de] "), (" of ", " [no way] ", " [[no way] "), (" and ", " 5%, ", " 5%%, "), (" la ", " %s la ", " %s la "), ("ou", "\\u0153", "œ"), ("qui", "\\\"q\\\"", "\"q\"")]


def _planted(which: int) -> str:
    out = "_bare"
    for entry in _PLANTED:
        out = "replace(" + out + ", " + ", ".join("'" + x + "'" for x in (entry[0], entry[which])) + ")"
    return out


_ENDS = r"[\t\n\x0B\f\r ]"


@query(f"""with b as (select doc_id, {_BARE} as _bare from documents where text is not null),
t as (select doc_id, chr(10) || ' ' || chr(10) || {_planted(2)} || chr(10) || ' ' as t from b)
select doc_id, md5(regexp_replace(regexp_replace(t, '\\n{_ENDS}*$', ''), '^{_ENDS}*\\n', '')) as digest, length(regexp_replace(regexp_replace(t, '\\n{_ENDS}*$', ''), '^{_ENDS}*\\n', ''))::bigint as chars from t""")
def repair_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.translate("text", "%{}[]\\\"", "").alias("result"))
    for entry in _PLANTED:
        docs = docs.withColumn("result", F.replace("result", F.lit(entry[0]), F.lit(entry[1])))
    docs = docs.select("doc_id", F.concat(F.lit("\\n \n"), "result", F.lit("\\n ")).alias("result"), F.lit("one line").alias("original"))
    out = repairs.repaired(docs, "result", "original")
    return out.select("doc_id", F.md5("result").alias("digest"), F.length("result").cast("bigint").alias("chars"))


# Words that become tags, so that whole texts hold open, closed, crossed, mangled and stray ones.
_TAGS = [("the", "{i}"), ("and", "{/i}"), ("of", "{b}"), ("in", "{/bX}"), ("to", "{/b}"), ("de", "{size=3}"), ("le", "{/size}"), ("la", "{/i}"), ("el", "{i}"), ("die", "{b}"), ("der", "{/}")]


def _tagged() -> str:
    out = "translate(text, '{}', '')"
    for word, tag in _TAGS:
        out = f"replace({out}, ' {word} ', ' {tag} ')"
    return out


@query(f"""with recursive s as (select doc_id, {_tagged()} as s from documents where text is not null),
tok as (select doc_id, unnest(range(1, len(ts) + 1)) as place, unnest(ts) as raw from (select doc_id, regexp_extract_all(s, '\\{{[^{{}}]*\\}}|[^{{]+') as ts from s)),
t as (select doc_id, place, row_number() over (partition by doc_id order by place) as pos, raw, starts_with(raw, '{{/') as closing, split_part(regexp_replace(raw, '^\\{{/?|\\}}$', '', 'g'), '=', 1) as name from tok where starts_with(raw, '{{')),
walk as (
  select doc_id, 0::bigint as pos, []::varchar[] as rev, []::varchar[] as early, null::varchar as piece from s
  union all
  select doc_id, pos, case when not closing then list_prepend(name, rev) when name = '' then rev[2:] when hit > 0 then rev[hit + 1:] else rev end,
    case when hit > 0 and closing and name != '' then list_concat(early, rev[1:hit - 1]) when closing and name != '' and late is not null then list_concat(early[1:list_position(early, late) - 1], early[list_position(early, late) + 1:]) else early end,
    case when not closing or name = '' then raw when hit > 0 then array_to_string(list_transform(rev[1:hit - 1], lambda x: '{{/' || x || '}}'), '') || '{{/' || rev[hit] || '}}' when late is not null then '' else raw end
  from (select t.doc_id, t.pos, t.raw, t.closing, t.name, w.rev, w.early,
      case when len(w.rev) > 0 and starts_with(t.name, w.rev[1]) then 1 when list_contains(w.rev, t.name) then list_position(w.rev, t.name)
        else coalesce(list_position(list_transform(w.rev, lambda x: starts_with(t.name, x)), true), 0) end as hit,
      case when list_contains(w.early, t.name) then t.name else list_filter(w.early, lambda x: starts_with(t.name, x))[1] end as late
    from walk w join t on t.doc_id = w.doc_id and t.pos = w.pos + 1))
select tok.doc_id, md5(string_agg(coalesce(walk.piece, tok.raw), '' order by tok.place)) as digest, coalesce(bool_or(walk.piece != t.raw), false) as changed
from tok left join t on t.doc_id = tok.doc_id and t.place = tok.place left join walk on walk.doc_id = t.doc_id and walk.pos = t.pos and t.pos > 0 group by tok.doc_id""")
def tag_repair(spark, sf_dir):
    """The mended texts, and whether they differ from what they were."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and translate(text, '{}', '') != ''").select("doc_id", F.translate("text", "{}", "").alias("given"))
    for word, tag in _TAGS:
        docs = docs.withColumn("given", F.replace("given", F.lit(f" {word} "), F.lit(f" {tag} ")))
    docs = docs.withColumn("mended", repairs.repair_tags(F.col("given")))
    return docs.select("doc_id", F.md5("mended").alias("digest"), (F.col("mended") != F.col("given")).alias("changed"))


_RAW = [("th", "\\t", "\t"), ("sh", '\\"', '"'), ("é", "\\u00e9", "é"), ("io", "\\\\", "\\"), (" la", "\\n", "\n"), ("gr", "\\g", "g")]


def _chain(text: str, which: int) -> str:
    for entry in _RAW:
        text = "replace(" + text + ", " + ", ".join("'" + x + "'" for x in (entry[0], entry[which])) + ")"
    return text


@query(f"""select doc_id, md5({_chain("replace(text, chr(92), '/')", 2)}) as decoded,
md5('"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r'), '"', chr(92) || '"') || '"') as literal,
md5('"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '"', chr(92) || '"'), '  ', ' ' || chr(92) || ' '), '  ', ' ' || chr(92) || ' ') || '"') as spoken,
true as round_trips from documents where text is not null""")
def escape_families(spark, sf_dir):
    """Whole texts as literals of several families and back."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    raw = F.replace("text", F.lit("\\"), F.lit("/"))
    for entry in _RAW:
        raw = F.replace(raw, F.lit(entry[0]), F.lit(entry[1]))
    d = d.select("doc_id", "text", raw.alias("raw"), F.translate("text", "{[%", "").alias("spoken"))
    trips = [
        escapes.code_decode(escapes.inner(escapes.code_encode(F.col("text")))) == F.col("text"),
        escapes.verbatim_decode(escapes.inner(escapes.verbatim_encode(F.col("text")), 2)) == F.col("text"),
        escapes.settings_decode(escapes.field_encode(F.col("text"), True)) == F.col("text"),
        escapes.unwrapped(escapes.rewrapped(F.col("text"))) == F.col("text"),
        escapes.script_decode(escapes.inner(escapes.say_encode(F.col("spoken")))) == F.col("spoken"),
        escapes.script_decode(escapes.inner(escapes.entry_encode(F.col("spoken"))), False) == F.col("spoken"),
    ]
    every = trips[0]
    for t in trips[1:]:
        every = every & t
    return d.select("doc_id", F.md5(escapes.settings_decode(F.col("raw"))).alias("decoded"), F.md5(escapes.code_encode(F.col("text"))).alias("literal"), F.md5(escapes.say_encode(F.col("text"))).alias("spoken"), every.alias("round_trips"))
