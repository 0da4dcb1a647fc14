"""Queries of settings, nested events, labels before results and kinds of strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import predicates
from corpusloom.functions.text import string_type, without_prefix
from corpusloom.registry import query, table
from corpusloom.sources import markup

# Lines of documents as settings: every fifth is a section's head, every seventh a comment, others are a key and a value.
_PLAIN = "trim(regexp_replace(translate(line, '[]=;/()', ''), '\\\\s+', ' '{g}))"
_SETTING = "case when pos % 5 = 0 then '[' || {p} || ']' when pos % 7 = 0 then '; ' || {p} || '=1' when pos % 11 = 1 then 'Language=' || {p} when pos % 11 = 2 then 'flag = TRUE' when pos % 11 = 3 then 'Item=(Name=' || {p} || ')' else 'key' || pos || '=' || {p} || '=x' end"
_SQL_PLAIN, _SPARK_PLAIN = _PLAIN.replace("\\\\", "\\").format(g=", 'g'"), _PLAIN.format(g="")


@query(f"""with l as (select doc_id, line, pos from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null)),
s as (select doc_id, pos, {_SQL_PLAIN} as p from l), m as (select doc_id, pos, p, last_value(case when pos % 5 = 0 then p end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as section from s),
k as (select *, case when pos % 11 = 1 then 'Language' when pos % 11 = 2 then 'flag' when pos % 11 = 3 then 'Item' else 'key' || pos end as key, case when pos % 11 = 1 then p when pos % 11 = 2 then 'TRUE' when pos % 11 = 3 then '(Name=' || p || ')' else p || '=x' end as value from m where pos % 5 != 0 and pos % 7 != 0)
select doc_id, pos, section, key, value, pos % 11 not in (1, 2, 3) as shown from k""")
def settings_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))
    lines = lines.select("doc_id", "pos", F.expr(_SETTING.format(p=_SPARK_PLAIN)).alias("line"))
    found = markup.sectioned_settings(lines, "doc_id", "pos", "line")
    return found.withColumn("shown", predicates.setting_text(F.col("key"), F.col("value")))


@query("""with t as (select conv_id, turn, coalesce(text, '') as text from conversations)
select conv_id, 'events.1.pages.0.list.' || (row_number() over (partition by conv_id order by turn) - 1) || '.parameters.0' as path, md5(text) as digest from t where trim(text) != ''""")
def event_texts(spark, sf_dir):
    """Turns of conversations as commands of nested events."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    command = F.struct(F.when(F.col("turn") % 2 == 0, 401).otherwise(405).alias("code"), F.array("text").alias("parameters"))
    made = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", command.alias("c")))).alias("all"))
    pages = F.struct(F.array(F.struct(F.transform("all", lambda x: x["c"]).alias("list"))).alias("pages"))
    none = F.struct(F.array().cast("array<struct<list: array<struct<code: int, parameters: array<string>>>>>").alias("pages"))
    json = F.to_json(F.struct(F.array(none, pages).alias("events")))
    found = markup.event_commands(made.select(F.col("conv_id").alias("file"), json.alias("json")))
    return found.select(F.col("file").alias("conv_id"), F.array_join("path", ".").alias("path"), F.md5("original").alias("digest"))


@query("""select doc_id, case when doc_id % 4 = 3 then 'Translation: ' || source else source end as cleaned, case doc_id % 6 when 0 then 'dialogue' when 1 then 'choice' when 2 then 'code' when 3 then 'interface' when 4 then 'character' else 'plain' end as kind from documents""")
def labels_and_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    said = F.expr("case doc_id % 4 when 0 then source when 1 then 'TRANSLATED:  ' || source when 2 then 'translation: ' || source else 'Translation: ' || source end")
    asked = F.expr("case when doc_id % 4 = 3 then 'translation: of it' else 'of it' end")
    path = F.expr("case doc_id % 6 when 0 then array('label', 'say') when 1 then array('menu_choice') when 2 then array('define', 'uscore') when 3 then array('screen', 'text') when 4 then array('define', 'x') else array('other', 'screen') end")
    return docs.select("doc_id", without_prefix(said, ("translated:", "translation:"), asked).alias("cleaned"), string_type(path).alias("kind"))
