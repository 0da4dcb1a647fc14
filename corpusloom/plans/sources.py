"""Queries of nested sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.registry import query, table
from corpusloom.sources import nested


@query(r"""select doc_id, repeat('k.', doc_id % 6) || 'text' as path, md5(regexp_replace(text, ', *([}\]])', '\1', 'g')) as digest from documents where text is not null
union all select doc_id, repeat('k.', doc_id % 6) || 'more.lang', md5(lang) from documents where text is not null""")
def nested_locale(spark, sf_dir):
    """Whole texts in JSON with comments and stray commas, at depths of one to six."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    string = lambda c: F.expr(f"substring(to_json(struct({c} as t)), 6, length(to_json(struct({c} as t))) - 6)")
    body = F.concat(F.lit('{ // "not": "there"\n "text": '), string("text"), F.lit(', "n": 5, "list": ["x", ], /* "c": "d" } */ "more": {"lang": '), string("coalesce(lang, '')"), F.lit(', }, "none": null }'))
    made = F.concat(F.expr("repeat('{\"k\": ', cast(doc_id % 6 as int))"), body, F.expr("repeat(', } // end\\n', cast(doc_id % 6 as int))"))
    found = nested.flatten_json(docs.select("doc_id", made.alias("json")), "doc_id", "json")
    return found.select("doc_id", F.array_join("path", ".").alias("path"), F.md5("value").alias("digest"))


_MADE = """(select p_partkey, 'ThingDef' as type, 'Part_' || p_partkey || '.label' as key, p_name as value from part where p_partkey % 10 != 0
union all select p_partkey, 'ThingDef', 'Part_' || p_partkey || '.description', p_type || ' of ' || p_size from part where p_partkey % 10 != 0
union all select p_partkey, 'ThingDef', 'Part_' || p_partkey || '.stages.' || i || '.label', 'stage ' || i || ' of ' || p_name from (select *, unnest(range(1 + p_partkey % 3)) as i from part) where p_partkey % 10 != 0
union all select p_partkey, 'ThingDef', 'Part_' || p_partkey || '.tip.0', p_brand from part where p_partkey % 10 != 0
union all select p_partkey, 'RecipeDef', 'Part_' || p_partkey || '.jobString', 'Making ' || p_name || '.' from part)"""


@query(f"""select * from {_MADE} m where not (type = 'ThingDef' and p_partkey % 3 = 0 and key = 'Part_' || p_partkey || '.label') and not (type = 'RecipeDef' and p_partkey % 4 = 0)""")
def definition_keys(spark, sf_dir):
    """Texts of XML definitions, one file a part, without those that an author has under a like key."""
    stage = "transform(sequence(0, cast(p_partkey % 3 as int)), i -> '<li><label>stage ' || i || ' of ' || p_name || '</label></li>')"
    xml = f"""concat('<Defs><!-- made --><ThingDef', if(p_partkey % 10 = 0, ' Abstract="True"', ''), '><defName>Part_', p_partkey, '</defName><label>', p_name, '</label><description>', p_type, ' of ', p_size,
        '</description><size>', p_size, '</size><labelPlural>', p_size, '</labelPlural><stages>', array_join({stage}, ''), '</stages><tip><li>', p_brand, '</li></tip></ThingDef>',
        '<RecipeDef><defName>Part_', p_partkey, '</defName><jobString>Making ', p_name, '.</jobString><verb>true</verb></RecipeDef></Defs>')"""
    part = table(spark, sf_dir, "part")
    made = nested.definition_keys(part.select("p_partkey", F.expr(xml).alias("xml")), "p_partkey", "xml")
    labels = part.filter("p_partkey % 3 = 0").select(F.lit("ThingDefs").alias("type"), F.concat(F.lit("Part_"), "p_partkey", F.lit(".LABEL")).alias("key"))
    jobs = part.filter("p_partkey % 4 = 0").select(F.lit("recipedef ").alias("type"), F.concat(F.lit("Part_"), "p_partkey", F.lit(".jobstring")).alias("key"))
    return nested.not_authored(made, labels.unionByName(jobs))


_STORY = "translate(coalesce(text, ''), '<>[]&', '')"


@query(rf"""with d as (select doc_id, regexp_replace({_STORY}, '^[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{0B}}\x{{1C}}-\x{{1F}}]+|[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{0B}}\x{{1C}}-\x{{1F}}]+$', '', 'g') as t, source, lang from documents)
select doc_id, 0 as passage, 'Start ' || lang as name, 0 as token, 'text' as kind, md5(t) as digest from d where regexp_matches(t, '[a-zA-Zа-яА-Я]')
union all select doc_id, 0, 'Start ' || lang, 1, 'macro_str:0', md5('Press & go') from d union all select doc_id, 0, 'Start ' || lang, 3, 'link_label', md5('To ' || source) from d
union all select doc_id, 0, 'Start ' || lang, 6, 'text', md5(source) from d union all select doc_id, 2, 'End', 1, 'link_target', md5('Back <' || source || '>') from d""")
def story_passages(spark, sf_dir):
    """Whole texts as passages of stories, with macros, links, tags and passages of the system."""
    from corpusloom.functions.escapes import markup_encode
    from corpusloom.sources.passages import passage_strings

    docs = table(spark, sf_dir, "documents")
    body = F.concat(F.expr(_STORY), F.lit("<<link \"Press &amp; go\" '$x' \"12\">>"), F.lit("[[To "), "source", F.lit(" | Next]]<b>"), "source", F.lit("</b><style>p {x}</style><<set \"no\">>"))
    html = F.concat(F.lit('<html><tw-passagedata pid="1" name="Start '), "lang", F.lit('" tags="">'), markup_encode(body), F.lit('</tw-passagedata>\n<TW-passagedata pid="2" name="Code" tags="a script">var x;</tw-passagedata><tw-passagedata pid="3" name="End">[[ Back &amp;lt;'), "source", F.lit("&amp;gt; ]]</tw-passagedata><tw-passagedata pid=\"4\">no name</tw-passagedata></html>"))
    found = passage_strings(docs.select("doc_id", html.alias("html")), "doc_id", "html")
    return found.select("doc_id", "passage", "name", "token", "kind", F.md5("value").alias("digest"))
