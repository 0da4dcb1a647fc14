"""Nested JSON and XML against plain recursion."""

import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from corpusloom.sources import nested


def strings(d, path=()):
    for k, v in d.items():
        if isinstance(v, dict):
            yield from strings(v, (*path, k))
        elif isinstance(v, str):
            yield (*path, k), v


JSON = {
    "plain": '{"a": "x", "b": {"c": {"d": "deep", "n": 1}, "l": ["no"], "e": {}}, "t": true, "z": null, "2024": "2024-01-01"}',
    "comments": '{ // first "quoted" { \n "a": "http://x//y /* no */", /* "b": "gone" , */ "c": {"d": "1",}, "e": "q\\"//\\\\", }// end',
    "escapes": json.dumps({"a": {"b": 'q"uo\\te // \n /* x */ é😀'}}),
    "list": '["a"]',
    "bad": '{"a": ',
    "open comment": '{"a": "b"} /* and so on',
    "empty": "",
    "two": '{"a": "b"} {"c": "d"}',
    "two more": '{"a": "b"}, {"c": "d"}',
    "deep": '{"k": ' * 30 + '"end"' + "}" * 30,
}


def test_json(spark):
    want = {
        "comments": [(("a",), "http://x//y /* no */"), (("c", "d"), "1"), (("e",), 'q"//\\')],
        "open comment": [(("a",), "b")],
    } | {k: list(strings(json.loads(JSON[k]))) for k in ("plain", "escapes", "deep")}
    d = spark.createDataFrame([*JSON.items(), ("null", None)], "key string, text string")
    got = nested.flatten_json(d, "key", "text")
    assert got.columns == ["key", "path", "value"]
    assert sorted((r.key, tuple(r.path), r.value) for r in got.collect()) == sorted((k, p, v) for k, rows in want.items() for p, v in rows)
    assert nested.flatten_json(d.filter("false"), "key", "text").count() == 0


XML = {
    "things": """<Defs><!-- c -->
<ThingDef Abstract="True"><defName>Base</defName><label>never</label></ThingDef>
<ThingDef><label>no name</label></ThingDef>
<ThingDef ParentName="Base"><defName> Lamp </defName><label>a lamp</label><description>Lights up.\nTwo lines</description><texPath>x/y</texPath><labelPlural>12</labelPlural>
 <stages><li><label>first</label><deep><tip>inner tip</tip></deep></li><li>plain no field</li><li><label Class="x">second</label></li></stages>
 <tip><li>one tip</li><li>[symbol]</li><li>rule->x</li><li>four</li></tip><comps><li Class="y"><useLabel>use me</useLabel></li></comps>
 <graphic><color>red</color><verb>shine</verb></graphic></ThingDef></Defs>""",
    "one": "<Defs><RecipeDef><defName>R</defName><jobString>Doing it.</jobString><label>true</label><verb>  spaced </verb></RecipeDef></Defs>",
    "none": "<Defs></Defs>",
}


def leaves(el, path):
    for child in el:
        if child.tag == "defName":
            continue
        items = [c for c in child if c.tag == "li"]
        if items:
            for i, li in enumerate(items):
                if len(li):
                    yield from leaves(li, (*path, child.tag, str(i)))
                elif child.tag in nested.DEFINITION_FIELDS:
                    yield (*path, child.tag, str(i)), li.text
        elif len(child):
            yield from leaves(child, (*path, child.tag))
        elif child.tag in nested.DEFINITION_FIELDS:
            yield (*path, child.tag), child.text


def shown(t):
    t = (t or "").strip()
    return bool(t) and t.lower() not in ("true", "false") and not re.fullmatch(r"-?\d+(\.\d+)?|\[[^\]]+\]|\([^)]*\)", t) and "->" not in t


def test_xml(spark):
    want = []
    for name, text in XML.items():
        for el in ET.fromstring(text):
            title = (el.findtext("defName") or "").strip()
            if title and el.get("Abstract", "").lower() != "true":
                want += [(name, el.tag, ".".join((title, *p)), v) for p, v in leaves(el, ()) if shown(v)]
    d = spark.createDataFrame([*XML.items(), ("null", None)], "file string, xml string")
    got = nested.definition_keys(d, "file", "xml")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 11
    assert nested.definition_keys(d.filter("false"), "file", "xml").count() == 0


def test_authored_keys(spark):
    made = spark.createDataFrame([("ThingDef", "Seal.label"), ("RecipeDef", "Seal.label"), ("ThingDef", "seal.label"), ("ThingDef", "Bag.jobString.0"), ("X", "plain")], "type string, key string")
    have = spark.createDataFrame([(" ThingDefs", "Seal.LABEL"), ("thingdef", "Bag.jobstring.0"), ("Xs", "plain"), ("ThingDef", None)], "type string, key string")
    assert sorted(map(tuple, nested.not_authored(made, have).collect())) == [("RecipeDef", "Seal.label"), ("ThingDef", "seal.label"), ("X", "plain")]


def test_files_of_a_small_table_are_dealt_out(spark, monkeypatch):
    tasks, write = {}, nested.written
    monkeypatch.setattr(nested, "written", lambda df, name: tasks.setdefault(name, df.rdd.getNumPartitions()) and write(df, name))
    d = spark.range(0, 40, 1, 1).select(F.col("id").alias("file"), F.concat(F.lit("<Defs><A><defName>D"), "id", F.lit("</defName><label>some words</label></A></Defs>")).alias("xml"))
    assert sorted(tuple(r) for r in nested.definition_keys(d, "file", "xml").collect()) == [(i, "A", f"D{i}.label", "some words") for i in range(40)]
    assert tasks["xml"] == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
