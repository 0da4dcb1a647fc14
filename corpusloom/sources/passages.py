"""Passages of stories in markup: links, strings of macros and text, with the address of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.escapes import markup_decode
from corpusloom.functions.text import strip

# Shapes of passages and of what stands in them, macros whose strings are shown, tags and names of passages that hold no story.
PASSAGE = r"(?is)<tw-passagedata\s+[^>]*?>.*?</tw-passagedata>"
TOKEN = r"(?is)<style[^>]*?>.*?</style>|<script[^>]*?>.*?</script>|<<.*?>>|<[^>]*?>|\[\[[^\]]*?\]\]"
SHOWING_MACROS = ("button", "dialog", "link", "print", "notify", "append", "prepend", "replace")
SYSTEM_TAGS, SYSTEM_NAME = ("stylesheet", "script"), "StoryInit"
LETTER = "[a-zA-Zа-яА-Я]"


def _attribute(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf'{name}="([^"]*)"', 1)


def passage_strings(files: DataFrame, file: str, html: str) -> DataFrame:
    """(file, passage, token, kind, value): passage is the place among the file's passages, token that among the parts between and of markup, from 0.

    kind: text, link_label (the words of a link with a target), link_target (a link that is both) or macro_str:<n> (the n-th string of a macro that
    shows it). Entities are decoded once in a passage and once more in links and macros. Passages without a name and those of the system give nothing; other tags
    give nothing; what has no letter gives nothing.
    """
    found = files.select(F.col(file).alias("file"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(f"({PASSAGE})"), F.lit(1))).alias("passage", "raw"))
    header = F.regexp_extract("raw", r"(?is)^(<tw-passagedata\s+[^>]*?>)", 1)
    found = found.select("file", "passage", header.alias("header"), F.regexp_extract("raw", r"(?is)^<tw-passagedata\s+[^>]*?>(.*)</tw-passagedata>$", 1).alias("body"))
    tags, name = _attribute(F.col("header"), "tags"), _attribute(F.col("header"), "name")
    found = found.filter((name != "") & (name != SYSTEM_NAME) & ~tags.contains(SYSTEM_TAGS[0]) & ~tags.contains(SYSTEM_TAGS[1]))
    found = found.select("file", "passage", name.alias("name"), markup_decode(F.col("body")).alias("body"))
    texts = found.select("file", "passage", "name", F.posexplode(F.split("body", TOKEN, -1)).alias("at", "value"))
    texts = texts.select("file", "passage", "name", (2 * F.col("at")).alias("token"), F.lit("text").alias("kind"), strip(F.col("value")).alias("value"))
    marks = found.select("file", "passage", "name", F.posexplode(F.regexp_extract_all("body", F.lit(f"({TOKEN})"), F.lit(1))).alias("at", "raw"))
    marks = marks.select("file", "passage", "name", (2 * F.col("at") + 1).alias("token"), "raw", markup_decode(strip(F.substring("raw", F.lit(3), F.length("raw") - 4))).alias("inside"))
    inside = F.col("inside")
    labelled = F.when(inside.contains("|"), F.substring_index(inside, "|", 1)).when(inside.contains("->"), F.substring_index(inside, "->", 1)).when(inside.contains("<-"), F.regexp_extract(inside, "(?s)<-(.*)$", 1))
    links = marks.filter(F.col("raw").startswith("[[")).select("file", "passage", "name", "token", F.when(labelled.isNull(), "link_target").otherwise("link_label").alias("kind"), F.coalesce(strip(labelled), inside).alias("value"))
    macros = marks.filter(F.col("raw").startswith("<<") & F.col("raw").endswith(">>") & F.lower(F.regexp_extract(inside, r"(?s)^(\S+)", 1)).isin(*SHOWING_MACROS))
    macros = macros.select("file", "passage", "name", "token", F.posexplode(F.regexp_extract_all(inside, F.lit("""("[^"]*"|'[^']*')"""), F.lit(1))).alias("n", "quoted"))
    macros = macros.select("file", "passage", "name", "token", F.concat(F.lit("macro_str:"), "n").alias("kind"), strip(F.substring("quoted", F.lit(2), F.length("quoted") - 2)).alias("value")).filter(~F.col("value").startswith("$"))
    return texts.unionByName(links).unionByName(macros).filter(F.col("value").rlike(LETTER)).withColumnRenamed("file", file)
