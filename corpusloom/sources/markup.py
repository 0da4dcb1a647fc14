"""Scans of marked-up and semi-structured text into rows, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One token: a style or script element, a macro, a tag, a link, or the text up to the next of these.
# Shapes of markup, in the order in which they are tried.
MARKUP = r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<<.*?>>|<[^>]*>|\[\[[^\]]*\]\]|[^<\[]+|[<\[]"


def markup_tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, kind, token) of each token that isn't a tag and has a letter."""
    t = rows.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(MARKUP), F.lit(0))).alias("pos", "raw"))
    kind = F.when(F.col("raw").startswith("[["), "link").when(F.col("raw").startswith("<<"), "macro").when(F.col("raw").startswith("<"), "tag").otherwise("text")
    t = t.select(id_col, "pos", kind.alias("kind"), F.regexp_replace("raw", r"^\[\[|\]\]$", "").alias("token"))
    return t.filter((F.col("kind") != "tag") & F.col("token").rlike("[a-zA-Zа-яА-Я]")).withColumn("token", F.trim(F.regexp_replace("token", r"[\s]+", " ")))


def map_leaves(json: Column) -> Column:
    """Keys and values of a flat JSON object."""
    return F.map_entries(F.from_json(json, "map<string,string>"))


def event_commands(files: DataFrame) -> DataFrame:
    """Text of nested JSON events (events, pages, list): codes 401 and 405 are lines, 102 lists of choices.

    files: file, json. Rows: file, path (array), original.
    """
    schema = "struct<events:array<struct<pages:array<struct<list:array<struct<code:int,parameters:array<string>>>>>>>>"
    x = files.select("file", F.from_json("json", schema).alias("j"))
    x = x.select("file", F.posexplode("j.events").alias("e", "event")).select("file", "e", F.posexplode("event.pages").alias("p", "page"))
    x = x.select("file", "e", "p", F.posexplode("page.list").alias("k", "cmd"))
    first = F.get("cmd.parameters", F.lit(0))
    where = [F.lit("events"), F.col("e").cast("string"), F.lit("pages"), F.col("p").cast("string"), F.lit("list"), F.col("k").cast("string"), F.lit("parameters"), F.lit("0")]
    lines = x.filter(F.col("cmd.code").isin(401, 405)).select("file", F.array(*where).alias("path"), first.alias("original"))
    choices = x.filter(F.col("cmd.code") == 102).select("file", F.array(*where).alias("base"), F.posexplode(F.from_json(first, "array<string>")).alias("c", "original"))
    choices = choices.select("file", F.concat("base", F.array(F.col("c").cast("string"))).alias("path"), "original")
    return lines.unionByName(choices).filter(F.trim(F.coalesce("original", F.lit(""))) != "")


def sectioned_settings(lines: DataFrame, file: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """key=value lines of INI-like files with the section each stands in. Rows: file, pos, section, key, value."""
    from corpusloom.operators.ordered import carry_forward

    head = F.when(F.trim(line).rlike(r"^\[.*\]$"), F.regexp_extract(F.trim(line), r"^\[(.*)\]$", 1))
    x = lines.withColumn("section", carry_forward(head, [file], [pos])).filter(F.col(line).contains("=") & ~F.trim(line).rlike("^(\\[.*\\]|;.*|//.*)$"))
    parts = F.split(F.col(line), "=", 2)
    return x.select(file, pos, "section", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
