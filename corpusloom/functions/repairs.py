"""Repairs of results before they are written into a script, in the order in which they must run."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.escapes import written_decode
from corpusloom.functions.text import escape_percent, match_newlines


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first(items: Column, good: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, good), F.lit(0))


def _step(a: Column, t: Column) -> Column:
    """The state after tag or stretch t: the pieces put out, the stack of open names, and names closed early with how often."""

    def state(piece: Column | None, stack: Column = a["stack"], early: Column = a["early"]) -> Column:
        return F.struct((a["out"] if piece is None else F.array_append(a["out"], piece)).alias("out"), stack.alias("stack"), early.alias("early"))

    def begun(name: Column) -> Column:
        return (name != "") & F.startswith(t["name"], name)

    def adjusted(early: Column, name: Column, by: int) -> Column:
        return F.transform(early, lambda y: F.struct(y["k"].alias("k"), (y["n"] + F.when(y["k"] == name, by).otherwise(0)).alias("n")))

    def noted(early: Column, name: Column) -> Column:
        return F.when(F.exists(early, lambda y: y["k"] == name), adjusted(early, name, 1)).otherwise(F.array_append(early, F.struct(name.alias("k"), F.lit(1).alias("n"))))

    def closed(r: Column, g: Column) -> Column:
        at = F.array_position(r, g).cast("int")
        above = lambda body: _let(F.slice(r, 1, at - 1), body)
        mended = F.when(g == t["name"], t["raw"]).otherwise(F.concat(F.lit("{/"), g, F.lit("}")))
        piece = lambda m: F.concat(F.array_join(F.transform(m, lambda x: F.concat(F.lit("{/"), x, F.lit("}"))), ""), mended)
        return above(lambda m: state(piece(m), F.slice(a["stack"], 1, F.size(a["stack"]) - at), F.aggregate(m, a["early"], noted)))

    def unmatched() -> Column:
        late = F.coalesce(_first(a["early"], lambda y: (y["n"] > 0) & (y["k"] == t["name"]))["k"], _first(a["early"], lambda y: (y["n"] > 0) & begun(y["k"]))["k"])
        return _let(late, lambda h: F.when(h.isNull(), state(t["raw"])).otherwise(state(None, early=adjusted(a["early"], h, -1))))

    def close(r: Column) -> Column:
        top = F.get(r, F.lit(0))
        target = F.when(top == t["name"], top).when(begun(top), top).when(F.array_contains(r, t["name"]), t["name"]).otherwise(_first(r, begun))
        return _let(target, lambda g: F.when(g.isNotNull(), closed(r, g)).otherwise(unmatched()))

    popped = F.slice(a["stack"], 1, F.greatest(F.size(a["stack"]) - 1, F.lit(0)))
    out = F.when(t["kind"] == "text", state(t["raw"])).when(t["kind"] == "open", state(t["raw"], F.array_append(a["stack"], t["name"])))
    return out.when(t["name"] == "", state(t["raw"], popped)).otherwise(_let(F.reverse(a["stack"]), close))


def repair_tags(c: Column) -> Column:
    """Closing tags that match no open one are mended; what can't be told stays as it is. A second run changes nothing.

    One fold over the text's tags with the stack of open names. A closing tag closes the top if it has its name, or begins with it (then
    the rest is dropped); else the nearest open tag of its name, or one that its name begins with, and those above it are closed first and noted, so that their own
    closing tags, which then come too late, leave. The pieces of a text with t tags are appended one by one: t squared steps of
    a pointer each.
    """
    tokens = F.regexp_extract_all(c, F.lit(r"(\{[^{}]*\}|[^{]+|\{)"), F.lit(1))
    name = lambda x: F.trim(F.substring_index(F.regexp_replace(x, r"^\{/?|\}$", ""), "=", 1))
    kind = lambda x: F.when(~x.rlike(r"^\{[^{}]*\}\z"), "text").when(x.startswith("{/"), "close").otherwise("open")
    marked = F.transform(tokens, lambda x: F.struct(x.alias("raw"), kind(x).alias("kind"), name(x).alias("name")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<k: string, n: int>>").alias("early"))
    return F.when(c.contains("{"), F.array_join(F.aggregate(marked, start, _step)["out"], "")).otherwise(c)


def _doubled(text: str) -> str:
    """Brackets whose content is no expression of the script's language are doubled."""
    out, i = [], 0
    while i < len(text):
        at = text.find("[", i)
        if at < 0:
            break
        out.append(text[i:at])
        if text.startswith("[[", at):
            out.append("[[")
            i = at + 2
            continue
        depth, end = 1, at + 1
        while end < len(text) and depth:
            step = 2 if text.startswith("[[", end) else 1
            depth += {"[": 1, "]": -1}.get(text[end], 0) if step == 1 else 0
            end += step
        if depth:
            out.append("[")
            i = at + 1
            continue
        inside = text[at + 1 : end - 1]
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(inside, "<string>", "eval")
            out.append(text[at:end])
        except (SyntaxError, ValueError, MemoryError, RecursionError, OverflowError):
            out.append(f"[[{inside}]")
        i = end
    return "".join(out) + text[i:]


@F.pandas_udf(StringType())
def _double_brackets(texts: pd.Series) -> pd.Series:
    return texts.map(_doubled, na_action="ignore")


def double_brackets(c: Column) -> Column:
    """Only Python can tell what one of its expressions is, so texts with a bracket go through a pandas function; nothing is run."""
    return F.coalesce(_double_brackets(F.when(c.contains("["), c)), c)


def repaired(rows: DataFrame, translated: str, original: str) -> DataFrame:
    """rows with the results of a column mended: escapes decoded, then percent signs, tags, blank lines at the ends (against the original), brackets.

    Each repair is a step of its own and sees what the ones before it leave; as one expression, texts would be worked out again for each time that they are named.
    """
    source = "_decoded original"
    rows = rows.withColumn(source, written_decode(F.col(original)))
    for step in (written_decode, escape_percent, repair_tags, lambda c: match_newlines(c, F.col(f"`{source}`")), double_brackets):
        rows = rows.withColumn(translated, step(F.col(translated)))
    return rows.drop(source)
