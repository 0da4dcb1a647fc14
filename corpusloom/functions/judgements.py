"""Further decisions about strings, messages and replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.predicates import localised_text
from corpusloom.functions.text import SPACE, strip

# Names of properties that hold no text for people, in lower case.
TECHNICAL_PROPERTIES = ("strid", "commandname", "uniqueemittername", "developercomment", "sourcefilename", "ruleprefix", "icon file extension", "currentstartinglocation", "mapname", "keeplevel", "skyabove", "noroll", "waterbelow")
# The end of generated names.
GENERATED_END = r"_[0-9A-Fa-f]{16,}$"
# What on a line keeps its strings from being text; signs at either end of code; names of parameters and lists whose strings are shown.
SKIPPED_CONTEXTS = ("renpy.music", "renpy.sound", "renpy.image", "renpy.video", "renpy.display", "config", "define", "AudioURL", "im.Scale")
CODE_SIGNS = ",][)(=+-*%/;{}"
SHOWN_PARAMETERS = ("status_text", "label", "text", "message", "description", "title", "caption", "tooltip", "display_name", "bio", "name", "dialogue", "hint", "confirm", "question", "prompt", "button_text", "menu_item", "option")
SHOWN_LISTS = ("messages", "chat", "blog", "posts", "notifications", "log", "options", "choices", "buttons", "items", "menu", "replies", "tips", "hints", "descriptions", "names", "labels")
LIST_CALLS = ("append", "add", "insert", "extend")
# Findings that are no defects; marks of a blocked region, and of a bad key.
BENIGN_FINDING = r"(?i)could not evaluate .* in the who part|has not been given a parameter list|is not used|may not be reachable"
REGION_MARKS = ("location", "region", "country", "not available", "not supported", "unsupported", "geo", "blocked")
KEY_MARKS = ("invalid", "unauthor", "api key")
# Beginnings of text that is run, and cells that are names of columns.
RUN_BEGINNINGS = ("exec:", "goto:", "gs:", "xgt:")
CELL_NAMES = ("Name", "???")


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def technical_property(name: Column) -> Column:
    """Is a property one of the technical ones, or named by a generator? No name is not."""
    return F.coalesce(F.lower(name).isin(*TECHNICAL_PROPERTIES) | name.rlike(GENERATED_END), F.lit(False))


def identifier_like(c: Column) -> Column:
    """Without a blank, and with two points or more, or ending like a generated name."""
    t = strip(c)
    return ~t.contains(" ") & ((F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) >= 2) | t.rlike(GENERATED_END))


def property_text(name: Column, value: Column, reference: Column) -> Column:
    """Is a property's value text for people? reference: the value names an entry of a table of strings."""
    return ~F.coalesce(reference, F.lit(False)) & ~technical_property(name) & F.coalesce(localised_text(value), F.lit(False)) & ~identifier_like(value)


def coded_cell(c: Column) -> Column:
    """Numbers and tokens in braces between bars, perhaps with zero bytes at the end."""
    return F.regexp_replace(c, "\\x00+$", "").rlike(r"(?s)^(?:[0-9]*|\{[^|]*\})(?:\|(?:[0-9]*|\{[^|]*\}))+\z")


def cell_text(c: Column) -> Column:
    """Is there something besides tokens in braces and white space?"""
    return ~c.isin(*CELL_NAMES) & (F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}", ""), f"{SPACE}+", "") != "")


def prose(c: Column) -> Column:
    """A value that is compared or assigned and still is text: with a blank within, an inserted value, or a colon at the end."""
    return strip(c).contains(" ") | c.contains("<<") | F.regexp_replace(c, f"{SPACE}+$", "").endswith(":")


def runs_code(c: Column) -> Column:
    low = F.lower(strip(c))
    out = F.lit(False)
    for b in RUN_BEGINNINGS:
        out = out | low.startswith(b)
    return out


def never_shown(value: Column, line: Column) -> Column:
    """A string of code that can't be text: blank, with a slash, a colour, with a sign of code at either end, or on a line of a kind that shows none."""
    t = strip(value)
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    signs = list(CODE_SIGNS)
    return (t == "") | value.contains("/") | value.contains("\\") | t.rlike("^#[0-9a-fA-F]{3,8}$") | first.isin(*signs) | last.isin(*signs) | _contains_any(line, SKIPPED_CONTEXTS)


def always_shown(parameter: Column, function: Column, variable: Column) -> Column:
    """A string of code that is text by where it stands: a parameter that is shown, or what is put on a list whose name tells so."""
    put = F.coalesce(function, F.lit("")).isin(*LIST_CALLS) & _contains_any(F.coalesce(variable, F.lit("")), SHOWN_LISTS)
    return F.coalesce(parameter, F.lit("")).isin(*SHOWN_PARAMETERS) | put


def actionable(finding: Column) -> Column:
    return ~finding.rlike(BENIGN_FINDING)


def probe_class(status: Column, body: Column) -> Column:
    """What a server's answer tells: ok, geoblock, auth; any other answer is one, so ok."""
    b = F.lower(F.coalesce(body, F.lit("")))
    return F.when(status.between(200, 299), "ok").when(status.isin(403, 451) | _contains_any(b, REGION_MARKS), "geoblock").when(status.isin(401, 407) | _contains_any(b, KEY_MARKS), "auth").otherwise("ok")


def repetitive(c: Column, least: int = 6, share: float = 0.4) -> Column:
    """Six words or more, of which less than the share are different."""
    words = F.transform(F.array(F.filter(F.split(F.lower(strip(c)), f"{SPACE}+"), lambda w: w != "")), lambda ws: (F.size(ws) >= least) & (F.size(F.array_distinct(ws)) < F.size(ws) * share))
    return F.get(words, F.lit(0))


def request_delay(per_minute: Column, threads: Column) -> Column:
    """Seconds between a thread's requests, 0 without a limit."""
    return F.when(F.coalesce(per_minute, F.lit(0)) > 0, threads * 60 / per_minute).otherwise(0.0)
