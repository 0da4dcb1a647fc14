"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that a strip should remove, the no-break space and the separators 1C-1F included.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"
#: The same without the line feed, and with it, both spelled out for engines whose \s is narrower.
_OTHER = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}"
BLANK, SPACE_OR_LINE = rf"[\t\x0B\x0C\r {_OTHER}]", rf"[\t\n\x0B\x0C\r {_OTHER}]"
# Flags, widths and conversions of a format code; a percent sign without one is the second group.
PERCENT = r"(%(?:\([^)]*\))?[#0-8\- +hlL]*[diouxXeEfFgGcrs%])|(%)"
# Shapes of tokens that a translation must keep.
TOKENS = {
    "var": r"\[([^\]]+)\]",
    "tag": r"\{/?[a-zA-Z][^}]*\}",
    "fmt": r"%(?:%|\(\w+\)[diouxXeEfFgGcrs]|[-#0+]*\d*\.?\d*[hlL]?[diouxXeEfFgGcrs])",
}

# Budget arithmetic.
OVERHEAD_TOKENS, ITEM_TOKENS, CHARS_PER_TOKEN, MARGIN = 220, 12, 3, 0.92
OUTPUT_RATIO = {"russian": 1.5, "ukrainian": 1.5, "japanese": 1.6, "chinese (simplified)": 1.6, "chinese (traditional)": 1.6, "korean": 1.6}
DEFAULT_RATIO = 1.2


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def collapse(c: Column) -> Column:
    """White space runs as one blank, ends stripped."""
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def estimate_tokens(c: Column, chars_per_token: float | None = None) -> Column:
    n = F.length(c)
    each = F.floor(n / CHARS_PER_TOKEN) if chars_per_token is None else F.floor(n / F.lit(chars_per_token))
    return F.greatest(F.lit(1), each + 1).cast("bigint")


def output_ratio(language: Column) -> Column:
    found = F.lit(DEFAULT_RATIO)
    for name, ratio in OUTPUT_RATIO.items():
        found = F.when(F.lower(F.trim(language)) == name, F.lit(ratio)).otherwise(found)
    return found


def input_budget(window: Column, glossary_tokens: Column, ratio: Column, calibrated: bool = True) -> Column:
    room = (window - OVERHEAD_TOKENS - glossary_tokens) / (F.lit(1) + ratio)
    return F.greatest(F.lit(1), F.floor(room * MARGIN if calibrated else room)).cast("bigint")


def item_cost(text: Column, context: Column) -> Column:
    return estimate_tokens(text) + estimate_tokens(context) + ITEM_TOKENS


def tokens(c: Column, kind: str) -> Column:
    """Sorted placeholders of a kind: a multiset."""
    return F.sort_array(F.regexp_extract_all(c, F.lit(TOKENS[kind]), F.lit(0)))


def token_violations(original: Column, translated: Column) -> Column:
    """Kinds of placeholders whose multisets differ."""
    kinds = [F.when(~tokens(original, k).eqNullSafe(tokens(translated, k)), F.lit(k)) for k in TOKENS]
    return F.array_compact(F.array(*kinds))


# Code point ranges of scripts, in the order in which they are tried.
def script_of(c: Column) -> Column:
    """Writing system by the first range found, in a fixed order."""
    out = F.when(c.rlike(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"), "cjk")
    for name, span in (("arabic", r"[\x{0600}-\x{06FF}]"), ("hebrew", r"[\x{0590}-\x{05FF}]"), ("thai", r"[\x{0E00}-\x{0E7F}]"), ("devanagari", r"[\x{0900}-\x{097F}]"), ("cyrillic", r"[\x{0400}-\x{04FF}]")):
        out = out.when(c.rlike(span), name)
    return out.otherwise("latin")


def string_type(path: Column) -> Column:
    """Kind of a string by its address."""
    has = lambda x: F.array_contains(path, x)
    return F.when(has("say"), "dialogue").when(has("menu_choice"), "choice").when(has("uscore") | has("inline_python"), "code").when(F.get(path, F.lit(0)) == "screen", "interface").when(F.get(path, F.lit(0)) == "define", "character").otherwise("plain")


def without_prefix(c: Column, prefixes: tuple[str, ...], original: Column) -> Column:
    """Drops a leading label such as "translated:" unless the original begins with it too."""
    out = c
    for p in prefixes:
        begins = F.lower(F.substring(c, 1, len(p))) == p.lower()
        out = F.when(begins & (F.lower(F.substring(original, 1, len(p))) != p.lower()), F.ltrim(F.substring(c, len(p) + 1, 1 << 30))).otherwise(out)
    return out


def match_newlines(translated: Column, original: Column) -> Column:
    """Drops blank lines at the ends of a translation where the original has none there; a null original counts as empty."""
    source = F.coalesce(original, F.lit(""))
    ended = F.when(source.rlike(rf"\n{BLANK}*\z"), translated).otherwise(F.regexp_replace(translated, rf"\n{SPACE_OR_LINE}*\z", ""))
    return F.when(source.rlike(rf"^{BLANK}*(\n|\z)"), ended).otherwise(F.regexp_replace(ended, rf"^{SPACE_OR_LINE}*\n", ""))


def escape_percent(c: Column) -> Column:
    """Doubles each percent sign that begins no format code; codes and doubled signs stay, so a second run changes nothing."""
    return F.regexp_replace(c, PERCENT, "$1$2$2")


def path_leaf(c: Column) -> Column:
    """The last part of a path, with either slash."""
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def container(c: Column) -> Column:
    """The archive that a path such as archive!member lies in: what is before the first mark, or all of it."""
    return F.get(F.split(c, "!", 2), F.lit(0))


def has_segment(c: Column, known: list[str]) -> Column:
    """Is one of the path's parts a known folder?"""
    return F.arrays_overlap(F.split(F.lower(c), "/"), F.array(*[F.lit(k.lower()) for k in known]))
