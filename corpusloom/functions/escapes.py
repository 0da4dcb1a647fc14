"""Families of escapes as column expressions: what a literal stands for, and how a text is written as one.

Decoding cuts a literal into escapes and stretches without a backslash, turns each escape into what it stands for and joins them, so
every character is looked at once, in order. A lone backslash at the end stays. Escapes of a UTF-16 surrogate stay as they are, since no
text can hold one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BACKSLASH = "\\"
# What follows the backslash and what it stands for; None keeps the escape, other letters stand for themselves.
_CONTROL = {"n": "\n", "t": "\t", "r": "\r"}


def _character(hexadecimal: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hexadecimal, 4, "0")), "UTF-16BE")


def _decoded(c: Column, digits: str, known: dict[str, str], any_line: bool, bare_u: Column | None) -> Column:
    """digits: how many hexadecimal ones follow \\u (a quantifier, or empty); any_line: may a line feed be escaped; bare_u: what \\u without digits stands for."""
    code = rf"u[0-9a-fA-F]{digits}|" if digits else ""
    dot = "[\\s\\S]" if any_line else "[^\\n]"
    tokens = F.regexp_extract_all(c, F.lit(rf"\\(?:{code}{dot})|[^\\]+|\\"), F.lit(0))

    def value(token: Column) -> Column:
        second = F.substring(token, 2, 1)
        out = F.when(~token.startswith(_BACKSLASH) | (F.length(token) == 1), token)
        if digits:
            number = F.substring(token, 3, 4)
            out = out.when((F.length(token) > 2) & ~number.rlike("^[dD][89a-fA-F]"), _character(number)).when(F.length(token) > 2, token)
            if bare_u is not None:
                out = out.when(second == "u", bare_u)
        for letter, stands in known.items():
            out = out.when(second == letter, F.lit(stands))
        return out.otherwise(second)

    return F.array_join(F.transform(tokens, value), "")


def written_decode(c: Column) -> Column:
    r"""Of a stored result before it is written: \n \t \r, \u with four digits; \u without them stays."""
    return _decoded(c, "{4}", _CONTROL, False, F.lit("\\u"))


def settings_decode(c: Column) -> Column:
    r"""Of a value in sectioned settings: as written_decode, but \u without four digits stands for u."""
    return _decoded(c, "{4}", _CONTROL, False, None)


def code_decode(c: Column) -> Column:
    r"""Of a program's literal between its quotes: \n \t \r \0, any other character (a line feed too) for itself."""
    return _decoded(c, "", _CONTROL | {"0": "\0"}, True, None)


def verbatim_decode(c: Column) -> Column:
    return F.replace(c, F.lit('""'), F.lit('"'))


def script_decode(c: Column, collapse: bool = True) -> Column:
    r"""Of a script's string: runs of blanks and line feeds are one blank (if collapse), \{ \[ \% double, \n, \u with up to four digits; \u without any is nothing."""
    c = F.regexp_replace(c, "[ \n]+", " ") if collapse else c
    return _decoded(c, "{1,4}", {"{": "{{", "[": "[[", "%": "%%", "n": "\n"}, False, F.lit(""))


def _encoded(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """The backslash must come first."""
    for plain, escape in pairs:
        c = F.replace(c, F.lit(plain), F.lit(escape))
    return c


_LINES = [("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")]


def code_encode(c: Column) -> Column:
    return F.concat(F.lit('"'), _encoded(c, [*_LINES, ('"', '\\"'), ("\0", "\\0")]), F.lit('"'))


def verbatim_encode(c: Column) -> Column:
    return F.concat(F.lit('@"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def settings_encode(c: Column, quote: str = '"') -> Column:
    """For a value between quotes of the kind given."""
    return _encoded(c, [*_LINES, (quote, "\\" + quote)])


def field_encode(c: Column, escaped_delimiter: bool) -> Column:
    """For a field of a struct: where the delimiter itself is an escaped quote, quotes stay bare and apostrophes are escaped."""
    return settings_encode(c, "'" if escaped_delimiter else '"')


def wrapped(c: Column) -> Column:
    """Is a value, but for space around it, wrapped in escaped quotes?"""
    t = F.trim(c)
    return (F.length(t) >= 4) & t.startswith('\\"') & t.endswith('\\"')


def unwrapped(c: Column) -> Column:
    t = F.trim(c)
    return F.when(wrapped(c), settings_decode(F.substring(t, F.lit(3), F.greatest(F.length(t) - 4, F.lit(0))))).otherwise(c)


def rewrapped(c: Column) -> Column:
    return F.concat(F.lit('\\"'), field_encode(c, True), F.lit('\\"'))


def say_encode(c: Column) -> Column:
    """A spoken line as a script's string: the second of two blanks is escaped, so that it survives the reading."""
    return F.concat(F.lit('"'), F.regexp_replace(_encoded(c, [("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')]), "(?<= ) ", "\\\\ "), F.lit('"'))


def entry_encode(c: Column) -> Column:
    """As say_encode, blanks as they are."""
    return F.concat(F.lit('"'), _encoded(c, [("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')]), F.lit('"'))


def markup_encode(c: Column) -> Column:
    """Text as content or attribute of markup."""
    return _encoded(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def inner(c: Column, before: int = 1, after: int = 1) -> Column:
    """What is between a literal's delimiters of so many characters."""
    return F.substring(c, F.lit(before + 1), F.greatest(F.length(c) - before - after, F.lit(0)))


# Named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def markup_decode(c: Column) -> Column:
    """Numbered entities, and the most usual named ones; others stay. Each is looked at once, so &amp;lt; is &lt; after it."""
    tokens = F.regexp_extract_all(c, F.lit(r"(&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z]+);|[^&]+|&)"), F.lit(1))

    def value(token: Column) -> Column:
        digits = F.when(token.rlike("^&#[xX]"), F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+);", 1)).when(token.rlike("^&#"), F.hex(F.regexp_extract(token, "^&#([0-9]+);", 1).try_cast("bigint")))
        code = F.conv(digits, 16, 10).cast("bigint")
        legal = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        out = F.when(~token.rlike("^&.+;$"), token).when(digits.isNotNull() & legal, F.decode(F.unhex(F.lpad(F.hex(F.when(legal, code).otherwise(32)), 8, "0")), "UTF-32"))
        for name, stands in ENTITIES.items():
            out = out.when(token == f"&{name};", F.lit(stands))
        return out.otherwise(token)

    return F.array_join(F.transform(tokens, value), "")
