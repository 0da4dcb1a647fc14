"""Stable identifiers: 32-bit FNV-1a over code points, as a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
OFFSET, PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a32(text: Column) -> Column:
    """The hash of a text's code points as 8 lower-case hex digits; null for null."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(OFFSET).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * PRIME).bitwiseAND(MASK))
    empty = F.lit(OFFSET).cast("bigint")
    return F.lower(F.lpad(F.hex(F.when(text == "", empty).otherwise(h)), 8, "0"))


def stable_id(engine: Column, file: Column, path: Column, original: Column) -> Column:
    """Identifier of a string by its source kind, file, address (array of strings) and text; the context is no part of it."""
    key = F.concat(engine, F.lit("\0"), file, F.lit("\0"), F.array_join(path, "\x01"), F.lit("\0"), original)
    return fnv1a32(key)
