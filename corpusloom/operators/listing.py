"""Lists of rows as people see them: filters that pinned rows pass, stable orders, pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def by_status(translated: Column, status: str) -> Column:
    """status: all, translated, untranslated; a blank result is none."""
    done = strip(F.coalesce(translated, F.lit(""))) != ""
    return {"all": F.lit(True), "translated": done, "untranslated": ~done}[status]


def by_kind(path: Column, kind: str) -> Column:
    """kind: all, regular, python (strings of code), none."""
    code = F.coalesce(F.array_contains(path, "uscore"), F.lit(False))
    return {"all": F.lit(True), "regular": ~code, "python": code, "none": F.lit(False)}[kind]


def by_search(needle: str, original: Column, translated: Column, path: Column, mode: str = "all") -> Column:
    """Does the needle stand, whatever its case, in the text that the mode looks at: original (and address), translation, all, none."""
    if not needle:
        return F.lit(True)
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
    place = F.array_join(F.coalesce(path, F.array().cast("array<string>")), " ")
    return {"original": has(original) | has(place), "translation": has(translated), "all": has(original) | has(translated) | has(place), "none": F.lit(False)}[mode]


def by_scope(path: Column, units: Iterable[str], hidden: Iterable[str] = ()) -> Column:
    """Is the path one of the units or in one (after a slash, or in its archive after an exclamation mark) and in none of the hidden ones? Slashes and case don't matter."""
    norm = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/"))

    def within(names: Iterable[str]) -> Column:
        out = F.lit(False)
        for name in names:
            low = "/".join(name.replace("\\", "/").lower().split("//"))
            out = out | (norm == low) | norm.startswith(low + "/") | norm.startswith(low + "!")
        return out

    return within(units) & ~within(hidden)


def selected(merged: DataFrame, key: str, chosen: DataFrame | None = None, scope: Column | None = None) -> DataFrame:
    """Rows to work on: those of a list of keys, if there is one, whatever their state; else those without approval and result, in scope."""
    if chosen is not None:
        return merged.join(chosen.select(key).distinct(), key, "left_semi")
    todo = ~F.coalesce(F.col("approved"), F.lit(False)) & by_status(F.col("translated"), "untranslated")
    return merged.filter(todo if scope is None else todo & scope)


def listed(rows: DataFrame, key: str, keep: Column, order: list[Column], pinned: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """(rows that keep lets through, and pinned ones in any case, with a column pinned; their order: pinned ones first, then as given)."""
    if pinned is None:
        marked = rows.withColumn("pinned", F.lit(False))
    else:
        marked = rows.join(pinned.select(key, F.lit(True).alias("pinned")).distinct(), key, "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return marked.filter(F.col("pinned") | keep), [F.desc("pinned"), *order]


def page(rows: DataFrame, order: list[Column], number: int, size: int = 500) -> DataFrame:
    """Page `number`, from 0, of the rows in order; a number beyond the ends is the first or last page. One job counts, one takes the first rows of each task."""
    pages = max(1, -(-rows.count() // size))
    number = min(max(number, 0), pages - 1)
    return rows.orderBy(*order).offset(number * size).limit(size)
