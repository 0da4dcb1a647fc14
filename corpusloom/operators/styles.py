"""Sizes of widgets from what they say themselves and from the styles they may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_boxes(widgets: DataFrame, styles: DataFrame, key: str) -> DataFrame:
    """(key, width, height, box_style) of widgets whose width and height are both known.

    widgets: key, width, height, style, prefix; styles: style, width, height, one row a style; 0 and null are unknown. Width and height each
    come from the widget itself, else from its explicit style, else from <prefix>_button, else from <prefix>: the first that knows. box_style is the first of
    these styles that knows anything, looked for no further than needed: a widget that knows both itself looks at its first style only. All candidates of all widgets meet the styles in one join; the first is taken by partial minima.
    """
    known = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, c)
    names = F.array_compact(F.array(F.col("style"), F.concat("prefix", F.lit("_button")), F.col("prefix")))
    tried = widgets.select(key, F.posexplode(names).alias("rank", "name"))
    found = tried.join(styles.select(F.col("style").alias("name"), known(F.col("width")).alias("w"), known(F.col("height")).alias("h")).filter("w is not null or h is not null"), "name")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("rank")))
    best = found.groupBy(key).agg(first("w").alias("w"), first("h").alias("h"), F.min(F.struct("rank", "name")).alias("s"))
    out = widgets.select(key, known(F.col("width")).alias("own_w"), known(F.col("height")).alias("own_h")).join(best, key, "left")
    both: Column = F.col("own_w").isNotNull() & F.col("own_h").isNotNull()
    style = F.when(~both | (F.col("s.rank") == 0), F.col("s.name"))
    return out.select(key, F.coalesce("own_w", "w").alias("width"), F.coalesce("own_h", "h").alias("height"), style.alias("box_style")).filter("width is not null and height is not null")


def at_lines(rows: DataFrame, boxes: DataFrame, file: str, line: str) -> DataFrame:
    """rows with the box at their file and line, null where there is none; of several at one place the widest, then the highest."""
    best = boxes.groupBy(file, line).agg(F.max(F.struct("width", "height", "box_style")).alias("_b"))
    return rows.join(best, [file, line], "left").select(*rows.columns, "_b.width", "_b.height", "_b.box_style")
