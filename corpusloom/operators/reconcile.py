"""Rows against a memory of earlier results: outer, anti and semi joins on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_strings(strings: DataFrame, memory: DataFrame, key: str = "id") -> DataFrame:
    """Left join: rows gone from strings leave the memory, new rows come with empty results."""
    m = memory.select(key, "translated", "approved")
    return strings.join(m, key, "left").withColumn("translated", F.coalesce("translated", F.lit(""))).withColumn("approved", F.coalesce("approved", F.lit(False)))


def pending(merged: DataFrame) -> DataFrame:
    return merged.filter(~F.col("approved") & (F.col("translated") == ""))


def merge_translations(memory: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Upsert: fresh (key, original, translated) over memory (key, original, translated, approved); the old original and approval stay."""
    m = memory.select(key, F.col("original").alias("mo"), F.col("translated").alias("mt"), F.col("approved").alias("ma"))
    f = fresh.select(key, F.col("original").alias("fo"), F.col("translated").alias("ft"))
    return m.join(f, key, "full").select(key, F.coalesce("mo", "fo", F.lit("")).alias("original"), F.coalesce("ft", "mt").alias("translated"), F.coalesce("ma", F.lit(False)).alias("approved"))


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(have.select(*keys), keys, "left_anti")


def representatives(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Distinct keys with their first identifier and their number of rows; partial sums before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("members"))


def fan_out(rows: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results of representatives for all members."""
    return rows.join(results, keys)


def priority_union(*sources: DataFrame, key: str) -> DataFrame:
    """For each key the row of the first source that has it."""
    union = None
    for rank, s in enumerate(sources):
        part = s.withColumn("priority", F.lit(rank))
        union = part if union is None else union.unionByName(part)
    others = [c for c in union.columns if c != key]
    return union.groupBy(key).agg(F.min(F.struct("priority", *[c for c in others if c != "priority"])).alias("r")).select(key, "r.*")


def cache_split(units: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Units with the cached value where all keys agree, and whether they hit."""
    c = cache.select(*keys, F.col(value).alias("cached"))
    return units.join(c, keys, "left").withColumn("hit", F.col("cached").isNotNull())


def assign_unit(rows: DataFrame, path: str, units: DataFrame, unit: str, separator: str = "/") -> DataFrame:
    """The longest unit that is the path or a prefix of it up to a separator: path prefixes exploded, then an equi-join."""
    parts = F.split(F.lower(F.col(path)), separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    exploded = rows.withColumn("_prefix", F.explode(prefixes))
    matched = exploded.join(units.select(F.col(unit).alias("_unit")).distinct(), F.col("_prefix") == F.lower("_unit"))
    keys = rows.columns
    return matched.groupBy(*keys).agg(F.max_by("_unit", F.struct(F.length("_unit"), F.col("_unit"))).alias("unit"))


def reply_results(wanted: DataFrame, replies: DataFrame, pos: str, key: str = "id", value: str = "text") -> DataFrame:
    """Wanted keys with what the replies say: identifiers are trimmed and lower-cased, blank values dropped, the last one wins."""
    clean = replies.filter(F.trim(F.coalesce(value, F.lit(""))) != "").select(F.lower(F.trim(F.col(key).cast("string"))).alias(key), pos, value)
    last = clean.groupBy(key).agg(F.max_by(value, pos).alias(value))
    return wanted.join(last, key)


def unless_loose(loose: DataFrame, packed: DataFrame, unit: str) -> DataFrame:
    """Loose rows, and the packed ones of units that have no loose row."""
    return loose.unionByName(packed.join(loose.select(unit).distinct(), unit, "left_anti"))


def first_known(candidates: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str = "value") -> DataFrame:
    """candidates with the value of the first source that knows the key (not null, not blank) and the source's name; both null where none does.

    All sources meet the candidates in one join on the key, not in one each.
    """
    every = None
    for rank, (name, source) in enumerate(sources):
        part = source.filter(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "").select(key, F.struct(F.lit(rank).alias("rank"), F.col(value).alias("value"), F.lit(name).alias("source")).alias("r"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(key).agg(F.min("r").alias("r"))
    return candidates.join(best, key, "left").select(*candidates.columns, F.col("r.value").alias(value), F.col("r.source").alias("source"))


def not_curated(generated: DataFrame, curated: DataFrame, keys: list[str]) -> DataFrame:
    """Generated rows whose whole key, upper and lower case told apart, no curated row has; of generated rows with equal keys and texts one stays."""
    return generated.dropDuplicates().join(curated.select(*keys), keys, "left_anti")


def speakers(lines: DataFrame, names: DataFrame, variable: str, narrator: str = "narrator") -> DataFrame:
    """lines with the name of who speaks: by the variable before the line, the variable itself where it has no name, the narrator without one."""
    known = names.select(F.col(variable).alias("_v"), F.col("name").alias("_name")).groupBy("_v").agg(F.min("_name").alias("_name"))
    joined = lines.join(known, F.col(variable) == F.col("_v"), "left")
    return joined.withColumn("speaker", F.when(F.coalesce(variable, F.lit("")) == "", F.lit(narrator)).otherwise(F.coalesce("_name", variable))).drop("_v", "_name")
