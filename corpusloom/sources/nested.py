"""Files of nested objects (JSON with comments, XML definitions) as one row per text, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.predicates import definition_text
from corpusloom.storage import written

_PATH = "array<string>"


def strip_json(c: Column) -> Column:
    """Without // and /* */ comments that stand outside strings, and without commas before a closing bracket.

    One pass: at each place a string is kept whole, a comment dropped. A comment without an end goes to the end of the text.
    """
    bare = F.regexp_replace(c, r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*|/\*.*?(?:\*/|\z)', "$1")
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")


def whole_json(c: Column) -> Column:
    """A text that is one JSON value as a variant, null for others: the parser stops after the first value, but not within brackets of our own."""
    listed = F.transform(F.array(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))), lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))
    return F.get(listed, F.lit(0))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING or another kind of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _entries(level: DataFrame, name: str) -> DataFrame:
    """The entries of each row's v, as its other columns and key, value, kind; written, as what follows reads them more than once."""
    each = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).drop("v", "pos")
    return written(each.withColumn("kind", _kind(F.col("value"))), name)


def flatten_json(files: DataFrame, file: str, text: str) -> DataFrame:
    """(file, path, value) of every string that objects hold, however deep; lists, numbers and texts that are no JSON object give nothing.

    Each level of nesting is one step that splits the objects of the level before into strings and further objects; the steps end when no object
    is left. An object may not name a key twice, unless spark.sql.variant.allowDuplicateKeys is set (then the last one counts).
    """
    level = files.select(F.col(file).alias("file"), F.array().cast(_PATH).alias("path"), whole_json(strip_json(F.col(text))).alias("v"))
    level, out = written(level, "json").filter(_kind(F.col("v")) == "OBJECT"), None
    while True:
        each = _entries(level, "json-level").withColumn("path", F.concat("path", F.array("key")))
        texts = each.filter("kind = 'STRING'").select(F.col("file").alias(file), "path", F.variant_get("value", "$", "string").alias("value"))
        out = texts if out is None else out.unionByName(texts)
        level = each.filter("kind = 'OBJECT'").select("file", "path", F.col("value").alias("v"))
        if level.isEmpty():
            return out


# Fields of definitions that people read.
DEFINITION_FIELDS = (
    "label", "description", "reportString", "jobString", "verb", "gerund", "tip", "jobReportString", "labelNoun", "helpText", "GizmoLabel",
    "ResearchLabel", "ResearchDesc", "ResearchDescDisc", "groupingLabel", "stuffAdjective", "labelPlural", "useLabel", "headerTip",
    "letterText", "letterLabel", "labelSocial", "labelFemale", "labelMale", "labelFemalePlural", "labelMalePlural", "ingestCommandString",
    "ingestReportString", "deathMessage", "fixedName", "pawnLabel", "baseInspectLine", "customLabel", "labelShort", "skillLabel", "summary",
    "title", "beginLetterLabel", "beginLetter", "endMessage", "recoveryMessage", "deflationMessage", "calledOffMessage", "gerundLabel",
    "pawnsPlural", "pawnLabelPlural", "successfullyRemovedHediffMessage", "StepLabel", "StepDesc", "ProjTypeLabel", "useLabelNoun",
    "ritualExplanation", "extraTooltip", "overrideLabel", "labelTip", "onMapInstruction", "approachOrderString", "approachingReportString",
    "spectatorsLabel", "spectateLeadJobString",
)


def definition_keys(files: DataFrame, file: str, xml: str, fields: tuple[str, ...] = DEFINITION_FIELDS) -> DataFrame:
    """(file, type, key, value) of the texts of XML definitions, key being name.field.path with numbers for list items.

    A file's root holds definitions. Abstract ones and those without a defName give nothing. Of each element: the items (li) of a list
    are numbered in order, plain ones count if the list is a known field, others are gone through; of elements beside items nothing is taken; a leaf
    counts if its tag is a known field; only values that people read count. As for JSON, each level is a step. Files that are no XML give nothing.
    """
    options = {"valueTag": "_value", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
    # a small table is one task's, however long its XML takes, so files are dealt out first; written, as a filter on what is read would read it once more
    spread = files.filter(F.col(xml).isNotNull()).select(file, xml).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), file)
    root = written(spread.select(F.col(file).alias("file"), F.from_xml(F.col(xml), "variant", options).alias("v")), "xml").filter(_kind(F.col("v")) == "OBJECT")
    found = _repeated(_entries(root, "xml-types"))
    name = F.trim(F.try_variant_get("value", "$.defName", "string"))
    abstract = F.lower(F.trim(F.coalesce(F.try_variant_get("value", "$._Abstract", "string"), F.lit("")))) == "true"
    level = found.filter((F.col("kind") == "OBJECT") & ~abstract & (F.coalesce(name, F.lit("")) != "")).select("file", F.col("key").alias("type"), F.array(name).alias("path"), F.lit(None).cast("string").alias("list"), F.col("value").alias("v"))
    out = None
    while True:
        items = F.try_variant_get("v", "$.li", "variant").isNotNull() & F.col("list").isNotNull()
        each = _repeated(_entries(level.withColumn("items", items), "xml-level").filter("key != 'defName' and (not key like '\\_%' or key = '_value') and (not items or key = 'li')"))
        item = F.col("items")
        each = each.select("file", "type", F.concat("path", F.when(item, F.array(F.col("number").cast("string"))).otherwise(F.array("key"))).alias("path"), F.when(item, F.col("list")).otherwise(F.col("key")).alias("list"), item.alias("item"), "value", "kind")
        # a leaf with attributes is an object whose only other entry is its text
        bare = F.try_variant_get("value", "$._value", "variant")
        leaf = (F.col("kind") != "OBJECT") | bare.isNotNull()
        text = F.when(F.col("kind") != "OBJECT", F.try_variant_get("value", "$", "string")).otherwise(F.try_variant_get("value", "$._value", "string"))
        texts = each.filter(leaf).select(F.col("file").alias(file), "type", F.array_join("path", ".").alias("key"), "list", text.alias("value"))
        texts = texts.filter(F.col("list").isin(*fields) & F.col("value").isNotNull() & definition_text(F.col("value"))).drop("list")
        out = texts if out is None else out.unionByName(texts)
        level = each.filter((F.col("kind") == "OBJECT") & bare.isNull()).select("file", "type", "path", F.when(~F.col("item"), F.col("list")).alias("list"), F.col("value").alias("v"))
        if level.isEmpty():
            return out


def _repeated(entries: DataFrame) -> DataFrame:
    """An element that stands several times is a list: a row for each, numbered."""
    others = [c for c in entries.columns if c not in ("value", "kind")]
    several = entries.filter("kind = 'ARRAY'").select(*others, F.col("value").alias("v"))
    several = several.lateralJoin(entries.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("number"), F.col("value").alias("value")))
    several = several.select(*others, "number", "value").withColumn("kind", _kind(F.col("value")))
    one = entries.filter("kind != 'ARRAY'").select(*others, F.lit(0).alias("number"), "value", "kind")
    return one.unionByName(several)


def normal_type(c: Column) -> Column:
    """The name of a kind of definition for comparison: lower case, a folder's plural as the singular."""
    low = F.lower(F.trim(c))
    return F.when(low.endswith("defs"), F.regexp_replace(low, "s$", "")).otherwise(low)


def normal_key(c: Column) -> Column:
    """A key for comparison: the definition's name as it is, the fields in lower case."""
    return F.when(c.contains("."), F.concat(F.substring_index(c, ".", 1), F.lower(F.regexp_extract(c, r"(?s)\..*", 0)))).otherwise(c)


def not_authored(generated: DataFrame, authored: DataFrame) -> DataFrame:
    """Generated rows (type, key) whose type and key, both normalised, the author's rows (type, key) don't have."""
    have = authored.select(normal_type(F.col("type")).alias("_type"), normal_key(F.col("key")).alias("_key"))
    keyed = generated.withColumn("_type", normal_type(F.col("type"))).withColumn("_key", normal_key(F.col("key")))
    return keyed.join(have, ["_type", "_key"], "left_anti").drop("_type", "_key")
