"""Decisions about strings on chosen cases."""


from pyspark.sql import functions as F

from corpusloom.functions import judgements as j
from corpusloom.operators import listing, ordered, reconcile
from corpusloom.sources import versions


def each(spark, f, values, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in d.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_properties(spark):
    assert each(spark, j.technical_property, ["StrId", "strid", "Title", "Pin_2_0123456789ABCDEF0", "Pin_2_0123", None]) == [True, True, False, True, False, False]
    assert each(spark, j.identifier_like, ["a.b.c", "4NUMER.CNT3R", "Decoration.", "a.b.c d", " a.b.c ", "x_0123456789abcdef"]) == [True, False, False, False, True, True]
    shown = lambda v: j.property_text(F.lit("Title"), v, F.lit(False))
    assert each(spark, shown, ["A title", "", "123", "[ABC_1]", "a.b.c", None]) == [True, False, False, False, False, False]
    assert each(spark, lambda v: j.property_text(F.lit("Title"), v, F.lit(True)), ["A title"]) == [False]


def test_cells(spark):
    assert each(spark, j.coded_cell, ["12|13|{a b}|", "12", "12|x", "|", "{x}|4\0\0", "", None]) == [True, False, False, True, True, False, None]
    assert each(spark, j.cell_text, ["Name", "???", "{a} {b}\n", "{a} b", "{open", "", " x"]) == [False, False, False, True, True, False, True]


def test_code(spark):
    never = lambda v: j.never_shown(v, F.concat(F.lit("show "), v))
    assert each(spark, never, ["Hello there", " ", "a/b", "a\\b", "#ffa0", "[x", "end;", "the config is", "ok!"]) == [False, True, True, True, True, True, True, True, False]
    assert each(spark, lambda v: j.always_shown(F.lit(None).cast("string"), F.lit("append"), v), ["user_chat", "other", None]) == [True, False, False]
    assert each(spark, lambda v: j.always_shown(v, F.lit("f"), F.lit(None).cast("string")), ["label", "x", None]) == [True, False, False]
    assert each(spark, j.prose, ["two words", " one ", "a<<b>>", "Name: ", "x"]) == [True, False, True, True, False]
    assert each(spark, j.runs_code, [" EXEC: x", "goto:y", "go to", ""]) == [True, True, False, False]
    assert each(spark, j.repetitive, ["a a a a a b", "a b c d e f", "a a a", "X x x x x x"]) == [True, False, False, True]


def test_messages(spark):
    assert each(spark, j.actionable, ["Could not evaluate 'x' in the who part", "label has not been given a parameter list", "Tag IS NOT USED", "bad tag"]) == [False, False, False, True]
    d = spark.createDataFrame([(200, "blocked"), (403, None), (451, ""), (500, "unsupported country"), (401, ""), (400, "Invalid key"), (503, "busy")], "s int, b string")
    assert [r.r for r in d.select(j.probe_class(F.col("s"), F.col("b")).alias("r")).collect()] == ["ok", "geoblock", "geoblock", "geoblock", "auth", "auth", "ok"]
    assert each(spark, lambda v: j.request_delay(v, F.lit(4)), [None, 0, -1, 60], "int") == [0.0, 0.0, 0.0, 4.0]


def test_lists(spark):
    rows = spark.createDataFrame([(1, "Alpha", "", ["a"]), (2, "beta", "Done", ["uscore", "x"]), (3, "gamma", None, ["a", "Deep"]), (4, None, " ", None)], "id int, original string, translated string, path array<string>")
    ids = lambda c: sorted(r.id for r in rows.filter(c).collect())
    o, t, p = (F.col(c) for c in ("original", "translated", "path"))
    assert [ids(listing.by_status(t, s)) for s in ("all", "translated", "untranslated")] == [[1, 2, 3, 4], [2], [1, 3, 4]]
    assert [ids(listing.by_kind(p, k)) for k in ("all", "regular", "python", "none")] == [[1, 2, 3, 4], [1, 3, 4], [2], []]
    assert [ids(listing.by_search("DE", o, t, p, m)) for m in ("original", "translation", "all", "none")] == [[3], [], [3], []]
    assert ids(listing.by_search("", o, t, p)) == [1, 2, 3, 4] and ids(listing.by_search("do", o, t, p)) == [2]
    shown, order = listing.listed(rows, "id", listing.by_kind(p, "python"), [F.desc("id")], spark.createDataFrame([(1,), (1,)], "id int"))
    assert [(r.id, r.pinned) for r in shown.orderBy(*order).collect()] == [(1, True), (2, False)]
    for number, want in ((0, [4, 3]), (1, [2, 1]), (9, [2, 1]), (-3, [4, 3])):
        assert [r.id for r in listing.page(rows, [F.desc("id")], number, 2).collect()] == want
    assert listing.page(rows.filter("false"), [F.col("id")], 3).count() == 0
    scoped = lambda c: each(spark, lambda v: listing.by_scope(v, ["C:\\Mods\\A", "c:/mods/ab"], ["c:/mods/a/hidden"]), c)
    assert scoped(["c:/mods/a", "C:\\mods\\\\A\\x.txt", "c:/mods/a!in", "c:/mods/abc", "c:/mods/a/hidden/y", "c:/mods/ab/z"]) == [True, True, True, False, False, True]
    merged = rows.withColumn("approved", F.col("id") == 3)
    assert sorted(r.id for r in listing.selected(merged, "id").collect()) == [1, 4]
    assert sorted(r.id for r in listing.selected(merged, "id", spark.createDataFrame([(2,), (3,), (7,)], "id int")).collect()) == [2, 3]


def test_flows(spark):
    rows = [("f", 0, "a", "x", False), ("f", 1, "b" * 300, "y", False), ("f", 2, "c", "z", None), ("f", 3, "d", "x", True), ("f", 4, "e", None, False), ("g", 0, "h", "x", False)]
    got = ordered.flow_context(spark.createDataFrame(rows, "file string, at int, line string, who string, jump boolean"), "file", "at", "line", "who", F.col("jump"))
    assert [(r.previous, r.previous_speaker) for r in got.orderBy("file", "at").collect()] == [(None, None), ("a", "x"), ("b" * 150 + "...", "y"), (None, None), ("d", "x"), (None, None)]


def test_lookups(spark):
    s = lambda *rows: spark.createDataFrame(list(rows), "k int, value string")
    got = reconcile.first_known(spark.range(5).select(F.col("id").cast("int").alias("k")), "k", [("one", s((1, "a"), (2, " "), (3, None))), ("two", s((1, "b"), (2, "c"), (2, "b")))])
    assert sorted(tuple(r) for r in got.collect() if r.value) == [(1, "a", "one"), (2, "b", "two")] and got.count() == 5
    made = spark.createDataFrame([("T", "a"), ("T", "a"), ("t", "a"), ("T", "b")], "type string, key string")
    assert sorted(map(tuple, reconcile.not_curated(made, spark.createDataFrame([("T", "b"), ("t", "A")], "type string, key string"), ["type", "key"]).collect())) == [("T", "a"), ("t", "a")]
    lines = spark.createDataFrame([("e",), ("m",), ("",), (None,)], "who string")
    named = reconcile.speakers(lines, spark.createDataFrame([("e", "Eve"), ("e", "Ada")], "who string, name string"), "who")
    assert sorted(r.speaker for r in named.collect()) == ["Ada", "m", "narrator", "narrator"]


def test_versions_and_faults(spark):
    rows = [("a", "a/1.9/x"), ("a", "a/1.10/x"), ("a", "a/common"), ("b", "b/x"), ("b", "b/x"), ("b", "b/1.5x"), (None, "0.5"), ("c", "c\\1.2\\3.0")]
    got = versions.latest_folders(spark.createDataFrame(rows, "unit string, path string"), "unit", "path")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "a/1.9/x"), ("b", "b/x"), ("b", "b/1.5x"), (None, "0.5"), ("c", "c\\1.2\\3.0")], key=str)
    files = [("a.json", "{}"), ("b.json", '{"a": 1,}'), ("c.ini", "[head]\r\nkey=v\n# note\n\nodd line\nk: v"), ("d.txt", "odd"), ("e.json", None), ("f.properties", "x" * 80)]
    got = versions.file_faults(spark.createDataFrame(files, "file string, text string"), "file", "text")
    assert sorted((r.file, r.line or 0, r.severity) for r in got.collect()) == [("b.json", 0, "error"), ("c.ini", 5, "warning"), ("f.properties", 1, "warning")]
    assert all(len(r.message) <= 90 for r in got.collect())
