from pyspark.sql import functions as F

from corpusloom.functions import ids, predicates, text
from corpusloom.operators import ordered, reconcile, sinks
from corpusloom.sources import markup


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_stable_id_golden(spark):
    path = F.array(*map(F.lit, ["events", "1", "pages", "0", "list", "0", "parameters", "0"]))
    assert one(spark, ids.stable_id(F.lit("rpgmaker"), F.lit("data/Map001.json"), path, F.lit("Hello there")), a=1) == "c670705d"
    assert one(spark, ids.fnv1a32(F.lit("")), a=1) == "811c9dc5"


def test_game_text(spark):
    cases = {"Play": True, "he/she": False, "Hello there": True, "enabled": False, "QUIT": True, "fooBar": False, "Sword": True, "v1.2.3": False, "\xa0": False, "": False, "new": True}
    got = {r.s: r.x for r in spark.createDataFrame([(k,) for k in cases], "s string").select("s", predicates.game_text(F.col("s")).alias("x")).collect()}
    assert got == cases


def test_technical(spark):
    cases = {"gui/nvl.png": True, "{i}Exhausting.{/i}": False, "#fff": True, "...": True, "thought": True, "Good morning": False}
    got = {r.s: r.x for r in spark.createDataFrame([(k,) for k in cases], "s string").select("s", predicates.script_technical(F.col("s")).alias("x")).collect()}
    assert got == cases


def test_error_class_order(spark):
    assert one(spark, predicates.error_class(F.lit("quota; invalid api key")), a=1) == "rate"
    assert one(spark, predicates.error_class(F.lit("Unauthorized")), a=1) == "auth"
    assert one(spark, predicates.error_class(F.lit(None).cast("string")), a=1) == "other"


def test_budget(spark):
    r = text.output_ratio(F.lit("Russian"))
    assert one(spark, text.input_budget(F.lit(8192), F.lit(0), r, calibrated=False), a=1) == 3188
    assert one(spark, text.input_budget(F.lit(8192), F.lit(0), r), a=1) == 2933


def test_token_violations(spark):
    assert one(spark, text.token_violations(F.lit("[a] {b}x{/b} %d"), F.lit("{b}x{/b} [a] %d")), a=1) == []
    assert one(spark, text.token_violations(F.lit("[a] %d"), F.lit("[b] %s")), a=1) == ["var", "fmt"]


def test_events(spark):
    json = '{"events":[null,{"pages":[{"list":[{"code":401,"parameters":["Hello there"]},{"code":401,"parameters":["How are you?"]},{"code":102,"parameters":[["Yes","No"]]},{"code":0,"parameters":[]}]}]}]}'
    rows = markup.event_commands(spark.createDataFrame([("Map001.json", json)], "file string, json string")).collect()
    assert sorted(r.original for r in rows) == ["Hello there", "How are you?", "No", "Yes"]
    assert [r.path for r in rows if r.original == "No"] == [["events", "1", "pages", "0", "list", "2", "parameters", "0", "1"]]


def test_settings(spark):
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(["[a]", "k=v=w", "; no=1", "[b]", "x = y"])], "file string, pos int, line string")
    assert [(r.section, r.key, r.value) for r in markup.sectioned_settings(lines).orderBy("pos").collect()] == [("a", "k", "v=w"), ("b", "x", "y")]


def test_packing_never_loses_rows(spark):
    rows = spark.createDataFrame([("s", i, 100 if i != 3 else 9999) for i in range(10)], "source string, doc_id long, cost long")
    got = {r.doc_id: r.batch for r in ordered.greedy_batches(rows, "source", "doc_id", "cost", 250, 30).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4, 8: 5, 9: 5}


def test_upsert_keeps_original_and_approval(spark):
    memory = spark.createDataFrame([("a", "o", "t", True)], "id string, original string, translated string, approved boolean")
    fresh = spark.createDataFrame([("a", "new", "t2"), ("b", "ob", "tb")], "id string, original string, translated string")
    assert sorted(map(tuple, reconcile.merge_translations(memory, fresh).collect())) == [("a", "o", "t2", True), ("b", "ob", "tb", False)]


def test_match_newlines(spark):
    cases = {("a\n", "x"): "a", ("a\n \n", "x\n"): "a\n \n", ("\n \na\n\nb\n", "x"): "a\n\nb", ("\na", "\nx"): "\na", ("\n\n", "x"): "", ("\na\n", ""): "\na", ("a\n", None): "a", ("\n" * 20000 + "a", "x"): "a"}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "t string, o string, want string")
    assert [(r.x, r.want) for r in rows.select(text.match_newlines(F.col("t"), F.col("o")).alias("x"), "want").collect() if r.x != r.want] == []


def test_escape_percent(spark):
    cases = {"100%": "100%%", "100%%": "100%%", "%s %(n)d %5.": "%s %(n)d %%5.", "%(x": "%%(x", "%(n)y": "%%(n)y", "50% off": "50% off", "5% %": "5% %", "%9d": "%%9d", "%%%": "%%%%", "": "", None: None}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string").withColumn("x", text.escape_percent(F.col("s"))).withColumn("again", text.escape_percent(F.col("x"))).collect()
    assert [(r.s, r.x, r.again) for r in rows if (r.x, r.again) != (r.want, r.want)] == []


def test_write_back(spark):
    """Null and empty texts, repeated lines, and two originals under one identifier, of which only the line's own is written."""
    files = spark.createDataFrame([(1, "a\nbb\n\na"), (2, None), (3, ""), (4, "cc")], "f long, t string")
    memory = spark.createDataFrame([("1", "a", "A!"), ("2", "bb", "B!"), ("2", "dd", "D!"), ("1", "x", "X!"), ("0", "", None)], "id string, original string, translated string")
    got = sorted(map(tuple, sinks.write_back(files, "f", "t", memory, lambda c: F.length(c).cast("string")).collect()))
    assert got == [(1, "A!\nB!\n\nA!", 3), (2, None, 0), (3, "", 0), (4, "cc", 0)]


def test_reply_results(spark):
    replies = spark.createDataFrame([(" A ", 1, "old"), ("a", 2, "new"), ("A", 3, " "), ("b", 1, None), ("z", 1, "not asked")], "id string, n int, text string")
    got = reconcile.reply_results(spark.createDataFrame([("a",), ("b",)], "id string"), replies, "n").collect()
    assert [tuple(r) for r in got] == [("a", "new")]
