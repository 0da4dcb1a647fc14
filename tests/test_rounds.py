"""Merges of streams, rounds of work, replies and styles against plain loops."""

import json
import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import replies, requeue, styles
from corpusloom.storage import finished
from corpusloom.streaming import live_merge


def test_merge_survives_repeats(spark, tmp_path):
    rng, schema = random.Random(3), "k string, t long, v string"
    batches = [[(rng.choice("abcdefgh"), rng.randrange(1000), rng.choice(["x", "y", None])) for _ in range(rng.randrange(1, 12))] for _ in range(11)]
    table, key, order = str(tmp_path / "table"), ["k"], ["t"]
    assert live_merge.current(spark, table, spark.createDataFrame([], schema).schema, key, order).count() == 0

    def check(upto):
        want = {}
        for k, t, v in (r for b in batches[: upto + 1] for r in b):
            new = (t, v is not None, v or "")
            want[k] = max(want.get(k, new), new)
        got = {r.k: (r.t, r.v is not None, r.v or "") for r in live_merge.current(spark, table, spark.createDataFrame([], schema).schema, key, order).collect()}
        assert got == want

    for n, b in enumerate(batches):
        d = spark.createDataFrame(b, schema)
        live_merge.upsert(d, n, table, key, order, compact=3)
        if n in (2, 4, 7):  # a batch, its base too, may be written again after a failure
            live_merge.upsert(d, n, table, key, order, compact=3)
        check(n)
    assert len(finished(spark, table, "base-")) == 2 and len(finished(spark, table, "delta-")) <= 6
    base = finished(spark, table, "base-")[-1]
    (tmp_path / "table" / f"base-{base}" / "_SUCCESS").unlink()  # a base that was not finished doesn't count
    check(len(batches) - 1)


def test_stream_goes_on(spark, tmp_path):
    schema = "k string, t long, v string"
    for part, rows in enumerate(([("a", 1, "old"), ("b", 5, "b5")], [("a", 3, "new"), ("b", 2, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = live_merge.merged(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), ["k"], ["t"])
        assert {r.k: r.v for r in out.collect()} == ({"a": "old", "b": "b5"} if part == 0 else {"a": "new", "b": "b5"})


def test_rounds(spark):
    items = spark.createDataFrame([(i, f"f{i % 3}") for i in range(40)], "id long, file string")
    asked = []

    def attempt(pending, number, final):
        asked.append((number, final, {r.id: r.attempts for r in pending.collect()}))
        extra = spark.createDataFrame([(1000, "not asked"), (1, " "), (2, None), (3, "a"), (3, "b")], "id long, value string")
        return pending.filter(F.col("id") % (5 if final else 4) == number).select("id", F.lit(f"r{number}").alias("value")).unionByName(extra)

    done, left = requeue.in_rounds(items, "id", attempt, 2)
    done, left = {r.id: (r.value, r.attempts) for r in done.collect()}, {r.id: r.attempts for r in left.collect()}
    want = {i: (f"r{i % 4}", 1 + i % 4) for i in range(40) if i % 4 < 2} | {3: ("b", 1)}
    want |= {i: ("r2", 3) for i in range(40) if i not in want and i % 5 == 2}
    assert done == want and left == {i: 3 for i in range(40) if i not in want}
    assert [(n, f) for n, f, _ in asked] == [(0, False), (1, False), (2, True)] and set(asked[1][2].values()) == {1}
    none, rest = requeue.in_rounds(items.filter("false"), "id", attempt, 2)
    assert none.count() == rest.count() == 0


def plain_reply(raw, wanted):
    text = raw.strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    text = fence[1].strip() if fence else text
    at = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    end = text.rfind({"[": "]", "{": "}"}.get(text[at : at + 1], "\0"))
    try:
        data = json.loads(text[at : end + 1] if at >= 0 and end > at else text)
    except ValueError:
        return {}
    listed = data if isinstance(data, list) else data.get("items") if isinstance(data, dict) and isinstance(data.get("items"), list) else None
    if listed is not None:
        pairs = [(x["id"], x["translated"]) for x in listed if isinstance(x, dict) and "id" in x and "translated" in x]
    else:
        pairs = [(k, v.get("translated", v.get("text", "")) if isinstance(v, dict) else v) for k, v in data.items()] if isinstance(data, dict) else []
    return {k: v for k, v in ((str(k).strip().lower(), v) for k, v in pairs) if k in wanted and isinstance(v, str) and v.strip()}


def test_replies(spark):
    one = {"id": " A ", "translated": "x\ny"}
    given = ["", "nothing", "[]", "{}", "[1, 2", "```json\n" + json.dumps([one, {"id": "b", "translated": "z"}]) + "\n```", "text ```" + json.dumps({"items": [one]}) + "``` ```[]```"]
    given += ["so: " + json.dumps({"A": "q", "c": "no", "b": {"text": "t"}}) + " end", json.dumps({"a": {"translated": "w", "text": "t"}, "b": {"other": 1}}), json.dumps({"items": "no list", "a": "v"})]
    given += [json.dumps([one, {"id": "a", "translated": "second"}, {"id": "b", "translated": "  "}, {"id": "b"}, None, "odd"]), json.dumps({"a": {"translated": "", "text": "t"}, "b": None}), "[x] {\"a\": \"b\"}", "{\"a\": \"é😀\"} trailing }", json.dumps({"a": "\\n stays"})]
    d = spark.createDataFrame([*enumerate(given), (99, None)], "n int, raw string")
    wanted = spark.createDataFrame([(n, i) for n in range(len(given)) for i in ("a", "b")] + [(99, "a")], "n int, id string")
    got = {}
    for r in replies.parse_replies(d, wanted, "n", "raw").collect():
        got.setdefault(r.n, {})[r.id] = r.value
    assert got == {n: p for n, raw in enumerate(given) if (p := plain_reply(raw, {"a", "b"}))}


def plain_box(w, h, style, prefix, known):
    names, seen = [n for n in (style, prefix and prefix + "_button", prefix) if n], None
    for n in names:
        sw, sh = known.get(n, (0, 0))
        w, h = w or sw, h or sh
        if seen is None and (sw or sh):
            seen = n
        if w and h:
            break
    return (w, h, seen) if w and h else None


def test_boxes(spark):
    rng = random.Random(8)
    known = {"big": (300, 80), "wide": (200, 0), "tall": (0, 90), "p_button": (0, 40), "p": (120, 60), "q_button": (70, 30), "none": (0, 0)}
    widgets = [(i, rng.choice([0, None, 50]), rng.choice([0, None, 20]), rng.choice([None, "big", "wide", "tall", "none", "missing"]), rng.choice([None, "p", "q", "none"])) for i in range(200)]
    want = {i: b for i, w, h, s, p in widgets if (b := plain_box(w or 0, h or 0, s, p, known))}
    out = styles.resolve_boxes(spark.createDataFrame(widgets, "id int, width int, height int, style string, prefix string"), spark.createDataFrame([(k, *v) for k, v in known.items()], "style string, width int, height int"), "id")
    assert {r.id: (r.width, r.height, r.box_style) for r in out.collect()} == want
    rows = spark.createDataFrame([("f", 1), ("f", 2), ("f", 1)], "file string, line int")
    boxes = spark.createDataFrame([("f", 1, 5, 5, "s"), ("f", 1, 9, 1, None)], "file string, line int, width int, height int, box_style string")
    assert sorted(tuple(r) for r in styles.at_lines(rows, boxes, "file", "line").collect()) == [("f", 1, 9, 1, None), ("f", 1, 9, 1, None), ("f", 2, None, None, None)]


def test_progress_of_a_folder_and_of_a_file(spark, tmp_path):
    from corpusloom.streaming import progress

    rows = [(f"2024-01-01 0{h}:30:00", t, v) for h, t, v in ((1, "a", 0.1), (1, "a", 0.25), (2, "a", 1.0), (1, "b", None))]
    d = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    path = tmp_path / "in" / "events.parquet"
    d.repartition(2).write.parquet(str(path))
    d.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "flat").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "flat" / "events.parquet")
    for n, p in enumerate((path, tmp_path / "flat" / "events.parquet")):
        got = progress.run_available(spark, str(p), str(tmp_path / f"checkpoint{n}"), compact=1)
        assert sorted((r.hour.hour, r.event_type, r.events, r.cents) for r in got.collect()) == [(1, "a", 2, 35), (1, "b", 1, None), (2, "a", 1, 100)]
