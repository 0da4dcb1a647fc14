"""Inheritance, containment, numbering, slots and splices against plain loops."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import hierarchy, numbering, slots, splice


def climb(parents, own, start):
    seen, node, depth = set(), start, 0
    while node in parents and node not in seen:
        seen.add(node)
        if own.get(node) is not None:
            return own[node], node, depth
        node, depth = parents[node], depth + 1
    return None, None, None


def test_nearest_ancestors(spark):
    rng = random.Random(4)
    parents, own = {}, {}
    for depth in range(1, 21):  # chains of every depth, from a root, a missing parent or a cycle
        for kind in ("root", "missing", "cycle"):
            names = [f"{kind}{depth}.{i}" for i in range(depth + 1)]
            parents |= dict(zip(names[1:], names))
            parents[names[0]] = {"root": None, "missing": "nowhere", "cycle": names[-1]}[kind]
            own |= {n: f"v{n}" for n in names if rng.random() < 0.15}
    rows = [(n, p, own.get(n), "x" if n.endswith(".0") else None) for n, p in parents.items()]
    rows += [("self", "self", None, None), (None, "root1.0", None, None)]
    d = spark.createDataFrame(rows, "node string, parent string, a string, b string")
    got = {r.node: (r.a, r.a_owner, r.a_depth, r.b, r.b_owner) for r in hierarchy.nearest_ancestors(d, "node", "parent", ["a", "b"]).collect()}
    firsts = {n: "x" for n in parents if n.endswith(".0")}
    for n in parents:
        a, b = climb(parents, own, n), climb(parents, firsts, n)
        assert got[n] == (*a, *b[:2]), n
    assert got["self"] == (None,) * 5 and len(got) == len(rows)
    assert hierarchy.nearest_ancestors(d.filter("false"), "node", "parent", ["a"]).count() == 0


def test_within_any(spark):
    paths = ["a/b/c", "a", "ab/c", "x/a/b", "b/c/d", "", "c/a/b/d/e", "a/bc", "x/y", None]
    known = ["a/b", "c/d", "x/y/z", "d/e", "", None]
    want = [p for p in paths if p is not None and any(p == k or p.startswith(k + "/") or f"/{k}/" in f"/{p}/" for k in known if k)]
    want += [p for p in paths if p == ""]  # the empty path is one of the known
    d = spark.createDataFrame([(p, i) for i, p in enumerate(paths * 2)], "path string, n int")
    k = spark.createDataFrame([(x,) for x in known], "p string")
    got = hierarchy.within_any(d, "path", k, "p")
    assert got.columns == ["path", "n"] and sorted(r.path for r in got.collect()) == sorted(want * 2)
    assert hierarchy.within_any(d, "path", k.filter("false"), "p").count() == 0


def test_dense_numbers(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [(r.k, r.n) for r in numbering.dense_numbers(d, ["k"], "n", 5).orderBy("k").collect()] == [(i, i + 5) for i in range(1000)]
    assert numbering.dense_numbers(d.filter("false"), ["k"], "n").count() == 0


def plain_slots(table, keys):
    table, keys = dict(table), dict(keys)
    users, added = {}, {}
    for k, (slot, fresh) in keys.items():
        users.setdefault(slot, []).append((k, fresh))
    base, moves = max(table, default=-1) + 1, []
    for slot, group in users.items():
        fresh = {f for _, f in group if f is not None}
        if len(fresh) == 1 and all(f is not None for _, f in group):
            table[slot] = fresh.pop()
        else:
            moves += [(k, f) for k, f in group if f is not None]
    for k, f in sorted(moves):
        added.setdefault(f, base + len(added))
        keys[k] = (added[f], f)
    return table | {s: f for f, s in added.items()}, {k: s for k, (s, _) in keys.items()}


def test_copy_on_write(spark):
    rng, keys, table, want = random.Random(2), [], [], ({}, {})
    for file in ("a", "b", "c"):
        t = {s: f"old{s}" for s in range(8)}
        ks = {k: (rng.randrange(8), rng.choice([None, "x", "y", "z"]) if file != "c" else None) for k in range(30)}
        table += [(file, s, v) for s, v in t.items()]
        keys += [(file, k, k, s, f) for k, (s, f) in ks.items()]
        after, moved = plain_slots(t, ks)
        want[0].update({(file, s): v for s, v in after.items()})
        want[1].update({(file, k): s for k, s in moved.items()})
    out, moved = slots.copy_on_write(spark.createDataFrame(table, "file string, slot long, value string"), spark.createDataFrame(keys, "file string, key long, pos long, slot long, fresh string"))
    assert {(r.file, r.slot): r.value for r in out.collect()} == want[0]
    assert {(r.file, r.key): r.slot for r in moved.collect()} == want[1]


def test_slots_in_place_and_split(spark):
    """Two keys that share a slot: one new value changes it, two make two new ones."""
    table = spark.createDataFrame([("f", i, f"v{i}") for i in range(4)], "file string, slot long, value string")
    keys = lambda a, b: spark.createDataFrame([("f", 0, 0, 0, "s"), ("f", 1, 1, 1, a), ("f", 2, 2, 1, b), ("f", 3, 3, 2, None)], "file string, key long, pos long, slot long, fresh string")
    out, _ = slots.copy_on_write(table, keys("o", "o"))
    assert sorted((r.slot, r.value) for r in out.collect()) == [(0, "s"), (1, "o"), (2, "v2"), (3, "v3")]
    out, moved = slots.copy_on_write(table, keys("oa", "ob"))
    assert sorted((r.slot, r.value) for r in out.collect()) == [(0, "s"), (1, "v1"), (2, "v2"), (3, "v3"), (4, "oa"), (5, "ob")]
    assert sorted((r.key, r.slot) for r in moved.collect()) == [(0, 0), (1, 4), (2, 5), (3, 2)]


def plain_splice(text, edits):
    edits = sorted(edits, key=lambda e: e[:2])
    good = all(a[0] + len(a[2]) <= b[0] for a, b in zip(edits, edits[1:])) and all(e[0] >= 0 and text[e[0] : e[0] + len(e[2])] == e[2] and e[0] + len(e[2]) <= len(text) for e in edits)
    moved, shift, out = {}, 0, text
    for offset, seq, old, new in edits if good else ():
        out = out[: offset + shift] + new + out[offset + shift + len(old) :]
        moved[offset, seq] = offset + shift
        shift += len(new) - len(old)
    return out, good, moved


def test_splice_equals_brute_force(spark):
    rng, files, edits = random.Random(7), [], []
    for f in range(120):
        text = "".join(rng.choice("abü😀 \n") for _ in range(rng.randrange(60)))
        files.append((f, text))
        at, seq = 0, 0
        while at <= len(text) and rng.random() < 0.9:
            at += rng.randrange(5)
            n = rng.randrange(4)
            expected = text[at : at + n] if rng.random() < 0.97 else "?" * n
            edits.append((f, at if rng.random() < 0.98 else at + rng.choice([-3, 200]), seq, expected, rng.choice(["", "Z", "long one", None])))
            at, seq = at + len(expected), seq + 1
    edits.append((999, 0, 0, "", "x"))
    files += [(500, None), (501, "no edits")]
    out, report = splice.splice(spark.createDataFrame(files, "file long, text string"), spark.createDataFrame(edits, "file long, offset long, seq int, expected string, fresh string"))
    out, report = {r.file: (r.text, r.applied) for r in out.collect()}, {(r.file, r.offset, r.seq): (r.status, r.moved_to) for r in report.collect()}
    refused = 0
    for f, text in files:
        mine = [(o, s, e, n or "") for g, o, s, e, n in edits if g == f]
        want, good, moved = plain_splice(text or "", mine)
        assert out[f] == ((want, True) if good and mine else (text, False))
        for o, s, *_ in mine:
            status, to = report[f, o, s]
            assert (status == "applied") == good and to == moved.get((o, s))
        refused += bool(mine) and not good
        assert not mine or good or any(report[f, o, s][0] in ("overlap", "range", "mismatch") for o, s, *_ in mine)
    assert refused > 10 and report[999, 0, 0] == ("no file", None)


def test_rounds_follow_the_longest_way(spark, monkeypatch):
    rounds, write = [], hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df, name: rounds.append(name) or write(df, name))
    rows = [(i, i ^ 1, i if i % 3 == 0 else None) for i in range(2000)]  # cycles of two
    got = {r.node: (r.a, r.a_owner, r.a_depth) for r in hierarchy.nearest_ancestors(spark.createDataFrame(rows, "node long, parent long, a long"), "node", "parent", ["a"]).collect()}
    assert got == {i: (i, i, 0) if i % 3 == 0 else (i ^ 1, i ^ 1, 1) if (i ^ 1) % 3 == 0 else (None,) * 3 for i in range(2000)}
    assert len(rounds) <= 5


def test_a_text_with_many_edits_is_split_once(spark):
    text = "é𝄞 wörd " * 20_000
    files = spark.createDataFrame([("f", text)], "file string, text string")
    at = range(3, len(text), 8)
    edits = spark.createDataFrame([("f", i, 0, "wörd", "[" + "x" * (i % 3) + "]") for i in at], "file string, offset long, seq int, expected string, fresh string")
    done, report = splice.splice(files, edits)
    assert "split(" in done._jdf.queryExecution().optimizedPlan().toString()
    want = "".join("é𝄞 [" + "x" * (i % 3) + "] " for i in at)
    assert done.first().text == want
    assert [r.status for r in report.select("status").distinct().collect()] == ["applied"]
