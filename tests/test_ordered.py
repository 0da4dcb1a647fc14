"""Ordered operators against plain loops."""

import random

import pytest

from corpusloom.operators import ordered


def plain_batches(costs, budget, most):
    batch, used, n, out = 0, 0, 0, []
    for c in costs:
        if n and (n >= most or used + c > budget):
            batch, used, n = batch + 1, 0, 0
        used, n = used + c, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("block,most", [(7, 4), (3, 8), (1, 3), (10_000, 30)])
def test_batches_in_blocks(spark, block, most):
    rng, rows, want = random.Random(block), [], {}
    for key in ("hot", "small", "one", None):
        n = {"hot": 300, "small": 11, "one": 1, None: 20}[key]
        costs = [rng.choice([0, 1, 3, 5, 50]) for _ in range(n)]
        order = sorted(rng.sample(range(10_000), n))
        rows += [(key, o, c, "x") for o, c in zip(order, costs)]
        want |= {(key, o): b for o, b in zip(order, plain_batches(costs, 20, most))}
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "file string, pos long, cost long, other string")
    got = ordered.greedy_batches(d, "file", "pos", "cost", 20, most, block)
    assert got.columns == ["file", "pos", "batch"] and {(r.file, r.pos): r.batch for r in got.collect()} == want
    assert ordered.greedy_batches(d.filter("false"), "file", "pos", "cost", 20, most).count() == 0


def test_ema(spark):
    rng, rows, want = random.Random(1), [], {}
    for key in ("a", "b", None):
        values = [rng.random() for _ in range({"a": 200, "b": 1, None: 3}[key])]
        rows += [(key, i, v) for i, v in enumerate(values)]
        e = values[0]
        for v in values[1:]:
            e = e * 0.6 + v * 0.4
        want[key] = e
    got = {r.k: r.ema for r in ordered.ema(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_siblings(spark):
    rng, rows, want = random.Random(5), [], set()
    for block in range(30):
        strings = [" ".join("w" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 5))) if rng.random() < 0.8 else "OK" for _ in range(rng.randrange(40))]
        rows += [(block, i, s) for i, s in enumerate(strings)]
        distinct = list(dict.fromkeys(strings))
        for t in distinct:
            capped, total = [], 0
            for s in distinct:
                if s == t:
                    continue
                if len(capped) >= 15 or total + len(s) + 2 > 800:
                    break
                capped.append(s)
                total += len(s) + 2
            want.add((block, t, tuple(capped) if " " in t and len(t) > 10 else None))
    rows += [(99, 0, None), (None, 0, "null block one"), (None, 1, "null block two")]
    want |= {(None, "null block one", ("null block two",)), (None, "null block two", ("null block one",))}
    got = ordered.siblings(spark.createDataFrame(rows, "block int, i int, s string"), "block", "i", "s")
    assert {(r.block, r.s, None if r.siblings is None else tuple(r.siblings)) for r in got.collect()} == want
    assert any(w[2] and len(w[2]) == 15 for w in want) and any(w[2] and 3 < len(w[2]) < 15 for w in want)
