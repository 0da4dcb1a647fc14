"""SimHash components, periodic runs and collocations against brute force."""

import hashlib
import re
import zlib
from fractions import Fraction

import harness
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("corpusloom.llm")
from corpusloom.llm import collocations, periodic, queries, simhash  # noqa: E402
from corpusloom.llm.double_array import Trie  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, fp long, runs int, h long, x string, slice int"
SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def texts():
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(300)]
    base = list(rng.choice(words, 400))
    out = [None, "", " \n ", "one", "one two", "ONE two", "a b c", " ".join(base), "\t" + " \n".join(base).upper()]
    for _ in range(40):  # near copies whose fingerprints crowd in a few buckets
        near = list(base)
        for i in rng.choice(400, rng.integers(1, 4)):
            near[i] = "other%d" % rng.integers(3)
        out.append(" ".join(near))
    out += ["x " * 20, "x " * 24, "x " * 500 + "y", "a b c " * 7 + "a b c", "a b c " * 8 + "a b", "a b c d e f g h i " * 3, "pré " * 30 + "a b " * 30]
    out += [" ".join(list(rng.choice(words, 50)) * 3 + list(rng.choice(words, 100)) * 2 + ["a", "b"] * 40), " ".join(rng.choice(["a", "b"], 3000)), " ".join(rng.choice(["a", "a", "a", "b"], 3000)), " ".join(rng.choice(words, 20000))]
    square = list(rng.choice(words, 40))
    out.append(" ".join((square * 2 + list(rng.choice(words, 37))) * 4))  # a period whose first part repeats itself
    out += ["Alpha beta. gamma-delta alpha beta; alpha beta gamma, alpha beta\tgamma! alpha\nbeta"] * 12
    return out


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts()))
    return [(i, t, [None, "en", "und"][i % 3] if i % 7 else "fr", i, i, i, "x", i) for i, t in found] + [(3, "again", "en", 0, 0, 0, "y", 0), (None, "one two", None, 0, 0, 0, "y", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(t):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    v = np.array(fps, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= 2) + i + 1:
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2, 0])
def test_simhash_equals_brute_force(docs, rows, bucket):
    fps = [fingerprint(r[1]) for r in rows]
    group = near_components(fps)
    least = {g: min(r[0] for r, x in zip(rows, group) if x == g and r[0] is not None) for g in group}
    want = sorted(((r[0], format(f, "016x"), least[g]) for r, f, g in zip(rows, fps, group)), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.with_hex(simhash.simhash_components(docs, bucket=bucket)).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("bucket", [1, 5, 64])
def test_links_of_crowded_fingerprints(spark, bucket):
    """A ball of fingerprints around one value, and random ones: the same components whether buckets are compared or opened."""
    rng = np.random.default_rng(11)
    centre = int(rng.integers(0, 2**63))
    values = {centre} | {centre ^ 1 << int(i) ^ 1 << int(j) ^ 1 << int(k) for i, j, k in rng.integers(0, 64, (150, 3))} | {int(x) for x in rng.integers(0, 2**63, 50)}
    values = sorted(values)
    entries = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    edges = {(r.a, r.b) for r in simhash.links(entries, bucket).collect()}
    number = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2
        root[find(number[a])] = find(number[b])
    want = near_components(values)
    assert len({(find(i), want[i]) for i in range(len(values))}) == len(set(want)) == len({find(i) for i in range(len(values))})


def plain_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                end = i + q
                if end - start >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(start, end - d)) for d in range(1, q)):
                    out.append((start, end - start, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_classes_cover_all_lags():
    for least, times in ((24, 3), (10, 3), (64, 5)):
        found = periodic.classes(5000, least, times)
        assert found[0][1] == 1 and all(b[1] == a[2] + 1 for a, b in zip(found, found[1:]))
        for k, low, high in found:
            assert k == min(max(least - q, (times - 1) * q) for q in range(low, high + 1)) and 3 * high <= 2 * k
    assert len(periodic.classes(10**6, 24, 3)) < 50


def test_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(250):
        w = list(rng.integers(0, rng.integers(1, 4), rng.integers(0, 120)))
        for _ in range(rng.integers(0, 3)):
            p = list(rng.integers(0, 3, rng.integers(1, 15)))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = (p * 12)[: int(rng.integers(len(p), 12 * len(p) + 1))]
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w), w


def test_runs_with_periods_that_repeat_within():
    """Roots in which all short grams occur twice or more, so that the next occurrence is rarely a period later."""
    rng = np.random.default_rng(1)
    x, y, z = (list(rng.integers(0, 10**6, 20)) for _ in range(3))
    for root in (x + x + y + y + x + y, x + y + x + z, x + x + x + y, (x + y) * 2 + x + z, x * 4 + y):
        w = [1, 2, 3] + root * 4 + root[:7] + [4, 5]
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


def expected_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs_fast(w)
    stay = [True] * n
    for s, m, q in found:
        stay[s + q : s + m] = [False] * (m - q)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for x, k in zip(w, stay) if k).encode()).hexdigest())


def plain_runs_fast(w):
    """As plain_runs, lag by lag with arrays."""
    ids = {}
    v, out = np.array([ids.setdefault(x, len(ids)) for x in w], np.int64), []
    for q in range(1, len(v) // 3 + 1):
        same = np.concatenate([[False], v[:-q] == v[q:], [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        for s, t in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if t - s + q >= max(24, 3 * q) and not any(np.array_equal(v[s : t + q - d], v[s + d : t + q]) for d in range(1, q)):
                out.append((s, t - s + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_query_equals_brute_force(spark, docs, rows, empty):
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = periodic.digests(periodic.periodic_runs(docs, rewrite=periodic.looped))
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected_row(r[0], r[1]) for r in rows), key=repr)
    some = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 12000")
    got = sorted(map(tuple, periodic.digests(periodic.periodic_runs(some, rewrite=periodic.looped)).collect()))
    assert got == sorted(expected_row(r.doc_id, r.text) for r in some.collect()) and any(r[1] for r in got)
    assert periodic.digests(periodic.periodic_runs(empty)).count() == 0


def test_periodic_search_without_rewriting_and_when_hashes_collide(docs, rows, monkeypatch):
    got = {r.doc_id: (r.runs, r.collapsed) for r in periodic.periodic_runs(docs.filter("doc_id > 40")).collect()}
    for i, t in ((r[0], r[1]) for r in rows if r[0] is not None and r[0] > 40):
        w = WORD.findall(t or "")
        assert [tuple(x) for x in got[i][0]] == plain_runs_fast(w)
    w = np.array([1, 2, 3, 1, 2, 4] * 12, np.uint64)
    text = b"".join(b"%d " % x for x in w)
    folded = np.where(w == 4, np.uint64(3), w)  # two words with one hash
    at = np.arange(len(w) + 1) * 2
    assert periodic._exact(folded, np.frombuffer(text, np.uint8), at, np.arange(len(w)), 24, 3) == plain_runs(list(w))


def brute_phrases(rows, least, percent, top):
    from collections import Counter

    counts = {}
    for r in rows:
        c = counts.setdefault(r[2] or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                c.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in counts.items():
        n, found = sum(v for k, v in c.items() if len(k) == 1), []
        kept = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        for k, a in kept.items():
            if any(len(x) > len(k) and k in (x[:2], x[1:]) and 100 * kept[x] >= percent * a for x in kept):
                continue
            score, _, left, right = min((10**6 * a * a // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]]) for i in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("least,percent,top,bound", [(10, 50, 2000, None), (2, 90, 30, 7)])
def test_collocations_equal_brute_force(docs, rows, monkeypatch, least, percent, top, bound):
    if bound:  # many tries, passes and blocks
        monkeypatch.setattr(collocations, "SLICE", 200)
        monkeypatch.setattr(collocations, "TRIES", 3)
    some = [r for r in rows if r[0] != len(texts()) - 14] if bound else rows  # but for the long random text
    source = docs.filter(F.col("doc_id").isNull() | (F.col("doc_id") != len(texts()) - 14)) if bound else docs
    got = sorted(map(tuple, collocations.collocations(source, least=least, percent=percent, top=top).collect()))
    assert got == brute_phrases(some, least, percent, top)


def test_collocations_of_nothing(empty, spark):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, "a b c")], "doc_id long, lang string, text string")).count() == 0


def test_collocations_query_equals_sql(spark):
    got, want = harness.compare(spark, "/root/testdata/sf0.01", queries.op13_collocations, queries.ORACLES["op13_collocations"])
    assert got == want and len(got[1]) > 100


def test_double_array_matches_as_a_set():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    phrases = np.unique(words[np.minimum(rng.zipf(1.2, (20000, 3)), 5000) - 1], axis=0)
    trie = Trie.load(Trie.build(phrases).dump())
    assert trie.match(phrases).tolist() == list(range(len(phrases)))
    tried = words[np.minimum(rng.zipf(1.2, (20000, 3)), 5000) - 1]
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    assert trie.match(tried).tolist() == [known.get(tuple(p), -1) for p in tried.tolist()]
    assert trie.match(np.zeros((0, 3), np.uint64)).tolist() == []
