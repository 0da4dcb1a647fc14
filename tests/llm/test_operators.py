"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusloom.llm")
from corpusloom.llm import byte_bpe, exact_dedup, hmm, jaccard_join, packing, passages, pii, quality, token_files, topk, wordhash  # noqa: E402
from corpusloom.llm.components import connected_components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, cls long, label string"


def fixture():
    rng = np.random.default_rng(5)
    words = ["w%d" % i for i in range(400)]
    base = " ".join(rng.choice(words, 120))
    near = base.split()
    near[3] = "changed"
    long = " ".join(rng.choice(words, 6000))
    texts = [base, base + "  ", " ".join(near), None, "", " \n\t ", "one two", "one two", long, base.upper(), "mail a.b@c.de or +1 (743) 555-3824, 10.0.0.1, 4111 1111 1111 1111", "x" * 5000, long + " end", "a <|endoftext|> b<|startoftext|>c <|EndOfText|> <|end", "<|endoftext|>"]
    return [(i, t, None, "s", i, "x") for i, t in enumerate(texts)] + [(0, base, None, "s", 1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def shingles(t):
    w = words_of(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_equals_brute_force(docs, empty):
    rows = fixture()
    sets = [(r[0], shingles(r[1])) for r in rows]
    label = {i: i for i, _ in sets}
    for _ in rows:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = sorted((i, len(s), label[i]) for i, s in sets)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(edges).select("label").distinct().count() == 1


@pytest.mark.parametrize("identify", [exact_dedup.identifier, lambda c: F.length(c).cast("bigint")])
def test_exact_dedup(docs, empty, identify):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r[0], norm(r[1])) for r in fixture()]
    want = sorted((i, min(j for j, u in rows if u == t), sum(u == t for _, u in rows), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs, identify=identify).collect())
    assert got == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_packing_and_files(docs, empty):
    from tokenizers import Tokenizer

    from corpusloom.llm.tokens import public_path

    t = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    ids = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in fixture()]
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for _, x in ids)
    seq = {}
    for p in pieces:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_length))
        assert any(i == p.doc_id and p.doc_tokens == len(x) + 1 and zlib.crc32(np.array((x + [2])[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for i, x in ids)
    for parts in seq.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 4096 and (total == 4096 or total & (total - 1) == 0)
    got = token_files.read_documents(token_files.write_blocks(docs, block_ids=500)).orderBy("start").collect()
    want, start = [], 0
    for i, x in sorted(((r[0], r[1] or "", t.encode(r[1] or "", add_special_tokens=False).ids) for r in fixture()), key=lambda r: r[:2]) and [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in sorted(fixture(), key=lambda r: (r[0], r[1] or ""))]:
        want.append((i, start, len(x) + 1, zlib.crc32(np.array(x + [1], "<u4").tobytes())))
        start += len(x) + 1
    assert [tuple(r) for r in got] == want
    assert packing.pack(empty).count() == 0 and token_files.read_documents(token_files.write_blocks(empty)).count() == 0


@pytest.mark.parametrize("sizes", [[1], [5, 1, 1, 900, 3], list(range(1, 300)), [1] * 2000])
def test_elias_fano_select(sizes):
    ends = np.cumsum(sizes)
    marks = token_files.Boundaries(len(ends), *token_files.elias_fano(ends, int(ends[-1])))
    assert marks.ends().tolist() == ends.tolist() == [marks.end(i) for i in range(len(ends))]


def test_pii(docs, empty):
    r = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (r[10].n_email, r[10].n_ip, r[10].n_card, r[10].n_phone) == (1, 1, 1, 1) and r[10].spans.startswith("email:5:13")
    assert r[3].base_sha256 == hashlib.sha256(b"").hexdigest() and r[3].spans == ""
    assert "[EMAIL]" in pii.redact(docs).filter("doc_id = 10").first().text and pii.redact(docs).columns == docs.columns
    assert pii.find(empty).count() == 0
    assert list(pii._emails("a@b@c.d e@f.g@h.i")) == [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "a@b@c.d e@f.g@h.i")]


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_quality_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty, none).count() == 0


def test_topk_with_ties_and_bad_vectors(spark):
    v = [(i, [float(i % 7), 1.0]) for i in range(100)] + [(100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 50):
        s = sorted(((-(int(256 * v[q][1][0]) * int(256 * x[0]) + 65536), i) for i, x in v[:100] if i != q))[:5]
        want += [(q, k, i, -n) for k, (n, i) in enumerate(s, 1)]
    assert got == want
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_repeated_and_null_identifiers(spark, tmp_path):
    """Two vectors of one query identifier are two queries, equal ones are one; a null identifier takes no part; other columns are ignored."""
    import duckdb

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (50, [1.0, 2.0, 3.0]), (None, [9.0, 9.0])] + [(i, [float(i), float(-i)]) for i in range(1, 9)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, block int")
    df.write.parquet(f"{tmp_path}/e")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet' where vec_id is not null")
    assert got == sorted(con.sql(topk.ORACLE).fetchall()) and len(got) == 10


def test_hmm_base_and_total_probability(docs, empty):
    out = hmm.language_model(docs, states=2, rounds=1).collect()
    rows = [(r[0], words_of(r[1]) + [None]) for r in fixture()]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(t), sum(c[w] > 0 for w in t), n, round(float(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert hmm.language_model(empty).count() == 0
    m = hmm.Model.initial(3)
    s = np.array([1, 2, hmm.END], np.uint16)
    a = m.start * m.emit[:, 1]
    for x in s[1:]:
        a = (a @ m.move) * m.emit[:, x]
    assert np.allclose(hmm.log10_forward(m, m.emit.T.copy(), [s, s[2:]]), [np.log10(a.sum()), np.log10((m.start * m.emit[:, hmm.END]).sum())])


def test_passages_find_exact_repeats(spark, empty):
    rng = np.random.default_rng(1)
    w = lambda n: " ".join("v%d" % i for i in rng.integers(0, 5000, n))
    p = w(60)
    d = spark.createDataFrame([(1, w(100) + " " + p + " " + w(30)), (2, p), (3, w(300)), (4, w(20) + " " + p.upper()), (5, None), (6, "x " * 500)], "doc_id long, text string")
    got = {(r.doc_id, r.match_doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(d).collect()}
    assert (2, 1, 0, 60) in got and (4, 1, 20, 80) in got and all(3 not in g[:2] for g in got)
    assert passages.repeated_passages(empty).count() == 0


def test_compact_windows_cover_every_run():
    v = np.random.default_rng(3).integers(0, 1 << 60, 80).astype(np.uint64)
    l, c, r = passages.compact_windows(v, np.array([0]), np.array([80]), 10)
    for i in range(80):
        for j in range(i + 10, 81):
            at = i + int(np.argmin(v[i:j]))
            assert any(a <= i and b >= j and m == at for a, m, b in zip(l, c, r))


def tiktoken_rows(rows):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=byte_bpe.public_pattern(), mergeable_ranks=byte_bpe.load_ranks(byte_bpe.public_path(byte_bpe.VOCABULARY)), special_tokens={})
    return sorted((i, len(x := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_byte_bpe(docs, empty, spark):
    assert sorted(tuple(r) for r in byte_bpe.encode_decode(docs, block_chars=6000).collect()) == tiktoken_rows((r[0], r[1]) for r in fixture())
    assert byte_bpe.encode_decode(empty).count() == 0
    # words of more than 64 bytes: runs of one letter, of two, of all sorts
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(["a" * 301, "aab" * 90 + "a", "ab" * 200, "\u00e9" * 99, "".join(map(chr, rng.integers(97, 123, 400))), "".join(map(chr, rng.integers(0x4E00, 0x4F00, 90)))])]
    assert sorted(tuple(r) for r in byte_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == tiktoken_rows(rows)


def test_a_piece_is_made_of_pieces_of_lesser_ranks():
    """What lets a step join all places of a pair at once."""
    ranks = byte_bpe.load_ranks(byte_bpe.public_path(byte_bpe.VOCABULARY))
    assert all(any(max(ranks.get(p[:i], r), ranks.get(p[i:], r)) < r for i in range(1, len(p))) for p, r in ranks.items() if len(p) > 1)


def test_word_hashes_do_not_depend_on_place():
    texts = ["Ab cd", "  cd\tab ", "", "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, bounds = wordhash.words(data, offsets)
    assert bounds.tolist() == [0, 2, 4, 4, 5] and h[0] == h[3] == h[4] and h[1] == h[2] != h[0]


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, d, sf)
    rows = {r.doc_id: r.text for r in kept.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    stay = sorted(first.values())
    sets, label = {i: shingles(rows[i]) for i in stay}, {i: i for i in stay}
    for _ in range(5):
        for i in stay:
            for j in stay:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {i for i in stay if label[i] == i}


def test_topk_lists_equal_brute_force_in_blocks_of_queries():
    """Ties, repeated identifiers, fewer rows than k, and values beyond what float32 holds."""
    from corpusloom.llm.topk import Lists

    rng = np.random.default_rng(1)
    for _ in range(200):
        m, d, k, most = int(rng.integers(1, 60)), int(rng.integers(1, 6)), int(rng.integers(1, 7)), int(rng.choice([0, 3, 300, 10**6]))
        x, ids = rng.integers(-most, most + 1, (m, d)), rng.integers(0, 2 * m, m)
        queries, own = rng.integers(-most, most + 1, (7, d)), rng.integers(0, 2 * m, 7)
        found = Lists(ids, x).best(queries, own, k, int(rng.integers(0, 9)), int(rng.integers(1, m + 1)))
        expected = [(j, *t) for j in range(7) for t in sorted((-int(v @ queries[j]), int(i)) for i, v in zip(ids, x) if i != own[j])[:k]]
        assert sorted((j, -s, i) for j, i, s in zip(*(c.tolist() for c in found))) == expected


def test_passages_between_hub_and_neighbour(spark):
    """All texts of a set share a line of 40 words, only the third and the last also the 20 words after it."""
    rng = np.random.default_rng(8)
    fresh = lambda n: ["u%d" % i for i in rng.integers(0, 10**9, n)]
    rows, want = [], set()
    for k in range(8):
        line, more = fresh(40), fresh(20)
        for i in range(6):
            both = i in (2, 5)
            rows.append((10 * k + i, " ".join(fresh(70) + line + (more if both else fresh(20)) + fresh(70))))
        want.add((10 * k + 5, 10 * k + 2, 70, 130))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.match_doc_id, r.start_word, r.end_word) for r in got} == want


def test_passages_within_one_sparse_run():
    """Two exact passages and a near one, joined by words of which one shingle in ten is shared."""
    rng = np.random.default_rng(4)
    n = lambda k: rng.integers(0, 2**32, k, dtype=np.uint32)
    link, near = [n(1) for _ in range(40)], n(60)
    sparse = lambda k: np.concatenate([np.concatenate([n(9), link[k + i]]) for i in range(10)] + [n(9)])
    p, q = n(50), n(80)
    changed = near.copy()
    changed[30:35] = n(5)
    x = np.concatenate([p, sparse(0), near, sparse(10), q])
    y = np.concatenate([p, sparse(0), changed, sparse(10), q])
    got = [(s, e) for s, e, *_ in passages.repeats(x, y, 46, 80, 12)]
    assert len(got) == 3
    for (s, e), (lo, hi) in zip(got, ((0, 50), (159, 219), (328, 408))):
        assert s <= lo + 9 and abs(s - lo) <= 12 and e >= hi and e - hi <= 12


def test_stages_judge_rows_by_their_own_texts(spark):
    """A doc_id twice with different texts, null ids, repeated rows; columns named as the classifier's own."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    a, b, c = (" ".join("q%d" % i for i in rng.integers(0, 9000, 80)) for _ in range(3))
    near = c + " more"
    rows = [(3, a), (3, b), (1, a), (None, b), (None, c), (7, near), (7, near), (9, None), (8, "")]
    d = spark.createDataFrame([(i, t, "en", 0.5, 3) for i, t in rows], "doc_id long, text string, lang string, score double, predicted int")
    out = corpus_pipeline.exact_dedup_stage(spark, d, "")
    assert out.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(3, b), (1, a), (0, c), (7, near), (8, "")])
    out = corpus_pipeline.near_dedup_stage(spark, d, "")
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(3, b), (1, a), (7, near), (8, ""), (9, "")])
    labels = [(i, float(i % 2)) for i in range(60)]
    model = quality.fit(spark.createDataFrame([(i, a if i % 2 else "||| !!!") for i in range(60)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality double"))
    assert quality.scored(d, model, names=("s", "p")).columns == [*d.columns, "s", "p"]


def test_exact_dedup_salts_hot_recipes(spark):
    rows = [(i, "same") for i in range(2500)] + [(i, "other %d" % (i % 50)) for i in range(2500, 3000)]
    got = {(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 2500)} | {(2500 + i, 10) for i in range(50)}


def test_passages_recall(spark):
    """Exact and near passages of 55 to 90 words under a frequent line: of every document that repeats one, some earlier document is named."""
    rng = np.random.default_rng(12)
    fresh = lambda n: ["u%d" % i for i in rng.integers(0, 10**9, n)]
    line, rows, places, near = fresh(12), [], {}, set()
    for p in range(40):
        passage = fresh(int(rng.integers(20, 35))) + line + fresh(int(rng.integers(23, 43)))
        for i in range(6):
            words = list(passage)
            if i == 4:
                words[15] = "changed"
                near.add(len(rows))
            start = int(rng.integers(0, 60))
            places[len(rows)] = (p, start, start + len(words))
            rows.append(fresh(start) + words + fresh(40))
    rows += [fresh(50) + line + fresh(50) for _ in range(100)]
    order = rng.permutation(len(rows))
    d = spark.createDataFrame([(int(order[i]), " ".join(w)) for i, w in enumerate(rows)] + [(None, " ".join(rows[0])), (int(order[0]), " ".join(rows[0]))], "doc_id long, text string")
    got = passages.repeated_passages(d).collect()
    back = {int(k): i for i, k in enumerate(order)}
    assert all(r.match_doc_id < r.doc_id and back[r.doc_id] in places and places[back[r.doc_id]][0] == places[back[r.match_doc_id]][0] for r in got)
    found = {back[r.doc_id] for r in got if r.end_word - r.start_word >= 50}
    first = {p: min(int(order[i]) for i, x in places.items() if x[0] == p) for p in range(40)}
    want = [i for i, x in places.items() if int(order[i]) != first[x[0]]]
    assert sum(i in found for i in want if i not in near) == sum(i not in near for i in want)
    assert sum(i in found for i in want) >= 0.9 * len(want)


def test_pii_base_spans_equal_plain_patterns_and_planted_forms_are_found(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, s):
        n = "".join(c for c in s if c.isdigit())
        return {"email": True, "ip": all(int(x) < 256 for x in s.split(".")) if kind == "ip" else 0, "card": 12 <= len(n) <= 19 and pii.luhn(n or "0"), "phone": 9 <= len(n) <= 15}[kind]

    brute = lambda t: sorted(((m.start(), m.end(), k) for k in plain for m in re.finditer(plain[k], t) if holds(k, m.group())), key=lambda s: (s[0], pii.KINDS.index(s[2])))
    rows = d.collect()
    texts = [(r.doc_id, r.text) for r in rows] + [(10**6, "7" * 30000), (10**6 + 1, "1.2.3.4.5.6.7.8 300.1.1.1"), (10**6 + 2, None)]
    want = {i: hashlib.sha256(pii.joined(brute(t or "")).encode()).hexdigest() for i, t in texts}
    model = pii.fit(d)
    assert max(model["thresholds"].values()) < 1
    got = pii.find(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == want
    found = lambda t: [t[a:b] for a, b, _ in pii.all_spans(t, model)[1]]
    assert found("write to jane.roe (at) example (dot) org please") and found("call (743) 555-3824 today") and found("paid with 4111/1111/1111/1111 then")
    assert found("write to jane.roe at mail dot example dot org please") and found("paid with 3782_822463_10005 then") and found("ring 0049-30-555 3824 today")
    assert not found("paid with 4111/1111/1111/1112 then") and not found("version 10.2 of 2024-10-12 at 12:30") and not found("they met at noon")


def test_packing_keeps_what_the_rule_placed():
    rng = np.random.default_rng(3)
    packer, total = packing.SumOfSquares(64, most_open=4000), 0
    for i in range(3000):
        n = int(rng.integers(1, 150))
        packer.add(i, np.arange(n, dtype=np.uint32) + 1000 * i)
        total += n
    packer.flush()
    sizes = [sum(len(p[2]) for p in w) for w in packer.done]
    assert sum(sizes) == total and sum(s != 64 for s in sizes) <= 7 and all(s & (s - 1) == 0 for s in sizes)
    seen = sorted(x for w in packer.done for _, _, ids in w for x in ids.tolist())
    assert len(set(seen)) == total
    assert all(int(ids[0]) - 1000 * doc == start for w in packer.done for doc, start, ids in w)


def test_expected_counts_equal_forward_backward():
    """Documents longer than a segment, counted exactly where the overlap has forgotten its start."""
    rng = np.random.default_rng(1)
    m = hmm.Model.initial(3)
    docs_ = [np.append(rng.integers(0, 50, n), hmm.END).astype(np.uint16) for n in (1, 700, 30, 0)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES + 1))
    for s in docs_:
        b = m.emit[:, s].T
        a, z = np.zeros((len(s), 3)), np.ones((len(s), 3))
        for t in range(len(s)):
            a[t] = (a[t - 1] @ m.move if t else m.start) * b[t]
            a[t] /= a[t].sum()
        for t in range(len(s) - 2, -1, -1):
            z[t] = m.move @ (b[t + 1] * z[t + 1])
            z[t] /= z[t].sum()
        g = a * z
        g /= g.sum(axis=1, keepdims=True)
        start += g[0]
        for t in range(1, len(s)):
            x = np.outer(a[t - 1], b[t] * z[t]) * m.move
            move += x / x.sum()
        np.add.at(emit.T, s, g)
    for x, y in zip((start, move, emit), hmm.expected_counts(m, np.concatenate(docs_))):
        assert np.allclose(x, y, rtol=2e-3, atol=2e-3)


def test_start_of_the_language_model_takes_whole_documents_within_its_budget(spark):
    sizes = [3, 50, 1000, 7, 7, 400, 20, 1]
    rows = [(i, n, np.full(n, i, "<u2").tobytes()) for i, n in enumerate(sizes)] + [(6, 20, np.full(20, 6, "<u2").tobytes())] * 3
    sequences = spark.createDataFrame([(k, n, bytearray(s)) for k, n, s in rows], "key long, n_tokens long, symbols binary")
    total = sum(n for _, n, _ in rows)
    for most in (0, 1, 60, 500, total):
        got = hmm.start_documents(sequences, total if most > 60 else 1, most)
        assert sum(map(len, got)) <= most
        assert all(len(x) == sizes[x[0]] and (x == x[0]).all() for x in got)
        assert sum(x[0] == 6 for x in got) in (0, 4)
    assert len(got) == len(rows)


def test_the_language_model_starts_from_all_documents(spark):
    """Every pair of neighbours counts, also of a document of 450,000 symbols: the start equals rounds over the pairs by hand."""
    rng = np.random.default_rng(5)
    docs_ = [np.append(rng.integers(*span, n), hmm.END).astype("<u2") for span, n in (((0, 30), 40), ((60, 70), 0), ((4000, 4040), 450_000), ((20, 90), 3000), ((0, 5), 1))]
    sequences = spark.createDataFrame([(bytearray(x.tobytes()),) for x in docs_], "symbols binary").repartition(3)
    seen = Counter((int(a), int(b)) for x in docs_ for a, b in zip(np.append(hmm.END, x[:-1]), x))
    m, held = hmm.Model.initial(3), np.full(3, 1 / 3)
    for _ in range(2):
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES + 1))
        for (a, b), n in seen.items():
            if a == hmm.END:
                p = m.start * m.emit[:, b]
                start += n * p / p.sum()
                emit[:, b] += n * p / p.sum()
            else:
                p = (held * m.emit[:, a])[:, None] * m.move * m.emit[:, b]
                p *= n / p.sum()
                move += p
                emit[:, a] += p.sum(axis=1)
                emit[:, b] += p.sum(axis=0)
        m, held = hmm.Model.from_counts(start, move, emit), (move.sum(axis=1) + 0.1) / (move.sum() + 0.3)
    got = hmm.start_model(sequences, 3, 2)
    for x, y in ((got.start, m.start), (got.move, m.move), (got.emit, m.emit)):
        assert np.allclose(x, y, rtol=1e-3, atol=1e-6)
    assert got.emit[:, 4000:4040].sum(axis=1).min() > 0.9
    assert hmm.start_model(sequences.filter("false"), 3, 2).emit.tolist() == hmm.Model.initial(3).emit.tolist()


def test_pii_proposals_hold_every_disguise_and_cost_their_length():
    rng, kinds = np.random.default_rng(4), {"email": "jane.roe@mail.example.org", "ip": "10.20.30.40", "card": "4111 1111 1111 1111", "phone": "+1 (743) 555-3824"}
    for kind, span in kinds.items():
        for _ in range(200):
            good, _ = pii.disguises(span, kind, rng)
            text = f"so {good} then"
            assert any(k == kind and abs(a - 3) <= 1 and abs(b - 3 - len(good)) <= 1 for a, b, k in pii.proposals(text)), (kind, good)
    for unit in ("a", "1", "1 ", "1.", "a.", "(", "a@", "a at ", "1-1/", "4111 "):
        assert all(0 <= a < b <= 200_000 for a, b, _ in pii.proposals(unit * (200_000 // len(unit))))
