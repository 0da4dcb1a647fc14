"""What must not grow with the input: plans without broadcasts of rows, and what is fitted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusloom.llm")
from corpusloom.llm import hmm, quality, simhash, topk  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_broadcasts_no_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert "Broadcast" not in plan(found)
    q = np.floor(256 * x).astype(int)
    scores = {i: sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5] for i in range(0, 300, 20)}
    want = sorted((i, k + 1, j, -s) for i, best in scores.items() for k, (s, j) in enumerate(best))
    assert sorted(map(tuple, found.collect())) == want


def test_simhash_broadcasts_no_probes(spark, tmp_path):
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(-(1 << 62), 1 << 62, 500)).tolist()
    spark.createDataFrame([(f,) for f in fps], "fp long").write.parquet(f"{tmp_path}/fps")
    found = plan(simhash.links(spark.read.parquet(f"{tmp_path}/fps")))
    assert found.count("SortMergeJoin") >= 2
    joins = found.replace("BroadcastHashJoin", "\nBroadcastHashJoin").split("\n")
    assert all("LeftAnti" in j or "LeftSemi" in j for j in joins if j.startswith("BroadcastHashJoin"))


def test_quality_brings_no_lists_of_numbers_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good words number {i} here" if i % 2 else "||| !!!") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    brought, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: brought.append(self.schema.simpleString()) or collect(self))
    assert quality.fit(docs, labels)["network"].p[0].shape[1] == 32
    assert not [x for x in brought if "array" in x or "binary" in x]


def test_hmm_hands_few_counts_of_neighbours_to_python_at_once(spark, monkeypatch):
    """65 blocks of few cells take no room for the other cells, and blocks of many cells lie in several tasks."""
    rng, made = np.random.default_rng(5), []
    monkeypatch.setattr(hmm, "stored", lambda df, name, keep=hmm.stored: made.append(keep(df, name)) or made[-1])
    for tokens in (9000, 4_000_000):
        rows = [(bytearray(np.append(rng.integers(0, hmm.CLASSES, tokens), hmm.END).astype("<u2").tobytes()),) for _ in range(4)]
        hmm.start_model(spark.createDataFrame(rows, "symbols binary"), 2, 1)
        bytes_of = sum((F.length(c) for c, kind in made[-1].dtypes if kind == "binary"), F.lit(0))
        sizes = [r.n for r in made[-1].groupBy(F.spark_partition_id()).agg(F.sum(bytes_of).alias("n")).collect()]
        assert made[-1].count() == 65 and max(sizes) < (1 << 20 if tokens == 9000 else 32 << 20)
