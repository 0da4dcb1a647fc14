import harness
import pytest

from corpusloom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = harness.compare(spark, SF, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_queries_see_whole_texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    texts = {k: v for k, v in docs.items() if v is not None}
    q = lambda name: catalogue.QUERIES[name](spark, SF).collect()
    assert {r.i: r.s for r in q("game_text_filter") if r.i < 1000000000} == texts
    assert {r.i - 1000000000 for r in q("technical_filter") if r.i >= 1000000000} == set(texts)
    assert {r.doc_id for r in q("token_multiset_check")} == set(texts)
    assert {r.key for r in q("priority_union") if r.origin == "loose"} == set(docs)
