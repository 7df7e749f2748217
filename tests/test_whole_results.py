"""Queries keep all rows that their operator keeps, without a cut by distance or rank."""

from lodestone.operators import retrieval
from lodestone.plans import more_queries, retrieval_queries


def test_late_amendments_count(spark, tmp_path):
    rows = [(1, 7, "purchase", 1.0), (2, 7, "click", 2.0), (900, 7, "click", 3.0), (901, 8, "click", 4.0), (950, 7, "purchase", 5.0), (5000, 7, "click", 6.0), (5001, 9, "purchase", 7.0), (None, 7, "purchase", 8.0), (5002, None, "purchase", 9.0), (5003, None, "click", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in more_queries.h12(spark, str(tmp_path)).collect()}
    assert got == {(1, "purchase", 3, 6.0), (950, "purchase", 1, 6.0), (5001, "purchase", 0, None), (None, "purchase", 0, None), (5002, "purchase", 0, None)}


def test_labels_have_no_rank_limit(spark, tmp_path, monkeypatch):
    full = retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, k, by, key: full(scored, 1, by, key))
    texts = ["old cat dog here", "the old cat dog here " + "and so on " * 50, "concat dogs", "none", "", None, "a red fox ran off", "bored fox rang", "cat  dog"]
    items = ["cat dog", "red fox ran", "none at all", "old cat dog here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in retrieval_queries.relevant(spark, str(tmp_path)).collect())
    assert got == sorted((q, d) for q, i in enumerate(items) for d, t in enumerate(texts) if i is not None and t is not None and i in t)
