"""The search without an index: terms from bytes, scores in batches, and no more pairs than can be among the best."""

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.terms import terms
from lodestone.operators import retrieval as R

ODD = [
    "_foo 2ab fooBar HTTPServer a_b __x the The X9 é9É " + "a" * 70 + "BBB " + "é" * 40, None, "", "ABC DEf 12 1 _ __ a1", "Ünï_Cödé日本X2 ＡＢ x😀Y😀1 \x00a\x00B\x7f",
    "a" * 63 + "éb " + "aB" * 50, "a_b_c_d_e_f_g_aa_bb_cc_dd_ee_ff_gg_hh_ii_jj_kk_ll_mm_nn_oo_pp_qq_rr_ss", "x\ty\r\nz\x0bw\x85v\xa0u",
]


def rows(df, key="id"):
    return sorted((r["query"], str(r[key]), round(r["score"], 9)) for r in df.collect())


def test_terms_of_bytes_are_all_terms(spark):
    d = spark.createDataFrame([(x,) for x in ODD], "text string")
    for r in d.select("text", X.all_terms("text").alias("t")).collect():
        assert sorted(terms((r["text"] or "").encode())) == sorted(t.encode() for t in r["t"] or []), r["text"]


def both_ways(monkeypatch, *a, **b):
    """By batches, and by joins as where the queries are many."""
    by_batches = R.bm25(*a, **b)
    with monkeypatch.context() as m:
        m.setattr(R, "is_small", lambda *x: False)
        return by_batches, R.bm25(*a, **b)


def test_scores_in_batches_are_those_of_joins(spark, monkeypatch):
    queries = spark.createDataFrame([(0, "red fox"), (1, "http foo"), (2, "absent"), (3, None), (4, "a the")], "query long, text string")
    texts = [(str(i % 40) if i % 7 else None, x, "fox_Red" if i % 3 else None) for i, x in enumerate(["the red fox", "a fooBar of HTTPServer", "red red red", "the dog and the fox", *ODD] * 5)]
    docs = spark.createDataFrame(texts, "id string, text string, title string")
    for keep in (None, F.col("id") > "2"):
        a, b = both_ways(monkeypatch, docs, "id", {"text": 1, "title": 3}, queries, keep=keep)
        assert rows(a) == rows(b) != []
    a, b = both_ways(monkeypatch, docs.where("id is not null").dropDuplicates(["id"]), "id", {"text": 1}, queries, min_score=0.5)
    assert rows(a) == rows(b) != []
    a, b = both_ways(monkeypatch, docs.limit(0), "id", {"text": 1}, queries)
    assert rows(a) == rows(b) == []


def test_pairs_do_not_grow_with_copies(spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 90)
    queries = spark.createDataFrame([(0, "red fox"), (1, "the"), (2, "dog")], "query long, text string")
    docs = spark.range(4000).select("id", F.when(F.col("id") % 50 == 0, "red dog").otherwise("the red fox").alias("text")).repartition(4).cache()
    few, whole = (R.bm25(docs, "id", {"text": 1}, queries, best=best) for best in (3, None))
    assert whole.count() == 4000 + 3920 + 80
    # a batch here is 30 rows at most; before, every pair was handed on
    assert few.count() <= 3 * 3 * (4000 / 30 + 40)
    assert rows(R.top_k(few, 3, "query", "id")) == rows(R.top_k(whole, 3, "query", "id"))
