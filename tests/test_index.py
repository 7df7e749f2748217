"""A stored index finds what a search over the texts finds, however it came about."""

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import index as I
from lodestone.operators import retrieval as R

TEXTS = ["the red fox", "a fooBar of HTTPServer", None, "", "red red red", "the dog and the fox " + "on " * 300, "x" * 90 + " fox"]


def rows(df):
    return sorted((r["query"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def tables(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, "red fox"), (1, "http foo"), (2, "absent"), (3, None), (4, "the")], "query long, text string")
    return docs, queries


def test_counted_terms_are_all_terms(spark):
    odd = ["_foo 2ab fooBar HTTPServer a_b __x the The X9 é9É " + "a" * 70 + "BBB " + "é" * 40, None, "", "ABC DEf 12 1 _ __ a1", *TEXTS]
    d = spark.createDataFrame([(x,) for x in odd], "text string")
    same = F.array_sort(X.all_terms("text")).eqNullSafe(F.array_sort(X.counted_terms("text")))
    assert d.where(~same).count() == 0


def test_index_equals_search_over_texts(spark, tmp_path):
    docs, queries = tables(spark)
    want = rows(R.bm25(docs, "doc_id", {"text": 1}, queries))
    assert want
    path = f"{tmp_path}/whole"
    I.build(docs, "doc_id", {"text": 1}, path, buckets=3)
    assert rows(I.search(spark, path, "doc_id", queries)) == want
    assert I.sync(docs, "doc_id", {"text": 1}, path) == "current"


def test_index_grows_from_its_offset_and_restarts(spark, tmp_path):
    docs, queries = tables(spark)
    path = f"{tmp_path}/grown"
    I.build(docs.limit(0), "doc_id", {"text": 1}, path)
    assert I.search(spark, path, "doc_id", queries).count() == 0
    for upto in (1, 4, 6):
        assert I.sync(docs.where(F.col("doc_id") <= upto), "doc_id", {"text": 1}, path) == "appended"
    assert I.covered(spark, path)[0] == 6
    assert rows(I.search(spark, path, "doc_id", queries)) == rows(R.bm25(docs, "doc_id", {"text": 1}, queries))
    few = docs.where("doc_id < 3")
    assert I.sync(few, "doc_id", {"text": 1}, path) == "rebuilt"
    assert rows(I.search(spark, path, "doc_id", queries)) == rows(R.bm25(few, "doc_id", {"text": 1}, queries))
    kept = docs.where("doc_id = 0").select("doc_id")
    assert {r[1] for r in rows(I.search(spark, path, "doc_id", queries, keep=kept))} <= {0}


def test_terms_are_counted_without_a_shuffle_of_their_own(spark):
    """Documents dealt by key: one exchange of texts, none of postings."""
    from lodestone.operators import retrieval as R

    docs = spark.range(50).selectExpr("id AS doc_id", "concat('red fox ', id) AS text")
    rows = R.counted(R.terms_of(docs, "doc_id", {"text": 1}, parts=4), "doc_id", "len")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert rows.where("term is not null").count() == 150
