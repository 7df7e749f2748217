"""Registered queries of the stored keyword index, weighted fields and weights by the query's shape."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lodestone.config import FIELD_WEIGHTS
from lodestone.functions import text as X
from lodestone.operators import index as I
from lodestone.operators import retrieval as R
from lodestone.operators import segments as G
from lodestone.operators.common import shared_folder
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval_queries import BODY, DEPTH, K, VEC, asked, vector_list
from lodestone.plans.search import hybrid_search, weighted_by_shape

TEN = f"SELECT query, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ({S.ranked('bm', K)})"


def _place(spark, what: str) -> str:
    return os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")


def _ten(scored):
    return R.top_k(scored, K, "query", "doc_id").select("query", "doc_id", R.rounded("score").alias("score"), "rank")


@query("s15_stored_index", sql=f"WITH {S.bm25()} {TEN}")
def s15(spark, sf):
    """Documents indexed to Parquet, then searched there."""
    path = _place(spark, "index")
    I.build(table(spark, sf, "documents"), "doc_id", BODY, path)
    return _ten(I.search(spark, path, "doc_id", asked(spark, sf)))


@query("z3_index_by_offset", sql=f"WITH {S.bm25()} {TEN}")
def z3(spark, sf):
    """The first half of the documents indexed, the rest taken in from the covered offset on: the same lists as from one index."""
    docs, path = table(spark, sf, "documents"), _place(spark, "index")
    half = docs.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0]
    I.build(docs.where(F.col("doc_id") <= F.lit(half)), "doc_id", BODY, path)
    I.sync(docs, "doc_id", BODY, path)
    return _ten(I.search(spark, path, "doc_id", asked(spark, sf)))


LIVING = S.bm25().replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 3)", 1)


@query("z3_index_revised", sql=f"WITH {LIVING} {TEN}")
def z3_revised(spark, sf):
    """An index of other versions of two thirds of the documents and of some that are no more, brought up to date, a part forgotten, tails merged."""
    docs, path = table(spark, sf, "documents").select("doc_id", "text"), _place(spark, "index")
    first = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.lower("text")).when(F.col("doc_id") % 5 == 2, F.lit("an earlier version")).otherwise(F.col("text")))
    strangers = docs.where("doc_id % 11 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    G.sync(first.unionByName(strangers), "doc_id", BODY, path)
    G.sync(docs, "doc_id", BODY, path)
    G.drop_unlisted(spark, path)  # nothing else reads this index
    G.forget(spark, path, docs.where("doc_id % 7 = 3").select(F.col("doc_id").alias("key")))
    G.merge_tail(spark, path, most=2)
    G.drop_unlisted(spark, path)
    return _ten(G.search(spark, path, "doc_id", asked(spark, sf)))


@query("w9_forgotten_in_index", sql=f"WITH t AS (SELECT doc_id, len({S.terms('text')}) AS l FROM documents) SELECT count(*) AS n, sum(l)::BIGINT AS total, count(*) FILTER (l = 0) AS empty FROM t WHERE doc_id % 7 <> 3")
def w9_index(spark, sf):
    """What the index holds after documents were forgotten, from its own rows."""
    docs, path = table(spark, sf, "documents").select("doc_id", "text"), _place(spark, "index")
    G.sync(docs, "doc_id", BODY, path)
    G.forget(spark, path, docs.where("doc_id % 7 = 3").select(F.col("doc_id").alias("key")))
    return G.documents(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.count_if(F.col("len") == 0).alias("empty"))


FIELDS = f"list_concat({', '.join([S.terms('source')] * FIELD_WEIGHTS['title'] + [S.terms('lang')] * FIELD_WEIGHTS['context'] + [S.terms('text')])})"


@query("t2_weighted_fields", sql=f"WITH {S.bm25(FIELDS)} {TEN}")
def t2w(spark, sf):
    """The source stands for a title, the language for a context."""
    fields = {"source": FIELD_WEIGHTS["title"], "lang": FIELD_WEIGHTS["context"], "text": FIELD_WEIGHTS["body"]}
    return _ten(R.bm25(table(spark, sf, "documents"), "doc_id", fields, asked(spark, sf)))


SHAPED = "CASE WHEN item_id % 2 = 0 THEN text ELSE string_split(text, ' ')[1] || '_' || string_split(text, ' ')[2] END"


WEIGHTS = f"wts AS (SELECT item_id AS query, CASE WHEN NOT regexp_matches(trim(t), '\\s') AND regexp_matches(trim(t), '_|::|[a-z][A-Z]|[A-Za-z][0-9]|^[A-Z][A-Z0-9]{{2,}}$|\\(\\)$') THEN 0.3 ELSE 0.6 END AS wt FROM (SELECT item_id, {SHAPED} AS t FROM benchmark))"


@query("o3_weight_by_shape", sql=f"WITH {S.bm25(asked=SHAPED)}, {WEIGHTS}, {VEC}, kw AS ({S.ranked('bm', DEPTH)}), sem AS ({S.ranked('vs', DEPTH)}), lists AS (SELECT query, 0 AS list_no, rank, doc_id, score FROM kw UNION ALL SELECT query, 1, rank, doc_id, score FROM sem), mm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM lists WINDOW w AS (PARTITION BY query, list_no)), f AS (SELECT query, doc_id, sum(s * CASE list_no WHEN 0 THEN 1 - wt ELSE wt END) AS score, min({{'l': list_no, 'r': rank}}) AS first FROM mm JOIN wts USING (query) GROUP BY query, doc_id) SELECT query, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first.l, first.r, doc_id))::INT AS rank FROM f QUALIFY rank <= 10")
def o3w(spark, sf):
    """Every other item is asked for by its first two words put together, as a name in code would be."""
    words = F.split("text", " ")
    shaped = F.when(F.col("query") % 2 == 0, F.col("text")).otherwise(F.concat(F.try_element_at(words, F.lit(1)), F.lit("_"), F.try_element_at(words, F.lit(2))))
    queries = asked(spark, sf).withColumn("text", shaped)
    kw = R.top_k(R.bm25(table(spark, sf, "documents"), "doc_id", BODY, queries, best=DEPTH), DEPTH, "query", "doc_id")
    sem = vector_list(spark, sf)
    lists = kw.select("query", F.lit(0).alias("list_no"), "rank", "doc_id", "score").union(sem.select("query", F.lit(1).alias("list_no"), "rank", "doc_id", "score"))
    lists, weight = weighted_by_shape(lists, queries)
    return R.fused_order(R.score_fusion(lists, "doc_id", weight), "doc_id", K).select("query", "doc_id", R.rounded("score").alias("score"), "rank")


@query("t2_counted_terms", sql=f"SELECT doc_id, list_aggregate(list_sort({S.terms('text')}), 'string_agg', ' ') AS terms FROM documents WHERE len({S.terms('text')}) > 0")
def t2c(spark, sf):
    """The terms that an index counts, in order."""
    return table(spark, sf, "documents").where(F.size(X.counted_terms("text")) > 0).select("doc_id", F.array_join(F.array_sort(X.counted_terms("text")), " ").alias("terms"))


PLAIN = WEIGHTS.replace(SHAPED, "text")


@query("g8_hybrid_by_index", sql=f"WITH {S.bm25()}, {PLAIN}, {VEC}, kw AS ({S.ranked('bm', DEPTH)}), sem AS ({S.ranked('vs', DEPTH)}), lists AS (SELECT query, 0 AS list_no, rank, doc_id, score FROM kw UNION ALL SELECT query, 1, rank, doc_id, score FROM sem), mm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM lists WINDOW w AS (PARTITION BY query, list_no)), f AS (SELECT query, doc_id, sum(s * CASE list_no WHEN 0 THEN 1 - wt ELSE wt END) AS score, min({{'l': list_no, 'r': rank}}) AS first, array_to_string(list_sort(list_distinct(list(CASE list_no WHEN 0 THEN 'keyword' ELSE 'semantic' END))), ',') AS matched FROM mm JOIN wts USING (query) GROUP BY query, doc_id), best AS (SELECT query, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first.l, first.r, doc_id))::INT AS rank, matched FROM f QUALIFY rank <= 10) SELECT * FROM best WHERE doc_id IN (SELECT doc_id FROM documents)")
def g8_index(spark, sf):
    """The whole of a hybrid search, its keyword list from a stored index: the ten best of every item."""
    docs, path = table(spark, sf, "documents"), _place(spark, "index")
    G.sync(docs.select("doc_id", "text"), "doc_id", BODY, path)
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    items = asked(spark, sf).join(e, F.col("doc_id") == F.col("query"), "left").select("query", "text", F.col("embedding").alias("qv"))
    found = hybrid_search(docs, "doc_id", "text", e, "embedding", items, index=path)
    return found.select("query", "doc_id", R.rounded("score").alias("score"), "rank", "matched")
