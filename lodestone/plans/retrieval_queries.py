"""Registered queries of the retrieval side, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.operators.common import bounded, cut, is_small
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query, table

BODY = {"text": 1}
DEPTH, K = 50, 10


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")


def keyword_list(spark: SparkSession, sf: str, k: int = DEPTH) -> DataFrame:
    return R.top_k(R.bm25(table(spark, sf, "documents"), "doc_id", BODY, asked(spark, sf), best=k), k, "query", "doc_id")


def vector_list(spark: SparkSession, sf: str, k: int = DEPTH) -> DataFrame:
    """Documents with a vector (vec_id = doc_id), nearest to the vector numbered like the item."""
    e = table(spark, sf, "embeddings")
    q = e.join(bounded(table(spark, sf, "benchmark").select("item_id")), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query"), F.col("embedding").alias("qv"))
    return R.vector_scores(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", q, k)


def both_lists(spark: SparkSession, sf: str) -> DataFrame:
    kw, sem = keyword_list(spark, sf), vector_list(spark, sf)
    return kw.select("query", F.lit(0).alias("list_no"), "rank", "doc_id", "score").union(sem.select("query", F.lit(1).alias("list_no"), "rank", "doc_id", "score"))


VEC = """
vs AS (SELECT q.vec_id AS query, c.vec_id AS doc_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score
  FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id CROSS JOIN embeddings c)"""
LISTS = f"{S.bm25()}, {VEC}, kw AS ({S.ranked('bm', DEPTH)}), sem AS ({S.ranked('vs', DEPTH)}), lists AS (SELECT query, 0 AS list_no, rank, doc_id, score FROM kw UNION ALL SELECT query, 1, rank, doc_id, score FROM sem)"


@query("t1_tokens", sql=f"SELECT doc_id, len({S.primaries('text')})::INT AS n_primary, len({S.terms('text')})::INT AS n_terms, len(list_distinct({S.terms('text')}))::INT AS n_distinct FROM documents")
def t1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.primary_terms("text")).alias("n_primary"), F.size(X.all_terms("text")).alias("n_terms"), F.size(F.array_distinct(X.all_terms("text"))).alias("n_distinct"))


@query("k_bm25", sql=f"WITH {S.bm25()} SELECT query, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ({S.ranked('bm', K)})")
def t2(spark, sf):
    return keyword_list(spark, sf, K).select("query", "doc_id", R.rounded("score").alias("score"), "rank")


@query("f5_min_score", sql=f"WITH {S.bm25()} SELECT query, count(*) AS hits, round(max(score), 6) AS best FROM bm WHERE score >= 8 GROUP BY query")
def f5(spark, sf):
    return R.bm25(table(spark, sf, "documents"), "doc_id", BODY, asked(spark, sf), min_score=8.0).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), R.rounded(F.max("score")).alias("best"))


@query("t2_filtered_global_stats", sql=f"WITH {S.bm25()} SELECT query, b.doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, b.doc_id))::INT AS rank FROM bm b JOIN documents x ON b.doc_id = x.doc_id AND x.lang = 'en' QUALIFY rank <= 10")
def t2f(spark, sf):
    docs = table(spark, sf, "documents")
    scored = R.bm25(docs, "doc_id", BODY, asked(spark, sf)).join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return R.top_k(scored, K, "query", "doc_id").select("query", "doc_id", R.rounded("score").alias("score"), "rank")


@query("w5_keyword_index", sql=f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def w5(spark, sf):
    return R.postings(table(spark, sf, "documents"), "doc_id", BODY).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("a4_corpus_stats", sql=f"SELECT count(*) AS n, sum(l)::BIGINT AS total_len, round(avg(l), 6) AS avgdl FROM (SELECT len({S.terms('text')}) AS l FROM documents)")
def a4(spark, sf):
    return R.corpus_stats(table(spark, sf, "documents"), "doc_id", BODY).select("n", "total_len", R.rounded("avgdl").alias("avgdl"))


@query("e1_query_terms", sql=f"SELECT item_id, len(list_distinct({S.terms('text')}))::INT AS n, list_aggregate(list_sort(list_distinct({S.terms('text')})), 'string_agg', ' ') AS terms FROM benchmark")
def e1(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(X.query_terms("text")).alias("n"), F.array_join(F.array_sort(X.query_terms("text")), " ").alias("terms"))


@query("q2_vector_topk", sql=f"WITH {VEC} SELECT query, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ({S.ranked('vs', K)})")
def q2(spark, sf):
    return vector_list(spark, sf, K).select("query", "doc_id", R.rounded("score").alias("score"), "rank")


QUANT = "qz AS (SELECT vec_id, label, CASE WHEN m > 0 THEN m / 127 ELSE 1.0 END AS scale, list_transform(embedding, lambda x: greatest(-127, least(127, sign(x::DOUBLE) * floor(abs(x::DOUBLE) / (CASE WHEN m > 0 THEN m / 127 ELSE 1.0 END) + 0.5)))) AS q FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings))"


@query("g1_quantise", sql=f"WITH {QUANT} SELECT vec_id, round(scale, 6) AS scale, list_sum(q)::BIGINT AS q_sum, list_max(q)::BIGINT AS q_max, list_min(q)::BIGINT AS q_min FROM qz")
def g1(spark, sf):
    z = R.quantised(table(spark, sf, "embeddings"), "embedding")
    return z.select("vec_id", R.rounded("scale").alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("q_sum"), F.array_max("q").cast("long").alias("q_max"), F.array_min("q").cast("long").alias("q_min"))


@query("g2_similarity", sql=f"WITH {QUANT}, s AS (SELECT a.vec_id AS query, c.vec_id AS doc_id, c.scale * list_sum(list_transform(list_zip(c.q, e.embedding), lambda z: z[1] * z[2]::DOUBLE)) AS score FROM benchmark b JOIN qz a ON a.vec_id = b.item_id JOIN embeddings e ON e.vec_id = a.vec_id CROSS JOIN qz c) SELECT query, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ({S.ranked('s', K)})")
def g2(spark, sf):
    e = table(spark, sf, "embeddings")
    z = R.quantised(e, "embedding").select(F.col("vec_id").alias("doc_id"), F.transform("q", lambda x: x * F.col("scale")).alias("v"))
    q = e.join(bounded(table(spark, sf, "benchmark").select("item_id")), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query"), F.col("embedding").alias("qv"))
    return R.vector_scores(z, "doc_id", "v", q, K).select("query", "doc_id", R.rounded("score").alias("score"), "rank")


@query("g3_normalise", sql="SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 6) AS total FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def g3(spark, sf):
    v = F.aggregate(R.normalised("embedding"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", R.rounded(v).alias("total"))


@query("g4_without_vector", sql="SELECT lang, count(*) AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) GROUP BY lang")
def g4(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings").select("vec_id")
    return d.select("doc_id", "lang").join(e, F.col("doc_id") == F.col("vec_id"), "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))


@query("g9_model_fingerprint", sql="SELECT sha256('dim=' || max(len(embedding)) || chr(10) || 'rows=' || count(*) || chr(10) || 'labels=' || count(DISTINCT label)) AS fingerprint FROM embeddings")
def g9(spark, sf):
    parts = F.concat_ws("\n", F.concat(F.lit("dim="), F.max(F.size("embedding"))), F.concat(F.lit("rows="), F.count(F.lit(1))), F.concat(F.lit("labels="), F.count_distinct("label")))
    return table(spark, sf, "embeddings").agg(F.sha2(parts, 256).alias("fingerprint"))


@query("o2_rrf", sql=f"WITH {LISTS}, f AS (SELECT query, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, bit_or(1 << list_no)::BIGINT AS tags, min({{'l': list_no, 'r': rank}}) AS first FROM lists GROUP BY query, doc_id) SELECT query, doc_id, round(score, 6) AS score, tags, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first.l, first.r, doc_id))::INT AS rank FROM f QUALIFY rank <= 10")
def o2(spark, sf):
    return R.fused_order(R.rrf(both_lists(spark, sf), "doc_id"), "doc_id", K).select("query", "doc_id", R.rounded("score").alias("score"), F.col("tags").cast("long").alias("tags"), "rank")


SCORED = f"{LISTS}, mm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM lists WINDOW w AS (PARTITION BY query, list_no))"


@query("o3_score_fusion", sql=f"WITH {SCORED}, f AS (SELECT query, doc_id, sum(s * CASE list_no WHEN 0 THEN 0.4 ELSE 0.6 END) AS score, min({{'l': list_no, 'r': rank}}) AS first FROM mm GROUP BY query, doc_id) SELECT query, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first.l, first.r, doc_id))::INT AS rank FROM f QUALIFY rank <= 10")
def o3(spark, sf):
    return R.fused_order(R.score_fusion(both_lists(spark, sf), "doc_id", {0: 0.4, 1: 0.6}), "doc_id", K).select("query", "doc_id", R.rounded("score").alias("score"), "rank")


@query("n5_candidates", sql=f"WITH {LISTS} SELECT coalesce(k.query, s.query) AS query, count(*) AS candidates, count(k.doc_id) AS keyword, count(s.doc_id) AS semantic, sum((k.doc_id IS NOT NULL AND s.doc_id IS NOT NULL)::INT)::BIGINT AS in_both FROM kw k FULL JOIN sem s ON k.query = s.query AND k.doc_id = s.doc_id GROUP BY 1")
def n5(spark, sf):
    k = keyword_list(spark, sf).select("query", "doc_id", F.lit(1).alias("k"))
    s = vector_list(spark, sf).select("query", "doc_id", F.lit(1).alias("s"))
    return k.join(s, ["query", "doc_id"], "full_outer").groupBy("query").agg(F.count(F.lit(1)).alias("candidates"), F.count("k").alias("keyword"), F.count("s").alias("semantic"), F.coalesce(F.sum((F.col("k").isNotNull() & F.col("s").isNotNull()).cast("long")), F.lit(0)).alias("in_both"))


RELEVANT = "rel AS (SELECT b.item_id AS query, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def relevant(spark, sf):
    """query, doc_id of documents that hold an item word for word.

    What stands between two spaces of the item stands so in the document too: the rarest such piece gives the
    candidates, all of them, which are then confirmed. Items without such a piece are laid against every document.
    """
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), asked(spark, sf).withColumnRenamed("text", "needle")
    mark = F.broadcast if is_small(items) else (lambda d: d)
    cut_up = items.withColumn("_p", F.split("needle", " "))
    inner = cut_up.where("size(_p) > 2").select("query", "needle", F.explode(F.array_distinct(F.expr("slice(_p, 2, size(_p) - 2)"))).alias("piece"))
    hits = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("piece")).join(mark(inner.select("piece").distinct()), "piece")
    df = hits.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    rarest = inner.join(df, "piece").groupBy("query", "needle").agg(F.min(F.struct("df", "piece"))["piece"].alias("piece"))
    # found before texts are read again, so that few candidates travel to the texts and no text is shuffled
    pairs = docs.join(bounded(cut(hits.join(mark(rarest), "piece").select("query", "needle", "doc_id").distinct())), "doc_id")
    every = docs.crossJoin(mark(cut_up.where("size(_p) <= 2").select("query", "needle")))
    found = pairs.select("query", "doc_id", "text", "needle").union(every.select("query", "doc_id", "text", "needle"))
    return cut(found.where(F.contains("text", F.col("needle"))).select("query", "doc_id"))  # read more than once


def first_rank(lists, rel, items):
    hit = lists.join(rel, ["query", "doc_id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return items.select("query").join(rel.select("query").distinct(), "query", "left_semi").join(hit, "query", "left")


@query("n19_hits_on_labels", sql=f"WITH {RELEVANT} SELECT query, count(*) AS documents, min(doc_id) AS first FROM rel GROUP BY query")
def n19(spark, sf):
    return relevant(spark, sf).groupBy("query").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))


FIRST = f"{S.bm25()}, {RELEVANT}, kw AS ({S.ranked('bm', DEPTH)}), fr AS (SELECT r.query, min(k.rank) AS rank FROM (SELECT DISTINCT query FROM rel) r LEFT JOIN (SELECT k.* FROM kw k JOIN rel USING (query, doc_id)) k ON k.query = r.query GROUP BY r.query)"


@query("v2_ranks", sql=f"WITH {FIRST} SELECT query, rank::INT AS rank FROM fr")
def v2(spark, sf):
    return first_rank(keyword_list(spark, sf), relevant(spark, sf), asked(spark, sf))


@query("a17_metrics", sql=f"WITH {FIRST} SELECT count(*) AS queries, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS hit1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS hit3, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr10, sum((rank IS NULL)::INT)::BIGINT AS missed FROM fr")
def a17(spark, sf):
    return R.metrics(first_rank(keyword_list(spark, sf), relevant(spark, sf), asked(spark, sf)))


@query("a18_bootstrap")
def a18(spark, sf):
    import numpy as np

    rows = first_rank(keyword_list(spark, sf), relevant(spark, sf), asked(spark, sf)).orderBy("query").collect()  # one row a labelled query
    out = R.bootstrap(np.array([float(r["rank"] == 1) if r["rank"] else 0.0 for r in rows]))
    return spark.createDataFrame([tuple(round(x, 6) for x in out)], "mean double, low double, high double")


@query("a19_fusion_weight_grid", sql=f"WITH {SCORED}, {RELEVANT}, g AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS w), f AS (SELECT w, query, doc_id, sum(s * CASE list_no WHEN 0 THEN 1 - w ELSE w END) AS score, min({{'l': list_no, 'r': rank}}) AS first FROM mm CROSS JOIN g GROUP BY w, query, doc_id), o AS (SELECT w, query, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY w, query ORDER BY round(score, 9) DESC, first.l, first.r, doc_id) = 1) SELECT w, sum((EXISTS (SELECT 1 FROM rel r WHERE r.query = o.query AND r.doc_id = o.doc_id))::INT)::BIGINT AS hit1 FROM o GROUP BY w")
def a19(spark, sf):
    lists = both_lists(spark, sf).withColumn("w", F.explode(F.array(*[F.lit(x / 10) for x in range(0, 11, 2)])))
    lists = lists.withColumn("_q", F.col("query")).withColumn("query", F.struct("w", "query"))
    weight = F.when(F.col("list_no") == 0, 1 - F.col("query.w")).otherwise(F.col("query.w"))
    best = R.fused_order(R.score_fusion(lists, "doc_id", weight), "doc_id", 1).select("query.w", "query.query", "doc_id")
    hit = best.join(relevant(spark, sf).withColumn("hit", F.lit(1)), ["query", "doc_id"], "left")
    return hit.groupBy("w").agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hit1"))


@query("n22_paired_runs", sql=f"WITH {LISTS}, {RELEVANT}, r AS (SELECT l.query, l.list_no, min(l.rank) AS rank FROM lists l JOIN rel USING (query, doc_id) GROUP BY ALL) SELECT q.query, a.rank::INT AS keyword_rank, b.rank::INT AS semantic_rank, (coalesce(1.0::DOUBLE / a.rank, 0) > coalesce(1.0::DOUBLE / b.rank, 0)) AS keyword_better FROM (SELECT DISTINCT query FROM rel) q LEFT JOIN r a ON a.query = q.query AND a.list_no = 0 LEFT JOIN r b ON b.query = q.query AND b.list_no = 1")
def n22(spark, sf):
    rel, items = relevant(spark, sf), asked(spark, sf)
    a = first_rank(keyword_list(spark, sf), rel, items).withColumnRenamed("rank", "keyword_rank")
    b = first_rank(vector_list(spark, sf), rel, items).withColumnRenamed("rank", "semantic_rank")
    mrr = lambda c: F.coalesce(1 / F.col(c), F.lit(0.0))
    return a.join(b, "query").withColumn("keyword_better", mrr("keyword_rank") > mrr("semantic_rank"))


@query("v1_line_bytes", sql="SELECT doc_id, len(l)::INT AS n_lines, (strlen(text) - strlen(l[-1]))::BIGINT AS last_start, strlen(text) AS bytes FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def v1(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.size(lines).alias("n_lines"), (F.octet_length("text") - F.octet_length(F.element_at(lines, -1))).cast("long").alias("last_start"), F.octet_length("text").cast("long").alias("bytes"))


@query("q3_clamped_k", sql=f"WITH {S.bm25()}, c AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) SELECT query, count(*) AS depth FROM c WHERE rank <= greatest(3 * least(greatest(1000, 1), 100), 50) GROUP BY query")
def q3(spark, sf):
    k = min(max(1000, 1), 100)
    return keyword_list(spark, sf, max(3 * k, 50)).groupBy("query").agg(F.count(F.lit(1)).alias("depth"))


@query("f18_identifier_shaped", sql=r"SELECT item_id, (NOT regexp_matches(trim(text), '\s')) AND regexp_matches(trim(text), '_|::|[a-z][A-Z]|[A-Za-z][0-9]|^[A-Z][A-Z0-9]{2,}$|\(\)$') AS identifier FROM benchmark")
def f18(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.identifier_shaped("text").alias("identifier"))


@query("o11_neighbours", sql="WITH h AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') SELECT h.conv_id, h.turn, count(*) AS neighbours, min(c.turn) AS low, max(c.turn) AS high FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 2 AND h.turn + 2 AND c.turn <> h.turn GROUP BY ALL")
def o11(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    hits = c.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.sequence(F.col("turn") - 2, F.col("turn") + 2)).alias("near")).where("near <> turn")
    return hits.join(c.select("conv_id", F.col("turn").alias("near")), ["conv_id", "near"]).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("neighbours"), F.min("near").alias("low"), F.max("near").alias("high"))


@query("g6_rerank_order", sql=f"WITH {S.bm25()}, kw AS ({S.ranked('bm', 20)}) SELECT query, k.doc_id, rank::INT AS rank, (row_number() OVER (PARTITION BY query ORDER BY (rank > 10)::INT, CASE WHEN rank <= 10 THEN -n_chars END DESC, rank))::INT AS final_rank FROM kw k JOIN documents d ON d.doc_id = k.doc_id")
def g6(spark, sf):
    """A stand-in scorer (shorter is better) over the first ten."""
    docs = table(spark, sf, "documents")
    kw = cut(keyword_list(spark, sf, 20))  # 20 rows a query, read twice
    scores = bounded(kw).select("query", "doc_id").join(docs.select("doc_id", (-F.col("n_chars")).cast("double").alias("rerank")), "doc_id")
    return R.reranked(kw, "doc_id", scores, 10).select("query", "doc_id", "rank", "final_rank")
