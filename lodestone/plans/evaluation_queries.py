"""Registered queries of the evaluation: bootstrap, paired runs, weights by cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import identifier_shaped
from lodestone.operators import evaluation as V
from lodestone.operators import retrieval as R
from lodestone.operators.common import cut
from lodestone.plans import sqltext as S
from lodestone.plans.index_queries import SHAPED, WEIGHTS
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval_queries import BODY, DEPTH, FIRST, LISTS, RELEVANT, VEC, asked, first_rank, keyword_list, relevant, vector_list

COPIES = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in V.POISSON)


def _replicates(values: str) -> str:
    """CTEs from x(query, values...) to rep(replicate, values...)."""
    names = values.split(", ")
    return f"""h AS (SELECT x.*, r AS replicate, ('0x' || substr(md5('0:' || query || ':' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM x CROSS JOIN range({V.RESAMPLES}) t(r)),
n AS (SELECT *, {COPIES} AS n FROM h),
rep AS (SELECT replicate, {', '.join(f'CASE WHEN sum(n) > 0 THEN sum(n * {v}) / sum(n) ELSE 0 END AS {v}' for v in names)} FROM n GROUP BY replicate)"""


def _ends(v: str, rows: str = "x") -> str:
    return f"SELECT '{v}' AS name, round((SELECT avg({v}) FROM {rows}), 6) AS mean, round(list_sort(list({v}))[{int(0.025 * V.RESAMPLES) + 1}], 6) AS low, round(list_sort(list({v}))[{int(0.975 * V.RESAMPLES)}], 6) AS high FROM rep HAVING count(*) > 0"


SCORES = "x AS (SELECT query, (coalesce(rank, 99) <= 1)::INT::DOUBLE AS hit1, CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END AS mrr10 FROM fr)"


def _scores(ranks):
    r = F.col("rank")
    return ranks.select("query", F.when(r <= 1, 1.0).otherwise(0.0).alias("hit1"), F.when(r <= 10, 1 / r).otherwise(0.0).alias("mrr10"))


@query("a18_bootstrap_intervals", sql=f"WITH {FIRST}, {SCORES}, {_replicates('hit1, mrr10')} {_ends('hit1')} UNION ALL {_ends('mrr10')}")
def a18(spark, sf):
    """hit@1 and MRR@10 of the keyword list with their 95 % intervals, all in aggregates."""
    rows = cut(_scores(first_rank(keyword_list(spark, sf), relevant(spark, sf), asked(spark, sf))))
    return V.intervals(rows, "query", ["hit1", "mrr10"]).select("name", *[R.rounded(F.col(c)).alias(c) for c in ("mean", "low", "high")])


@query("v3_paired_interval", sql=f"""WITH {LISTS}, {RELEVANT}, r AS (SELECT l.query, l.list_no, min(l.rank) AS rank FROM lists l JOIN rel USING (query, doc_id) GROUP BY ALL),
x AS (SELECT q.query, coalesce(CASE WHEN a.rank <= 10 THEN 1.0::DOUBLE / a.rank END, 0) - coalesce(CASE WHEN b.rank <= 10 THEN 1.0::DOUBLE / b.rank END, 0) AS difference FROM (SELECT DISTINCT query FROM rel) q LEFT JOIN r a ON a.query = q.query AND a.list_no = 0 LEFT JOIN r b ON b.query = q.query AND b.list_no = 1),
{_replicates('difference')} SELECT mean, low, high, round((SELECT avg((difference > 0)::INT) FROM rep), 6) AS ahead FROM ({_ends('difference')})""")
def v3(spark, sf):
    """Keyword list against vector list, query by query: the difference of MRR@10, its interval, and how often the former is ahead."""
    rel, items = cut(relevant(spark, sf)), asked(spark, sf)
    a, b = (_scores(first_rank(lists, rel, items)).select("query", F.col("mrr10").alias(name)) for lists, name in ((keyword_list(spark, sf), "a"), (vector_list(spark, sf), "b")))
    return V.paired(cut(a.join(b, "query")), "query", "a", "b").select(*[R.rounded(F.col(c)).alias(c) for c in ("mean", "low", "high", "ahead")])


@query("a19_cross_validated_weights", sql=f"""WITH {S.bm25(asked=SHAPED)}, {WEIGHTS}, {VEC}, {RELEVANT}, kw AS ({S.ranked('bm', DEPTH)}), sem AS ({S.ranked('vs', DEPTH)}),
lists AS (SELECT query, 0 AS list_no, doc_id, score FROM kw UNION ALL SELECT query, 1, doc_id, score FROM sem),
mm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM lists WINDOW w AS (PARTITION BY query, list_no)),
ab AS (SELECT query, doc_id, coalesce(sum(s) FILTER (list_no = 0), 0) AS a, coalesce(sum(s) FILTER (list_no = 1), 0) AS b FROM mm GROUP BY query, doc_id),
g AS (SELECT k / 20.0::DOUBLE AS w FROM range(21) t(k)),
o AS (SELECT query, w, doc_id FROM ab CROSS JOIN g QUALIFY row_number() OVER (PARTITION BY query, w ORDER BY round(a * (1 - w) + b * w, 9) DESC, doc_id) = 1),
hits AS (SELECT o.query, w, (wt = 0.3)::INT AS shape, (EXISTS (SELECT 1 FROM rel r WHERE r.query = o.query AND r.doc_id = o.doc_id))::INT AS hit,
  floor(('0x' || substr(md5('fold:' || o.query), 1, 8))::BIGINT / 4294967296.0::DOUBLE * {V.FOLDS})::INT AS fold FROM o JOIN wts USING (query)),
c AS (SELECT f.fold, shape, w, coalesce(sum(hit) FILTER (hits.fold <> f.fold), 0) AS train, count(*) FILTER (hits.fold <> f.fold) AS trained, count(*) FILTER (hits.fold = f.fold) AS held, coalesce(sum(hit) FILTER (hits.fold = f.fold), 0) AS held_hits
  FROM hits CROSS JOIN (SELECT range::INT AS fold FROM range({V.FOLDS})) f GROUP BY f.fold, shape, w)
SELECT fold, shape, w AS weight, trained, held, held_hits::BIGINT AS held_hits FROM c QUALIFY row_number() OVER (PARTITION BY fold, shape ORDER BY train DESC, round(abs(w - 0.5), 9), w) = 1""")
def a19(spark, sf):
    """The vector list's weight for each fold and shape of query, chosen on the other folds out of 21."""
    words = F.split("text", " ")
    shaped = F.when(F.col("query") % 2 == 0, F.col("text")).otherwise(F.concat(F.try_element_at(words, F.lit(1)), F.lit("_"), F.try_element_at(words, F.lit(2))))
    queries = asked(spark, sf).withColumn("text", shaped)
    kw = R.top_k(R.bm25(table(spark, sf, "documents"), "doc_id", BODY, queries, best=DEPTH), DEPTH, "query", "doc_id")
    lists = kw.select("query", F.lit(0).alias("list_no"), "doc_id", "score").union(vector_list(spark, sf).select("query", F.lit(1).alias("list_no"), "doc_id", "score"))
    hit = V.first_by_weight(cut(lists), "doc_id").join(relevant(spark, sf).distinct().withColumn("_hit", F.lit(1)), ["query", "doc_id"], "left")
    rows = hit.join(queries.select("query", identifier_shaped("text").cast("int").alias("shape")), "query")
    return V.cross_validated(rows.select("query", "shape", "weight", F.coalesce("_hit", F.lit(0)).alias("hit")))
