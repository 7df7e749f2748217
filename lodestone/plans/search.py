"""Hybrid search as one plan: keyword list, vector list, fusion, optional rerank, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT_K, MAX_K, SEMANTIC_WEIGHT, SEMANTIC_WEIGHT_IDENTIFIER
from lodestone.functions.snippet import snippets
from lodestone.functions.text import identifier_shaped, query_terms
from lodestone.operators import retrieval as R
from lodestone.operators import segments
from lodestone.operators.common import bounded, cut


def weighted_by_shape(lists: DataFrame, queries: DataFrame) -> tuple[DataFrame, Column]:
    """``lists`` with each query's weight of the vector list, smaller for a query shaped like an identifier, and the weight of a row."""
    shape = F.when(identifier_shaped("text"), SEMANTIC_WEIGHT_IDENTIFIER).otherwise(SEMANTIC_WEIGHT)
    out = lists.join(bounded(queries.select("query", shape.alias("_shape"))), "query", "left")
    return out, F.when(F.col("list_no") == 0, 1 - F.col("_shape")).otherwise(F.col("_shape"))


def hybrid_search(
    docs: DataFrame,
    key: str,
    text: str,
    vectors: DataFrame | None,
    vector: str,
    queries: DataFrame,
    k: int = DEFAULT_K,
    semantic_weight: float | None = None,
    fusion: str = "score",
    keep: Column | None = None,
    fields: dict[str, int] | None = None,
    index: str | None = None,
) -> DataFrame:
    """query, key, rank, score, matched, snippet for ``queries`` (query, text, qv or null).

    Lists are cut to max(3k, 50) before they are fused. Without vectors, or for queries without
    one, the keyword list alone decides. Statistics are the corpus's whatever ``keep`` leaves out.
    ``fields`` weighs columns in the keyword list (the text alone by default); without
    ``semantic_weight`` the query's shape decides it. With ``index``, the folder of a stored index of ``docs``
    (``operators.segments``), the keyword list is read from there and no text is tokenised.
    """
    k = min(max(k, 1), MAX_K)
    depth = max(3 * k, 50)
    asked_for = queries.select("query", "text")
    if index is None:
        found = R.bm25(docs, key, fields or {text: 1}, asked_for, keep=keep, best=depth)
    else:
        found = segments.search(docs.sparkSession, index, key, asked_for, keep=None if keep is None else docs.where(keep).select(key))
    kw = R.top_k(found, depth, "query", key)
    lists = kw.select("query", F.lit(0).alias("list_no"), "rank", key, "score")
    if vectors is not None:
        alive = vectors if keep is None else vectors.join(docs.where(keep).select(key), key, "left_semi")
        sem = R.vector_scores(alive, key, vector, queries.where("qv is not null").select("query", "qv"), depth)
        lists = lists.union(sem.select("query", F.lit(1).alias("list_no"), "rank", key, "score"))
    lists = cut(lists)  # at most two lists of ``depth`` rows a query, read for the order and for what matched
    if fusion == "rrf":
        fused = R.rrf(lists, key)
    elif semantic_weight is None:
        weighed, weight = weighted_by_shape(lists, queries)
        fused = R.score_fusion(weighed, key, weight)
    else:
        fused = R.score_fusion(lists, key, {0: 1 - semantic_weight, 1: semantic_weight})
    best = R.fused_order(fused, key, k)
    matched = lists.groupBy("query", key).agg(F.array_sort(F.collect_set(F.when(F.col("list_no") == 0, "keyword").otherwise("semantic"))).alias("matched"))
    asked = queries.select("query", query_terms("text").alias("terms"))
    found = best.join(matched, ["query", key]).join(asked, "query")
    # the best, where few, travel to the texts, and no text is shuffled
    shown = docs.select(key, text).join(bounded(cut(found)), key)
    return shown.select("query", key, "rank", R.rounded("score").alias("score"), F.concat_ws(",", "matched").alias("matched"), snippets(text, "terms").alias("snippet"))
