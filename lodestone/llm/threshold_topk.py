"""Exact top-k inner products by the threshold algorithm over sorted lists, one list a dimension.

Candidates are dealt into blocks by hash of their place in the written table, queries likewise, so that an id or a
vector of very many rows falls into all blocks; each pair of a candidate
block and a query block is one task's work, so a task holds two bounded blocks whatever the size of
the table, and no task sees an unbounded group. In a task each dimension has its list of
candidates in order of the component. The lists are read in rounds of growing depth, from the top
for queries with a positive component and from the bottom for a negative one; rows met for the
first time get their full score (random access). After a round, a query's bound is the sum of its
components times the values at the depth reached: no row not met yet can exceed it. A query ends
when its kth score is above its bound; a score equal to the bound goes on, since a row not met
could tie with a smaller id. The results of the blocks are merged, k rows a query and block.

Components become floor(256 * x) as whole numbers; products are summed exactly (float32 matrix
products while every sum stays under 2^24, float64 under 2^53, Python integers beyond).

Defined cases: a vector that is null or holds a null or non-finite component takes no part,
nor does a row without ``vec_id``. Rows that repeat an id are candidates each; a query's own id is never one,
and the ranks of a query id that is repeated run over all its rows. Vectors of
different lengths are compared as if the shorter ended in zeros, so that an empty one scores 0. Components and
scores beyond 64 bits count as the largest or least such number. With fewer than k candidates all
are returned; an empty table gives an empty result. Other columns are ignored.

The work is queries times candidates in the worst case. With a fiftieth of the rows as queries it
grows with the square of the table; the lists cut it only where components are skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, n_rows

CANDIDATES_A_BLOCK, QUERIES_A_BLOCK = 16_384, 4_096
K = 5
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _matrix(vectors: list, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.stack([np.asarray(v, dtype=np.int64) for v in vectors])
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _typed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = a.shape[1] * np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    return a.astype(kind), b.astype(kind)


def block_topk(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best rows of this block for every query, by the threshold algorithm."""
    order = np.argsort(ids, kind="stable")  # a smaller row number then means a smaller id
    ids, rows = ids[order], rows[order]
    n, dims = rows.shape
    lists = np.argsort(rows, axis=0, kind="stable")
    values = np.take_along_axis(rows, lists, axis=0)
    x, q = _typed(rows, queries)
    met = np.zeros(n, dtype=bool)
    alive = np.arange(len(queries))
    best_score = np.full((len(queries), 0), 0, dtype=object if x.dtype == object else np.float64)
    best_row = np.zeros((len(queries), 0), dtype=np.int64)
    depth = 0
    while len(alive) and depth < n:
        step = max(64, depth)
        to = min(n, depth + step)
        fresh = np.zeros(n, dtype=bool)
        up, down = (queries[alive] > 0).any(axis=0), (queries[alive] < 0).any(axis=0)
        fresh[lists[n - to : n - depth, up].ravel()] = True
        fresh[lists[depth:to, down].ravel()] = True
        fresh &= ~met
        met |= fresh
        rows_now = np.flatnonzero(fresh)
        if len(rows_now):
            scores = q[alive] @ x[rows_now].T
            scores = scores.astype(np.float64) if scores.dtype != object else np.minimum(np.maximum(scores, LEAST), MOST)
            scores[query_ids[alive][:, None] == ids[rows_now][None, :]] = -np.inf
            if len(rows_now) > 4 * k and scores.dtype != object:
                # the kth score of each query; of rows equal to it, those of smaller ids
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
                picked = [np.flatnonzero(s > t)[:k] for s, t in zip(scores, kth, strict=True)]
                picked = [np.concatenate([p, np.flatnonzero(s == t)[: k - len(p)]]) for p, s, t in zip(picked, scores, kth[:, 0], strict=True)]
                picked = np.array(picked)
                scores, where = np.take_along_axis(scores, picked, axis=1), rows_now[picked]
            else:
                where = np.broadcast_to(rows_now, scores.shape)
            scores, where = np.concatenate([best_score[alive], scores], axis=1), np.concatenate([best_row[alive], where], axis=1)
            keep = np.stack([np.array(sorted(range(scores.shape[1]), key=lambda j: (-s[j], w[j]))[:k]) for s, w in zip(scores, where, strict=True)])
            if best_score.shape[1] < keep.shape[1]:
                grown = keep.shape[1] - best_score.shape[1]
                best_score = np.concatenate([best_score, np.full((len(queries), grown), -np.inf, dtype=best_score.dtype)], axis=1)
                best_row = np.concatenate([best_row, np.zeros((len(queries), grown), dtype=np.int64)], axis=1)
            best_score[alive], best_row[alive] = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(where, keep, axis=1)
        depth = to
        if depth < n and best_score.shape[1] == k:
            high, low = values[n - depth - 1].astype(q.dtype), values[depth].astype(q.dtype)
            part = q[alive]
            bound = np.where(part > 0, part * high, part * low).sum(axis=1)
            bound = bound if bound.dtype != object else np.minimum(np.maximum(bound, LEAST), MOST)
            alive = alive[~(best_score[alive, k - 1] > bound)]
    return [
        (int(query_ids[i]), int(ids[best_row[i, j]]), int(best_score[i, j]))
        for i in range(len(queries))
        for j in range(best_score.shape[1])
        if best_score[i, j] != -np.inf
    ]


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of the components of vectors that take part."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    whole = lambda y: F.when(y >= float(MOST), MOST).when(y <= float(LEAST), LEAST).otherwise(F.floor(F.when(F.abs(y) < float(MOST), y).otherwise(0.0)).cast("long"))
    v = F.transform(x, lambda e: whole(e.cast("double") * 256))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", v.alias("v"))


def exact_topk(embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each query row."""
    vectors = cut(integer_vectors(embeddings))
    n = n_rows(vectors)
    # places in the written table do not change if a task is run again
    vectors = vectors.withColumn("_place", F.monotonically_increasing_id())
    queries = vectors.where(is_query)
    n_queries = queries.count()
    blocks, query_blocks = max(1, -(-n // CANDIDATES_A_BLOCK)), max(1, -(-n_queries // QUERIES_A_BLOCK))
    number = lambda many, salt: F.pmod(F.xxhash64(F.lit(salt), "_place"), F.lit(many))
    candidates = vectors.withColumn("_b", number(blocks, "c")).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("_qb", number(query_blocks, "q")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(left) and len(right):
            width = max(max(map(len, left["v"])), max(map(len, right["v"])))
            found = block_topk(left["vec_id"].to_numpy(), _matrix(list(left["v"]), width), right["vec_id"].to_numpy(), _matrix(list(right["v"]), width), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    parts = (
        candidates.groupBy(F.col("_b").cast("long").alias("b"), F.col("_qb").cast("long").alias("q"))
        .cogroup(asked.groupBy(F.col("_b").cast("long").alias("b"), F.col("_qb").cast("long").alias("q")))
        .applyInPandas(task, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
