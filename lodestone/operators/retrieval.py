"""Keyword index, BM25, vector scan, rank and score fusion, snippets, neighbours, evaluation."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import B, DECIMALS, K1, RRF_K
from lodestone.functions.terms import terms as all_terms
from lodestone.functions.text import counted_terms, query_terms
from lodestone.operators.common import cut, is_small, pieces, spread

#: Queries that travel to a vector scan together.
QUERIES_AT_ONCE = 10_000
#: So many scores, or places where a term is asked for, are held at once while a batch is scored; so many rows are handed on together.
CELLS, ROWS_OUT = 1 << 21, 1 << 16

rounded = lambda c: F.round(c, DECIMALS)


def terms_of(docs: DataFrame, key: str, fields: dict[str, int], *more: Column, parts: int | None = None) -> DataFrame:
    """key, ts, len: the terms of all fields with their weights, and the weighted length; tokenised once.

    With ``parts`` the documents are dealt by their key first: their terms, many times as many rows, are then counted without a shuffle.
    """
    dealt = spread(docs) if parts is None else docs.repartition(parts, key)
    arrays = dealt.select(key, *more, *[F.coalesce(counted_terms(f), F.array().cast("array<string>")).alias(f"_t{i}") for i, f in enumerate(fields)])
    with_weight = lambda w: lambda x: F.struct(x.alias("term"), F.lit(w).alias("w"))  # noqa: E731  a second parameter would be the index
    weighted = [F.transform(f"_t{i}", with_weight(w)) for i, w in enumerate(fields.values())]
    size = sum((F.size(f"_t{i}") * w for i, w in enumerate(fields.values())), F.lit(0))
    kept = [c for c in arrays.columns if not c.startswith("_t")]
    return arrays.select(*kept, F.concat(*weighted).alias("ts"), size.cast("long").alias("len"))


def exploded(terms: DataFrame, *kept: str) -> DataFrame:
    """One row a term. The outer form, since for the inner one a filter on the whole tokeniser would be inferred below it."""
    return terms.select(*kept, F.explode_outer("ts").alias("_x")).select(*kept, "_x.term", "_x.w").where("term is not null")


def postings(docs: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """key, term, tf: every term with its weighted count; field weights as given."""
    return exploded(terms_of(docs, key, fields), key).groupBy(key, "term").agg(F.sum("w").cast("long").alias("tf"))


def corpus_stats(docs: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """One row: n, total_len, avgdl, over the whole corpus whatever is filtered later; lengths are taken in place."""
    return terms_of(docs, key, fields).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total_len"), F.avg("len").alias("avgdl"))


def counted(terms: DataFrame, *own: str) -> DataFrame:
    """own, term, tf of ``terms_of``, and for each document a row without term whose tf is 1: what statistics are made of."""
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("w")))
    rows = terms.select(*own, F.explode(F.concat("ts", itself)).alias("_x")).select(*own, "_x.term", "_x.w")
    return rows.groupBy(*own, "term").agg(F.sum("w").cast("long").alias("tf"))


def stats_of(rows: DataFrame) -> DataFrame:
    """One row: n, total_len, avgdl from the rows without term."""
    docs = rows.where("term is null")
    n, total = F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum(F.col("len") * F.col("tf")), F.lit(0))
    return docs.agg(n.alias("n"), total.alias("total_len"), F.try_divide(total, n).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.explode(query_terms("text")).alias("term"))


def scored(rows: DataFrame, key: str, asked: DataFrame, few: bool, min_score: float | None = None, kept: Column | None = None) -> DataFrame:
    """query, key, score from rows of ``counted`` that hold at least the terms asked for."""
    mark = F.broadcast if few else (lambda d: d)
    hits = rows.where("term is not null")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.crossJoin(F.broadcast(stats_of(rows))).select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")  # one row of statistics
    found = hits if kept is None else hits.where(kept)
    # postings dealt by document, so that the far more numerous pairs of query and document are summed where they are made
    found = found.repartition(pieces(rows), key) if few else found
    found = found.join(mark(weights), "term").join(mark(asked), "term")
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    out = found.groupBy("query", key).agg(F.sum(part).alias("score"))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def asked_counts(docs: DataFrame, key: str, fields: dict[str, int], terms: list[str], keep: Column) -> DataFrame:
    """key, len, _keep, nos, tfs: a row for each document with its weighted length, and of the ``terms`` that it holds the numbers, ascending, and weighted counts."""
    own = docs.select(key, keep.alias("_keep"), *[F.col(f).cast("string").cast("binary").alias(f"_t{i}") for i, f in enumerate(fields)])
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})
    weights = list(fields.values())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            lens, ends, nos, tfs = array("q"), array("i", [0]), array("i"), array("q")
            for texts in zip(*(batch.column(i + 2) for i in range(len(weights)))):
                n, tf = 0, Counter()
                for text, w in zip(texts, weights):
                    if text.is_valid:
                        found = all_terms(text.as_py())
                        n += w * len(found)
                        for t, c in Counter(filter(number.__contains__, found)).items():
                            tf[number[t]] += w * c
                lens.append(n)
                nos.extend(held := sorted(tf))
                tfs.extend(map(tf.__getitem__, held))
                ends.append(len(nos))
            each = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens, pa.int64()), batch.column(1), each(nos, pa.int32()), each(tfs, pa.int64())], [key, "len", "_keep", "nos", "tfs"])

    return spread(own, key).mapInArrow(task, f"{key} {docs.schema[key].dataType.simpleString()}, len long, _keep boolean, nos array<int>, tfs array<long>")


def best_cells(scores: np.ndarray, rank: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Column and row of what was found in ``scores`` (rows x queries) and can be among a query's k best: no more of one score than the k first by ``rank``."""
    found = scores > 0
    if k is not None and len(scores) > k:
        # scores that differ by less may be equal once they are rounded
        found &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] - 2e-9
    of, row = np.nonzero(found.T)
    if k is None or len(scores) <= k:
        return of, row
    score = scores[row, of]
    order = np.lexsort((rank[row], -score, of))
    of, row, score = of[order], row[order], score[order]
    at = np.arange(len(of))
    begins = np.ones(len(of), bool)
    begins[1:] = (of[1:] != of[:-1]) | (score[1:] != score[:-1])
    first = at - np.maximum.accumulate(np.where(begins, at, 0)) < k
    return of[first], row[first]


def scored_in_batches(rows: DataFrame, key: str, query_kind: str, asked: pa.Table, best: int | None, merge: bool) -> DataFrame:
    """query, key, score of rows of ``asked_counts``; the queries and their terms, which are few, travel to the rows.

    With ``best`` a batch keeps what can be among the best of a query, so that pairs do not grow with queries x rows.
    ``merge``: a row may have a number more than once.
    """
    names, terms = (asked.column(c).combine_chunks().dictionary_encode("encode") for c in ("query", "term"))
    n_terms, n_queries = len(terms.dictionary), len(names.dictionary)
    of, no = (np.asarray(x.indices, dtype=np.int64) for x in (names, terms))
    of = of[np.argsort(no, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(no, minlength=n_terms))])  # a term's queries are of[start[no]:start[no + 1]]
    held = F.array_distinct("nos") if merge else F.col("nos")
    copies = F.col("copies") if merge else F.lit(1)
    stats = rows.agg(F.sum(copies).alias("n"), F.sum(F.col("len") * copies).alias("total")).first()
    df = np.zeros(n_terms)
    for r in rows.select(F.explode(held).alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r["no"]] = r["df"]
    n, avgdl = stats["n"] or 0, (stats["total"] or 0) / max(stats["n"] or 0, 1)
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = rows.sparkSession.sparkContext.broadcast((names.dictionary, of, start, weight))
    at_once, together = max(1, CELLS // max(n_queries, 1)), max(1, CELLS // max(len(of), 1))

    def block(rows: pa.RecordBatch) -> np.ndarray:
        """Rows x queries; a few rows at a time, since each term stands for all its queries."""
        _, of, start, weight = shared.value
        size, out = rows.column("len").to_numpy(), np.zeros((rows.num_rows, n_queries))
        for i in range(0, len(size), together):
            part = rows.slice(i, together)
            many = pc.list_value_length(part.column("nos")).to_numpy()
            doc, no, tf = np.repeat(np.arange(len(many)), many), part.column("nos").flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(float)
            if merge:
                cell, to = np.unique(doc * n_terms + no, return_inverse=True)
                doc, no, tf = cell // n_terms, cell % n_terms, np.bincount(to, tf, len(cell))
            gain = weight[no] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[i : i + together][doc] / avgdl))
            times = start[no + 1] - start[no]
            hit = np.repeat(np.arange(len(no)), times)
            query = of[np.arange(len(hit)) - np.repeat(np.cumsum(times) - times - start[no], times)]
            out[i : i + together] = np.bincount(doc[hit] * n_queries + query, gain[hit], len(many) * n_queries).reshape(-1, n_queries)
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows if n_queries else 0, at_once):
                part = batch.slice(i, at_once)
                scores = block(part)
                rank = np.empty(len(scores), np.int64)
                rank[pc.sort_indices(part.column(key), null_placement="at_start").to_numpy()] = np.arange(len(scores))
                query, row = best_cells(scores, rank, best)
                for j in range(0, len(row), ROWS_OUT):
                    q, r = query[j : j + ROWS_OUT], row[j : j + ROWS_OUT]
                    yield pa.RecordBatch.from_arrays([shared.value[0].take(pa.array(q)), part.column(key).take(pa.array(r)), pa.array(scores[r, q])], ["query", key, "score"])

    kind = rows.schema[key].dataType.simpleString()
    kept = rows.where("_keep").select(key, "len", "nos", "tfs")
    return kept.mapInArrow(task, f"query {query_kind}, {key} {kind}, score double")


def bm25(docs: DataFrame, key: str, fields: dict[str, int], queries: DataFrame, min_score: float | None = None, keep: Column | None = None, best: int | None = None) -> DataFrame:
    """query, key, score for every pair with a common term, without a stored index.

    ``queries``: query, text. Documents are tokenised once; a row a document, with its length and its counts of the
    queries' terms, goes to the shared folder, and statistics, document frequencies and scores are read from
    there. Statistics stay those of the whole corpus when ``keep`` filters documents. With ``best`` pairs that cannot
    be among so many first of their query may be left out where they are scored; ``top_k`` decides.
    """
    asked = asked_terms(queries)
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    if is_small(asked):
        found = asked.toArrow()
        terms = found.column("term").combine_chunks().dictionary_encode().dictionary.to_pylist()
        rows = cut(asked_counts(docs, key, fields, terms, kept))
        # a document is one row, unless its key is repeated
        again = not is_small(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), 0)
        if again:
            one = F.collect_list(F.struct("nos", "tfs"))
            rows = rows.groupBy(key, "len", "_keep").agg(F.count(F.lit(1)).alias("copies"), one.alias("_l"))
            rows = cut(rows.select(key, "len", "_keep", "copies", F.flatten("_l.nos").alias("nos"), F.flatten("_l.tfs").alias("tfs")))
        out = scored_in_batches(rows, key, queries.schema["query"].dataType.simpleString(), found, None if again else best, again)
        out = out.groupBy("query", key).agg(F.sum("score").alias("score")) if again else out
        return out if min_score is None else out.where(F.col("score") >= min_score)
    own = [key, "len", "_keep"]
    rows = terms_of(docs, key, fields, kept.alias("_keep"), parts=pieces(docs))
    terms = asked.select("term").distinct().withColumn("_asked", F.lit(True))
    # counted before the terms are shuffled to the queries'
    found = counted(rows, *own).join(terms, "term", "left").where("_asked or term is null").drop("_asked")
    return scored(cut(found), key, asked, False, min_score, F.col("_keep"))


def top_k(scored: DataFrame, k: int, by: str, key: str) -> DataFrame:
    """The k best rows of each ``by`` with their rank; ties to the smaller key. Spark cuts each partition to k rows before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(vectors: DataFrame, vector: str) -> DataFrame:
    """``vectors`` with scale and q: max |x| / 127 (1 for a zero vector), values rounded half away from zero."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    with_scale = vectors.withColumn("scale", F.when(most > 0, most / 127).otherwise(F.lit(1.0)))
    value = lambda x, s: F.greatest(F.lit(-127), F.least(F.lit(127), F.signum(x) * F.floor(F.abs(x.cast("double")) / s + 0.5)))
    return with_scale.withColumn("q", F.transform(vector, lambda x: value(x, F.col("scale")).cast("byte")))


def normalised(vector: str) -> Column:
    """Unit length; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def vector_scores(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """query, key, score of the k rows with the largest product for each query (query, qv): flat scan.

    Queries are few and travel to the scan; each batch keeps k rows a query, so that what is
    shuffled is bounded by batches x queries x k.
    """
    n = queries.count()
    if n > QUERIES_AT_ONCE:  # a scan for each part of the queries
        parts = -(-n // QUERIES_AT_ONCE) + 1
        part = lambda i: vector_scores(vectors, key, vector, queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i), k)
        return reduce(DataFrame.union, map(part, range(parts)))
    asked = queries.select("query", "qv").toPandas()  # counted above
    shared = vectors.sparkSession.sparkContext.broadcast((asked["query"].to_numpy(), np.array(asked["qv"].tolist(), dtype=np.float64)))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        for rows in batches:
            if not len(rows) or not len(names):
                continue
            scores = np.array(rows[vector].tolist(), dtype=np.float64) @ q.T
            keys = rows[key].to_numpy()
            # each query's rows at or above its kth score, all queries in one frame, the k best of each kept
            reached = np.ones(scores.shape, bool) if len(scores) <= k else scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
            of, row = np.nonzero(reached.T)
            order = np.lexsort((keys[row], -scores[row, of], of))
            of, row = of[order], row[order]
            first = np.arange(len(of)) - np.searchsorted(of, of) < k
            of, row = of[first], row[first]
            yield pd.DataFrame({"query": names[of], key: keys[row], "score": scores[row, of]})

    kind = vectors.schema[key].dataType.simpleString()
    part = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(task, f"query long, {key} {kind}, score double")
    return top_k(part, k, "query", key)


def rrf(lists: DataFrame, key: str) -> DataFrame:
    """query, key, score, tags, first_list, best_rank of lists (query, list_no, rank, key): sum of 1 / (60 + rank)."""
    first = F.min(F.struct("list_no", "rank"))
    return lists.groupBy("query", key).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), F.bit_or(F.expr("shiftleft(1, int(list_no))")).alias("tags"), first.alias("_first")).select("query", key, "score", "tags", F.col("_first.list_no").alias("first_list"), F.col("_first.rank").alias("best_rank"))


def score_fusion(lists: DataFrame, key: str, weights: dict[int, float] | Column) -> DataFrame:
    """Min-max over each truncated list (1 where all are equal), weighted sum, absent is 0."""
    w = Window.partitionBy("query", "list_no")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    scaled = lists.withColumn("_s", F.when(span > 0, (F.col("score") - low) / span).otherwise(F.lit(1.0)))
    weight = weights if isinstance(weights, Column) else F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("list_no")]
    first = F.min(F.struct("list_no", "rank"))
    return scaled.withColumn("_w", weight).groupBy("query", key).agg(F.sum(F.col("_s") * F.col("_w")).alias("score"), first.alias("_first")).select("query", key, "score", F.col("_first.list_no").alias("first_list"), F.col("_first.rank").alias("best_rank"))


def fused_order(fused: DataFrame, key: str, k: int) -> DataFrame:
    """Score, then the list given first, the rank in it, the key."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "first_list", "best_rank", key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reranked(fused: DataFrame, key: str, scores: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` of each query by (query, key, rerank); a missing score goes last; the tail keeps its order."""
    head = F.col("rank") <= depth
    joined = fused.join(scores, ["query", key], "left")
    order = Window.partitionBy("query").orderBy((~head).cast("int"), F.when(head, F.coalesce(F.col("rerank"), F.lit(float("-inf")))).desc(), "rank")
    return joined.withColumn("final_rank", F.row_number().over(order))


def metrics(ranks: DataFrame) -> DataFrame:
    """One row of hit@1, hit@3, MRR@10 and misses from (query, rank or null)."""
    r = F.col("rank")
    at = lambda n: rounded(F.avg(F.when(r <= n, 1.0).otherwise(0.0)))
    return ranks.agg(F.count(F.lit(1)).alias("queries"), at(1).alias("hit1"), at(3).alias("hit3"), rounded(F.avg(F.when(r <= 10, 1 / r).otherwise(0.0))).alias("mrr10"), F.sum(r.isNull().cast("long")).alias("missed"))


def bootstrap(values: np.ndarray, resamples: int = 2000, seed: int = 0) -> tuple[float, float, float]:
    """Mean and 95 % interval of resampled means."""
    rng = np.random.default_rng(seed)
    if not len(values):
        return 0.0, 0.0, 0.0
    means = np.sort(values[rng.integers(0, len(values), (resamples, len(values)))].mean(axis=1))
    return float(values.mean()), float(means[int(0.025 * resamples)]), float(means[int(0.975 * resamples) - 1])
