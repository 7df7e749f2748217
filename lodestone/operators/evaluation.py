"""Evaluation in the cluster: bootstrap intervals by seeded Poisson weights, and fusion weights chosen by cross-validation.

A resample of n rows with replacement gives each row about a Poisson(1) number of copies; drawing that number from a
hash of row and replicate makes every replicate a sum that is combined before the shuffle, in any order, with the same result each
time. Nothing is collected: what is left is one row a replicate, of which the interval's ends are picked by rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES, FOLDS = 2000, 5
#: P(X <= k) of a Poisson(1) variable; 32 bits do not reach further.
POISSON = tuple(accumulate(exp(-1) / factorial(k) for k in range(11)))
WEIGHTS = tuple(k / 20 for k in range(21))


def hashed(*parts: Column) -> Column:
    """A number in [0, 1) from 32 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def copies(u: Column) -> Column:
    """The Poisson(1) number whose share of [0, 1) holds ``u``."""
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def replicates(rows: DataFrame, key: str, values: Sequence[str], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """replicate, and the mean of each value over the rows of that replicate; one without rows has 0."""
    each = rows.select(F.col(key).cast("string").alias("_key"), *values, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"))
    drawn = each.withColumn("_n", copies(hashed(F.lit(str(seed)), F.col("_key"), F.col("replicate").cast("string"))))
    sums = drawn.groupBy("replicate").agg(F.sum("_n").alias("_all"), *[F.sum(F.col("_n") * F.col(v)).alias(v) for v in values])
    return sums.select("replicate", *[F.when(F.col("_all") > 0, F.col(v) / F.col("_all")).otherwise(F.lit(0.0)).alias(v) for v in values])


def intervals(rows: DataFrame, key: str, values: Sequence[str], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """name, mean, low, high of each value: the mean, and the ends of the middle 95 % of the replicates' means."""
    means = replicates(rows, key, values, resamples, seed)
    unpivoted = lambda d, *own: d.select(*own, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values])).alias("_v")).select(*own, "_v.*")
    # as many rows for each value as there are replicates
    placed = unpivoted(means).withColumn("_at", F.row_number().over(Window.partitionBy("name").orderBy("x")))
    at = lambda k: F.max(F.when(F.col("_at") == k, F.col("x")))
    ends = placed.groupBy("name").agg(at(int(0.025 * resamples) + 1).alias("low"), at(int(0.975 * resamples)).alias("high"))
    mean = unpivoted(rows).groupBy("name").agg(F.avg("x").alias("mean"))
    return mean.join(ends, "name").select("name", "mean", "low", "high")


def paired(rows: DataFrame, key: str, a: str, b: str, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """One row: mean, low, high of a - b over rows that have both, and the share of replicates in which a is ahead."""
    difference = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, (F.col(a) - F.col(b)).alias("difference"))
    ahead = replicates(difference, key, ["difference"], resamples, seed).agg(F.avg((F.col("difference") > 0).cast("int")).alias("ahead"))
    return intervals(difference, key, ["difference"], resamples, seed).crossJoin(F.broadcast(ahead)).drop("name")  # one row each


def first_by_weight(lists: DataFrame, key: str, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """query, weight, key: the best candidate of two lists (query, list_no 0 or 1, key, score) for each weight of list 1, in one pass.

    Scores are scaled to 0..1 within a list; ties go to the smaller key. A candidate's line of scores over the weights goes into one aggregate.
    """
    w = Window.partitionBy("query", "list_no")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    scaled = lists.withColumn("_s", F.when(span > 0, (F.col("score") - low) / span).otherwise(F.lit(1.0)))
    of = lambda n: F.coalesce(F.sum(F.when(F.col("list_no") == n, F.col("_s"))), F.lit(0.0))
    pairs = scaled.groupBy("query", key).agg(of(0).alias("_a"), of(1).alias("_b"))
    fused = pairs.select("query", key, *[F.round(F.col("_a") * (1 - x) + F.col("_b") * x, 9).alias(f"_w{k}") for k, x in enumerate(weights)])
    best = fused.groupBy("query").agg(*[F.max_by(key, F.struct(F.col(f"_w{k}"), -F.col(key))).alias(f"_w{k}") for k in range(len(weights))])
    return best.select("query", F.explode(F.array(*[F.struct(F.lit(x).alias("weight"), F.col(f"_w{k}").alias(key)) for k, x in enumerate(weights)])).alias("_x")).select("query", "_x.*")


def cross_validated(hits: DataFrame, folds: int = FOLDS) -> DataFrame:
    """fold, shape, weight, trained, held, held_hits: each fold's weight by shape, chosen on the others, and what it brings on the fold.

    ``hits``: query, shape, weight, hit (0 or 1), a row for every weight. A query's fold comes from a hash of it. The
    best weight is the one of most hits, of those the nearest to 0.5, of those the smaller; a shape without training queries takes 0.5.
    """
    placed = hits.withColumn("fold", F.floor(hashed(F.lit("fold"), F.col("query").cast("string")) * folds).cast("int"))
    cells = placed.groupBy("shape", "weight", "fold").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("shape", "weight")
    grid = cells.select("shape", "weight", F.sum("hits").over(whole).alias("_hits"), F.sum("n").over(whole).alias("_n")).distinct()
    every = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).join(cells, ["shape", "weight", "fold"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    every = every.select("fold", "shape", "weight", (F.col("_hits") - zero("hits")).alias("_train"), (F.col("_n") - zero("n")).alias("trained"), zero("hits").alias("held_hits"), zero("n").alias("held"))
    distance = F.round(F.abs(F.col("weight") - 0.5), 9)
    order = Window.partitionBy("fold", "shape").orderBy(F.desc("_train"), distance, "weight")
    return every.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("fold", "shape", "weight", "trained", "held", "held_hits")
