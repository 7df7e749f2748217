"""Connected components of a table of links, by alternating stars.

Each round first hangs every node's larger neighbours on its least neighbour, then hangs the rest
likewise; the number of rounds grows with the logarithm of the longest path. Least neighbours are
pre-aggregated before their shuffle and joined back, so that adaptive execution can split a hub.
Links stay in tables; after each round they go to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, n_rows, seen

#: A table counted to have no more links than this is put together in one task, without rounds.
FEW = 10_000


def _by_itself(least: DataFrame) -> DataFrame:
    """The same rows without what is known of their partitioning: the join then shuffles both sides for itself, and adaptive execution can split a hub's links."""
    return least.withColumn("u", F.concat("u", F.lit(b"")) if dict(least.dtypes)["u"] in ("binary", "string") else F.col("u") + 0)


def _star(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: hang u, and what is larger than it or beside it, on the least of v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(_by_itself(least), "u")
    return joined.select(F.col("u"), F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(_by_itself(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _of_few(links: DataFrame) -> DataFrame:
    """The same stars from a table that was counted to hold ``FEW`` links at most: one task puts them together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        if kind is not None:
            pairs = [(x, find(x)) for x in up if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs, strict=True), kind.types, strict=True)], schema=kind)

    return links.coalesce(1).mapInArrow(task, links.schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node that has a link; root is the least node of its component."""
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links, before = cut(links.distinct(), "u", "v"), None
    if 0 < n_rows(links) <= FEW:
        links = _of_few(links)
    else:
        while seen(links) != before and n_rows(links):
            before = seen(links)
            links = cut(_star(_large_star(links)).distinct(), "u", "v")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
