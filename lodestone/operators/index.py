"""Keyword index kept as Parquet: postings by bucket of their term, one segment for each batch of documents.

A search reads the buckets of its terms and the lengths of all documents; texts are not read again.
Postings of one bucket are spread over ``SALTS`` files by document, so that a term of every document
fills no single task. Bucket -1 holds one row a document, from which statistics are made,
and one that counts for nothing, so that an index of no documents can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators.common import is_small, pieces

BUCKETS, SALTS = 64, 4


def bucket(term: Column | str, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(term), F.lit(buckets)), F.lit(0)).cast("int")


def _write(docs: DataFrame, key: str, fields: dict[str, int], path: str, segment: int, mode: str, buckets: int) -> None:
    rows = R.counted(R.terms_of(docs, key, fields, parts=pieces(docs)), key, "len")
    nothing = rows.sparkSession.range(1).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(0).cast("long").alias("len"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
    placed = rows.union(nothing).select(F.col(key).alias("key"), "len", "term", "tf", F.lit(buckets).alias("buckets"), F.lit(segment).alias("segment"), F.when(F.col("term").isNull(), -1).otherwise(bucket("term", buckets)).alias("bucket"))
    spread = placed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions("bucket", "term")
    spread.write.mode(mode).partitionBy("segment", "bucket").parquet(path)


def build(docs: DataFrame, key: str, fields: dict[str, int], path: str, buckets: int = BUCKETS) -> None:
    """The index of ``docs`` in place of whatever ``path`` holds. ``buckets`` should grow with the corpus; a bucket is what a search reads at least."""
    _write(docs, key, fields, path, 0, "overwrite", buckets)


def covered(spark: SparkSession, path: str) -> tuple[int | None, int, int]:
    """(largest key, last segment, buckets) of an index."""
    r = spark.read.parquet(path).where("bucket = -1").agg(F.max("key"), F.max("segment"), F.max("buckets")).first()
    return r[0], -1 if r[1] is None else r[1], r[2] or BUCKETS


def sync(docs: DataFrame, key: str, fields: dict[str, int], path: str) -> str:
    """Takes in documents beyond the largest key that is covered: current, appended, or rebuilt where the log has shrunk below it.

    Keys ascend in an append-only log; a segment becomes visible when its write is committed, so a
    run that was broken off is repeated from the same offset.
    """
    upto, segment, buckets = covered(docs.sparkSession, path)
    newest = docs.agg(F.max(key)).first()[0]
    if upto is not None and (newest is None or newest < upto):
        build(docs, key, fields, path, buckets)
        return "rebuilt"
    if newest is None or newest == upto:
        return "current"
    _write(docs if upto is None else docs.where(F.col(key) > upto), key, fields, path, segment + 1, "append", buckets)
    return "appended"


def search(spark: SparkSession, path: str, key: str, queries: DataFrame, min_score: float | None = None, keep: DataFrame | None = None) -> DataFrame:
    """query, key, score as ``retrieval.bm25`` gives them; ``keep`` holds the keys that a filter leaves, statistics stay the corpus's."""
    rows = spark.read.parquet(path).withColumnRenamed("key", key)
    buckets = covered(spark, path)[2]
    asked = R.asked_terms(queries)
    few = is_small(asked)
    if few:  # counted, and no more numbers than there are buckets
        wanted = [r[0] for r in asked.select(bucket("term", buckets)).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(-1, *wanted))
        terms = F.broadcast(asked.select("term").distinct())
    else:
        terms = asked.select("term").distinct()
    own = rows.select(key, "len", "term", "tf")
    found = own.where("term is not null").join(terms, "term", "left_semi").select(*own.columns)
    out = R.scored(found.union(own.where("term is null")), key, asked, few, min_score)
    return out if keep is None else out.join(keep.select(key), key, "left_semi")
