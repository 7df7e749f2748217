"""A keyword index of documents that are revised and forgotten: segments, tombstones, merging.

A change adds a segment: postings of the documents that are new or revised, a row a document, and tombstones
of the versions that they replace or that were forgotten. A tombstone counts against the segments before its own. Nothing that was
written is changed; what belongs to the index is listed in a manifest, written last, so that a change that was
broken off leaves the index as it was.

Number of documents and their total length come from the manifest, lengths stand beside the postings, and
postings lie in ranges of (term, key) sized by their counted rows, so that a search reads the ranges of its terms and the
tombstones, and a term of every document is spread over many files. A tail of segments that together hold as much as the
one before them is merged into one (so a posting is rewritten a logarithmic number of times), and tombstones
end where what they are about is in the same merge.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import B, K1
from lodestone.operators import retrieval as R
from lodestone.operators.common import bounded, cut, is_small, pieces
from lodestone.streaming.tail import versions

POSTINGS_A_FILE = 1_000_000
#: Terms that a search hands to the scan itself.
TERMS_IN_FILTER = 1_000
MOST_SEGMENTS = 8


@dataclass
class Segment:
    """``n`` documents of ``total`` length added, ``gone_n`` of ``gone_total`` buried, of earlier segments."""

    name: str
    n: int
    total: int
    gone_n: int
    gone_total: int


def manifest(spark: SparkSession, path: str) -> list[Segment]:
    """The segments of the index, oldest first; none where there is no index."""
    found = versions(spark, f"{path}/manifests")
    if not found:
        return []
    rows = spark.read.parquet(f"{path}/manifests/{found[-1]:09d}").collect()  # a row a segment
    return [Segment(r.name, r.n, r.total, r.gone_n, r.gone_total) for r in sorted(rows, key=lambda r: r.place)]


def _publish(spark: SparkSession, path: str, segments: list[Segment]) -> None:
    number = max(versions(spark, f"{path}/manifests"), default=-1) + 1
    rows = [(k, s.name, s.n, s.total, s.gone_n, s.gone_total) for k, s in enumerate(segments)]
    frame = spark.createDataFrame(rows, "place int, name string, n long, total long, gone_n long, gone_total long")
    frame.coalesce(1).write.parquet(f"{path}/manifests/{number:09d}")


def _read(spark: SparkSession, path: str, kind: str, segments: list[Segment], first: int = 0) -> DataFrame:
    """Rows of all segments with their ``place``."""
    parts = [spark.read.parquet(f"{path}/{kind}/{s.name}").withColumn("place", F.lit(k)) for k, s in enumerate(segments, first)]
    return reduce(DataFrame.unionByName, parts)


def _without_buried(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return rows
    # the last tombstone of a key is enough
    last = gone.groupBy(F.col("key").alias("_key")).agg(F.max("place").alias("_gone"))
    return rows.join(bounded(last), (F.col("key") == F.col("_key")) & (F.col("place") < F.col("_gone")), "left_anti")


def _tombstones(spark: SparkSession, path: str, segments: list[Segment], first: int = 0) -> DataFrame | None:
    some = [(k, s) for k, s in enumerate(segments, first) if s.gone_n]
    parts = [spark.read.parquet(f"{path}/gone/{s.name}").withColumn("place", F.lit(k)) for k, s in some]
    return reduce(DataFrame.unionByName, parts) if parts else None


def documents(spark: SparkSession, path: str) -> DataFrame | None:
    """key, digest, len, place of the documents that the index holds; None where there is no index."""
    segments = manifest(spark, path)
    return _without_buried(_read(spark, path, "docs", segments), _tombstones(spark, path, segments)) if segments else None


def _write(spark: SparkSession, path: str, postings: DataFrame, docs: DataFrame, gone: DataFrame, n: int) -> Segment:
    """A segment of these rows; ``n`` is the number of postings, or a bound of it, and ``postings`` are read twice, for ranges and rows."""
    name = uuid.uuid4().hex
    docs.select("key", "digest", "len").write.parquet(f"{path}/docs/{name}")
    gone.select("key", "len").write.parquet(f"{path}/gone/{name}")
    ranged = postings.select("term", "key", "len", "tf").repartitionByRange(max(1, -(-n // POSTINGS_A_FILE)), "term", "key").sortWithinPartitions("term", "key")
    ranged.write.parquet(f"{path}/postings/{name}")
    sums = lambda kind: spark.read.parquet(f"{path}/{kind}/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    return Segment(name, *sums("docs"), *sums("gone"))


def digest(fields: dict[str, int]) -> Column:
    """Tells one version of a document from another."""
    return F.sha2(F.concat_ws("\x00", *[F.concat(F.when(F.col(f).isNull(), "0").otherwise("1"), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]).cast("binary"), 256)


def sync(docs: DataFrame, key: str, fields: dict[str, int], path: str, version: Column | None = None, merging: bool = True) -> dict[str, int]:
    """Makes the index that of ``docs`` (one row a key, no null keys): counts of added, revised and forgotten documents.

    ``version`` tells a document's versions apart; without one a digest of the fields does, which reads them all.
    """
    spark = docs.sparkSession
    segments = manifest(spark, path)
    now = docs.select(F.col(key).alias("key"), (digest(fields) if version is None else version.cast("string")).alias("digest"))
    held = documents(spark, path)
    if held is None:
        held = now.limit(0).select("key", "digest", F.lit(0).cast("long").alias("len"))
    both = now.join(held.select("key", F.col("digest").alias("_digest"), F.col("len").alias("_len")), "key", "full_outer")
    state = F.when(F.col("_len").isNull(), "added").when(F.col("digest").isNull(), "forgotten").when(F.col("digest") != F.col("_digest"), "revised")
    changed = cut(both.withColumn("state", state).where("state is not null").select("key", "state", "digest", "_len"))
    counts = {r.state: r["count"] for r in changed.groupBy("state").count().collect()}  # three rows
    found = {s: counts.get(s, 0) for s in ("added", "revised", "forgotten")}
    if not any(found.values()) and segments:
        return found
    fresh = changed.where("state <> 'forgotten'").select("key", "digest")
    wanted = docs.join(fresh.select(F.col("key").alias(key)), key, "left_semi")
    # tokenised once, into a table that is removed with the next lines; digests stay out of the postings
    work = f"{path}/work/{uuid.uuid4().hex}"
    R.counted(R.terms_of(wanted, key, fields, parts=pieces(docs)), key, "len").withColumnRenamed(key, "key").write.parquet(work)
    rows = spark.read.parquet(work)
    postings = rows.where("term is not null")
    gone = changed.where("state <> 'added'").select("key", F.col("_len").alias("len"))
    _publish(spark, path, [*segments, _write(spark, path, postings, rows.where("term is null").select("key", "len").join(fresh, "key"), gone, postings.count())])
    _remove(spark, work)
    if merging:
        merge_tail(spark, path)
    return found


def forget(spark: SparkSession, path: str, keys: DataFrame) -> int:
    """Buries the documents of these keys (key); the number that the index held."""
    held = documents(spark, path)
    if held is None:
        return 0
    gone = cut(held.join(keys.select("key").distinct(), "key", "left_semi").select("key", "len"))
    segment = _write(spark, path, _none(gone, "postings"), _none(gone, "docs"), gone, 0)
    if segment.gone_n:
        _publish(spark, path, [*manifest(spark, path), segment])
    return segment.gone_n


def _none(gone: DataFrame, kind: str) -> DataFrame:
    more = {"postings": {"term": "string", "tf": "long"}, "docs": {"digest": "string"}}[kind]
    return gone.limit(0).withColumns({c: F.lit(None).cast(t) for c, t in more.items()})


def merge_tail(spark: SparkSession, path: str, most: int = MOST_SEGMENTS) -> int:
    """Merges the last segments while they hold as much as the one before, or are too many; the number of segments then."""
    segments = manifest(spark, path)
    first, held = len(segments) - 1, segments[-1].n + segments[-1].gone_n if segments else 0
    while first > 0 and (held >= segments[first - 1].n or first + 1 > most):
        first -= 1
        held += segments[first].n + segments[first].gone_n
    if first >= len(segments) - 1:
        return len(segments)
    return merge(spark, path, first)


def merge(spark: SparkSession, path: str, first: int = 0) -> int:
    """Makes one segment of those from place ``first`` on; the number of segments then."""
    segments = manifest(spark, path)
    tail = segments[first:]
    if len(tail) < 2:
        return len(segments)
    gone = _tombstones(spark, path, tail, first)
    docs, postings = (_without_buried(_read(spark, path, kind, tail, first), gone) for kind in ("docs", "postings"))
    kept = _none(docs.select("key", "len"), "docs").select("key", "len")
    if gone is not None and first:
        # a key's first tombstone here is about an earlier segment unless the document was added here before it
        born = _read(spark, path, "docs", tail, first).groupBy("key").agg(F.min("place").alias("born"))
        oldest = gone.groupBy("key").agg(F.min("place").alias("buried"), F.min_by("len", "place").alias("len"))
        kept = oldest.join(born, "key", "left").where("born is null or buried <= born").select("key", "len")
    n = _read(spark, path, "postings", tail, first).count()  # with those of buried versions
    _publish(spark, path, [*segments[:first], _write(spark, path, postings, docs, kept, n)])
    return first + 1


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_unlisted(spark: SparkSession, path: str) -> int:
    """Removes what no manifest needs any more, once no search that began before the last change runs; the number of segments removed."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, n = {s.name for s in manifest(spark, path)}, 0
    for kind in ("postings", "docs", "gone"):
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")):
            if status.getPath().getName() not in listed:
                fs.delete(status.getPath(), True)
                n += kind == "postings"
    for number in versions(spark, f"{path}/manifests")[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number:09d}"), True)
    return n


def search(spark: SparkSession, path: str, key: str, queries: DataFrame, min_score: float | None = None, keep: DataFrame | None = None) -> DataFrame:
    """query, key, score as ``retrieval.bm25`` gives them; ``keep`` holds the keys that a filter leaves, statistics stay the corpus's."""
    segments = manifest(spark, path)
    if not segments:
        raise ValueError(f"no index at {path}")
    n, total = sum(s.n - s.gone_n for s in segments), sum(s.total - s.gone_total for s in segments)
    asked = R.asked_terms(queries)
    few = is_small(asked)
    mark = F.broadcast if few else (lambda d: d)
    terms = asked.select("term").distinct()
    rows = _read(spark, path, "postings", segments)
    names = [r.term for r in terms.limit(TERMS_IN_FILTER + 1).collect()]  # bounded by the limit
    # terms in the scan's own filter skip whole files; too many for that meet the postings in a join
    rows = rows.where(F.col("term").isin(names)) if len(names) <= TERMS_IN_FILTER else rows.join(mark(terms), "term", "left_semi")
    hits = _without_buried(rows, _tombstones(spark, path, segments)).withColumnRenamed("key", key)
    hits = cut(hits.select(key, "len", "term", "tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.select("term", R.idf(F.lit(n), F.col("df")).alias("idf"))
    tf, average = F.col("tf").cast("double"), total / n if n else 0.0
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide(F.col("len"), F.lit(average))))
    dealt = hits.repartition(pieces(hits), key) if few else hits
    out = dealt.join(mark(weights), "term").join(mark(asked), "term").groupBy("query", key).agg(F.sum(part).alias("score"))
    out = out if min_score is None else out.where(F.col("score") >= min_score)
    return out if keep is None else out.join(keep.select(key), key, "left_semi")
