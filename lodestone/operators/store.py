"""Documents and sources: filters, facts, ingest plans, id ranges, staleness, links, address keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import contains_folded
from lodestone.operators.common import cut


def document_filter(collection: str | None = None, source: str | None = None, mime: str | None = None, since: str | None = None, q: str | None = None, meta: dict | None = None) -> Column:
    """The AND of what is given, over columns collection, source, mime, fetched_at, title, locator, meta."""
    keep = F.lit(True)
    if collection is not None:
        keep = keep & F.col("collection").isin(*[c.strip() for c in collection.split(",")])
    if source is not None:
        keep = keep & (F.col("source") == source)
    if mime is not None:
        keep = keep & (F.col("mime") == mime)
    if since is not None:
        keep = keep & F.coalesce(F.try_to_timestamp("fetched_at") >= F.lit(since).cast("timestamp"), F.lit(False))
    if q:
        keep = keep & (F.coalesce(contains_folded(F.col("title"), F.lit(q)), F.lit(False)) | F.coalesce(contains_folded(F.col("locator"), F.lit(q)), F.lit(False)))
    for k, v in (meta or {}).items():
        keep = keep & meta_has("meta", k, v)
    return keep


def meta_has(column: str, key: str, value) -> Column:
    """The key's value equals ``value``, or is an array that holds it."""
    import json

    want = json.dumps(value)
    path = F.try_variant_get(F.try_parse_json(column), f"$.{key}", "string")
    in_list = F.exists(F.coalesce(F.try_variant_get(F.try_parse_json(column), f"$.{key}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.to_json(x) == want)
    plain = value if isinstance(value, str) else want
    return F.coalesce(path == plain, F.lit(False)) | F.coalesce(in_list, F.lit(False))


def stale(fetched_at: Column, as_of: Column, seconds: Column | int) -> Column:
    """Older than the threshold, strictly; a date that cannot be read is stale."""
    at = F.try_to_timestamp(fetched_at) if isinstance(fetched_at, Column) else F.try_to_timestamp(F.col(fetched_at))
    return F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp(at) > seconds, F.lit(True))


def source_facts(documents: DataFrame, by: str, pos: str = "pos") -> DataFrame:
    """Documents, bytes, newest fetch with its etag, and content hash of each source.

    The hash over several documents joins their hashes in log order, so a source's hashes are
    gathered: 64 bytes a document.
    """
    hashes = F.array_sort(F.collect_list(F.struct(pos, "content_hash")))
    joined = F.concat_ws("", F.transform(hashes, lambda h: h["content_hash"]))
    return documents.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("bytes").alias("bytes"),
        F.max("fetched_at").alias("fetched_at"),
        F.max_by("etag", F.struct("fetched_at", pos)).alias("etag"),
        F.when(F.count(F.lit(1)) == 1, F.first("content_hash")).otherwise(F.sha2(joined, 256)).alias("content_hash"),
    )


def ingest_plan(incoming: DataFrame, current: DataFrame, key: list[str], shown: list[str]) -> DataFrame:
    """What filing ``incoming`` over ``current`` does to each key: created, touched, refiled (only shown columns differ), revised, gone."""
    a = incoming.select(*key, F.col("content_hash").alias("_new"), F.struct(*shown).alias("_new_shown"))
    b = current.select(*key, F.col("content_hash").alias("_old"), F.struct(*shown).alias("_old_shown"))
    both = a.join(b, key, "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), "gone")
        .when(F.col("_new") != F.col("_old"), "revised")
        .when(~F.col("_new_shown").eqNullSafe(F.col("_old_shown")), "refiled")
        .otherwise("touched")
    )
    return both.select(*key, action.alias("action"))


def running_base(rows: DataFrame, count: str, order: list[str], buckets: int = 64) -> DataFrame:
    """``base``: the sum of ``count`` over all rows before, without one task for all rows.

    Rows fall into ranges of the order (sampled by Spark), ranges are summed, and sums run within
    a range only. Rows are written with their range, since another run of the plan would sample other ranges.
    """
    ranged = cut(rows.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(count).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(totals.select("_part", before.alias("_before")))  # one row a range
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, "_part").withColumn("base", F.col("_before") + F.coalesce(F.sum(count).over(w), F.lit(0))).drop("_part", "_before")


def resolved_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with ``from_resolved`` and ``to_resolved``; ``ids`` has column id."""
    a, b = ids.select(F.col("id").alias("_a")), ids.select(F.col("id").alias("_b"))
    out = links.join(a, F.col("from") == F.col("_a"), "left").join(b, F.col("to") == F.col("_b"), "left")
    return out.select(*links.columns, F.col("_a").isNotNull().alias("from_resolved"), F.col("_b").isNotNull().alias("to_resolved"))


def link_problems(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links to add with ``problem``: self, imports, missing_from, missing_to or null."""
    r = resolved_links(links, ids)
    return r.withColumn("problem", F.when(F.col("from") == F.col("to"), "self").when(F.col("rel") == "imports", "imports").when(~F.col("from_resolved"), "missing_from").when(~F.col("to_resolved"), "missing_to"))


def edge_diff(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``action``: link, unlink, keep."""
    both = wanted.select(*keys, F.lit(1).alias("_w")).join(existing.select(*keys, F.lit(1).alias("_e")), keys, "full_outer")
    return both.select(*keys, F.when(F.col("_e").isNull(), "link").when(F.col("_w").isNull(), "unlink").otherwise("keep").alias("action"))


def page_after(rows: DataFrame, id_number: Column, after: int, limit: int, reverse: bool = False) -> DataFrame:
    """Keyset paging by id number; the cursor itself need not exist."""
    kept = rows.where(id_number < after if reverse else id_number > after)
    return kept.orderBy(id_number.desc() if reverse else id_number.asc()).limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over distinct undirected edges without loops."""
    e = edges.where("`from` <> `to`").select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct()
    return e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
