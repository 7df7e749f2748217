"""Sharding by proportional stratified interleaving.

Rows of a source are put into a seeded order and ranked; rank r of n becomes the fraction
(r + 1/2) / n; all rows in the order of these fractions are cut into equal runs. Every run then
holds each source in the proportion that it has of the whole.

No sort needs one task: the seeded order is cut into ranges of the (uniform) hash, a small table
of counts for each source and range gives the rank at which a range starts, and ``row_number``
works inside a range only. The order of fractions is cut into ranges likewise; how many rows of a
source fall into a range follows from the source's count alone, in whole numbers.

Law: ``rows``. Counts of shards differ by one at most. A source of a third of all rows is spread
over all its hash ranges. Text never enters a shuffle: size and checksum are taken at the scan.

Defined cases: a null source is a source of its own; a null text has size 16 and the checksum of
an empty text; null and repeated ``doc_id`` are placed like others, since the seeded order is that of a
hash of id, checksum and size, so that texts without ids spread over all ranges; rows equal in all three are
interchangeable (and, within a source, sorted by one task). An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import small_or_shuffled

ROWS_PER_RANGE = 20_000
LEAST_RANGES, MOST_RANGES = 256, 1 << 18


def assign_shards(docs: DataFrame, n_shards: int = 40, seed: str = "interleave") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    n_rows = docs.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-n_rows // ROWS_PER_RANGE)))
    body = F.coalesce(F.col("text"), F.lit(""))
    size, checksum = F.octet_length(body).cast("long") + 16, F.crc32(body)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), checksum.cast("string"), size.cast("string")))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        size.alias("size"),
        checksum.alias("text_crc32"),
        key.alias("_key"),
    ).withColumn("_range", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges, 32))

    by_source = Window.partitionBy("source")
    starts = (
        rows.groupBy("source", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col("source").alias("_source"),
            F.col("_range").alias("_at"),
            (F.sum("_n").over(by_source.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
            F.sum("_n").over(by_source).alias("_of"),
        )
    )
    ranked = (
        rows.withColumn("_nth", F.row_number().over(Window.partitionBy("source", "_range").orderBy("_key", "text_crc32", "size")))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at")))
        .withColumn("_odd", 2 * (F.col("_before") + F.col("_nth")) - 1)  # twice the middle of the rank
        .withColumn("_slice", F.expr(f"(_odd * {ranges}L) div (2 * _of)"))
        .drop("_source", "_at")
    )
    # rows of a source before slice g: the least r with (2r + 1) * ranges >= 2 * n * g
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_of"))
    # a source of fewer rows than slices gives a row for each of its rows, any other one for each slice
    first = lambda g: f"(2 * _of * {g} + {ranges}L - 1) div (2 * {ranges}L)"
    steps = sources.select("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_of", F.lit(ranges)) - 1)).alias("_i"))
    filled = steps.select(
        F.expr(f"IF(_of < {ranges}, ((2 * _i + 1) * {ranges}L) div (2 * _of), _i)").alias("_g"),
        F.expr(f"IF(_of < {ranges}, 1L, {first('(_i + 1)')} - {first('_i')})").alias("_rows"),
    )
    in_order = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # of ``MOST_RANGES`` rows at most
    slices = filled.groupBy("_g").agg(F.sum("_rows").alias("_rows")).select("_g", F.coalesce(F.sum("_rows").over(in_order), F.lit(0)).alias("_base"))
    placed = (
        ranked.withColumn(
            "_in", F.row_number().over(Window.partitionBy("_slice").orderBy(F.col("_odd") / F.col("_of"), F.col("source").asc_nulls_last(), "_odd"))
        )
        .join(small_or_shuffled(slices), F.col("_slice") == F.col("_g"))
        .withColumn("_pos", F.col("_base") + F.col("_in") - 1)
        .withColumn("shard", F.expr(f"(_pos * {n_shards}L) div {max(n_rows, 1)}L"))
    )
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"_pos - (shard * {n_rows}L + {n_shards}L - 1) div {n_shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
