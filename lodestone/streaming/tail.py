"""Tailing an append-only log: new records fold into a table of current state.

Files of the log folder arrive as a stream; a record becomes visible when its line is ended. Each
micro-batch is merged into the state by key and position, so a batch that is run again after a
failure changes nothing. State is written beside the old one and then read by its number, never
overwritten in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_records(spark: SparkSession, folder: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.json(folder).where("_bad is null").drop("_bad")


def merged(state: DataFrame | None, batch: DataFrame, key: str, pos: str) -> DataFrame:
    """The record with the largest position of each key; partial results combine before the shuffle."""
    rows = batch if state is None else state.unionByName(batch)
    names = [c for c in rows.columns if c not in (key, pos)]
    return rows.groupBy(key).agg(F.max(pos).alias("_p"), F.max_by(F.struct(*names), pos).alias("_v")).select(F.col(key), F.col("_p").alias(pos), "_v.*")


def tail_to_state(records: DataFrame, state: str, checkpoint: str, key: str, pos: str) -> StreamingQuery:
    """Runs what is available and stops. The current state is the folder of the greatest batch number."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in versions(spark, state) if n < number]
        old = spark.read.parquet(f"{state}/{before[-1]:09d}") if before else None
        merged(old, batch, key, pos).write.mode("overwrite").parquet(f"{state}/{number:09d}")

    return records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, state: str) -> list[int]:
    """Numbers of finished states, found through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current_state(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/{versions(spark, state)[-1]:09d}")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Gap-based sessions of a stream or a table: key, start, end, n."""
    w = F.session_window(ts, gap)
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
