"""Embedding within a budget: what a run does not reach waits in the stream's state for a later one.

Requests (id, digest, text) and grants (how many texts a shard may embed) arrive as one stream. Each shard keeps a queue
in keyed state: places and counters, so that taking the first few costs those few, however many wait. A text is
embedded once for each digest; a newer digest of an id that waits takes its place in the queue. Texts of a grant go to
the embedding function together. State, input offsets and output share the stream's checkpoint, so a run that is
broken off is taken up where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Texts that are handed to the embedding function at once.
TEXTS_AT_ONCE = 256
OUTPUT = "id string, digest string, vector array<double>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Embed = Callable[[list[str]], np.ndarray]


class Queue(StatefulProcessor):
    def __init__(self, embed: Embed, texts_at_once: int = TEXTS_AT_ONCE):
        self.embed, self.texts_at_once = embed, texts_at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "place long", "id string, digest string, text string")
        self.known = handle.getMapState("known", "id string", "digest string, place long")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, after = self.ends.get() if self.ends.exists() else (0, 0)
        grants, asked = 0, []
        for part in rows:
            grants += int(part["grant"].fillna(0).sum())
            texts = part[part["id"].notna()]
            asked += list(zip(texts["id"], texts["digest"], texts["text"], strict=True))
        for name, digest, text in sorted(asked):
            digest_known, place = self.known.getValue((name,)) if self.known.containsKey((name,)) else (None, -1)
            if digest_known == digest:
                continue
            if place < first or not self.waiting.containsKey((place,)):  # not waiting (any more): to the end of the queue
                place, after = after, after + 1
            self.waiting.updateValue((place,), (name, digest, text))
            self.known.updateValue((name,), (digest, place))
        upto = min(after, first + grants)
        while first < upto:
            places = range(first, min(upto, first + self.texts_at_once))
            taken = [self.waiting.getValue((p,)) for p in places]
            for p in places:
                self.waiting.removeKey((p,))
            first += len(taken)
            vectors = self.embed([t for _, _, t in taken])
            yield pd.DataFrame({"id": [i for i, _, _ in taken], "digest": [d for _, d, _ in taken], "vector": [np.asarray(v, np.float64).tolist() for v in vectors]})
        self.ends.update((first, after))

    def close(self) -> None:
        pass


def embedded(requests: DataFrame, grants: DataFrame, embed: Embed, shards: int, texts_at_once: int = TEXTS_AT_ONCE) -> DataFrame:
    """id, digest, vector of what the grants reach. ``requests``: id, digest, text (not null); ``grants``: shard, grant; both streams."""
    asked = requests.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("string").alias("id"), F.col("digest").cast("string").alias("digest"), "text", F.lit(None).cast("long").alias("grant"))
    given = grants.select(F.col("shard").cast("int").alias("shard"), *[F.lit(None).cast("string").alias(c) for c in ("id", "digest", "text")], F.col("grant").cast("long").alias("grant"))
    return asked.union(given).groupBy("shard").transformWithStateInPandas(statefulProcessor=Queue(embed, texts_at_once), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def grant(spark: SparkSession, folder: str, shards: int, budget: int) -> None:
    """Lets the next run embed ``budget`` texts, dealt over the shards."""
    each = [(k, budget // shards + (k < budget % shards)) for k in range(shards)]
    spark.createDataFrame(each, "shard int, grant long").coalesce(1).write.mode("append").parquet(folder)


def run(requests: DataFrame, grants_folder: str, embed: Embed, target: str, checkpoint: str, shards: int = 8, texts_at_once: int = TEXTS_AT_ONCE) -> None:
    """Takes in what is new, embeds what the grants allow, and appends it to ``target``, a folder a micro-batch."""
    spark = requests.sparkSession
    given = spark.readStream.schema("shard int, grant long").parquet(grants_folder)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/{number:09d}")
        out = embedded(requests, given, embed, shards, texts_at_once)
        out.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def vectors(spark: SparkSession, target: str) -> DataFrame:
    """id, digest, vector: the newest vector of each id."""
    from lodestone.streaming.tail import versions

    parts = [f"{target}/{n:09d}" for n in versions(spark, target)]
    if not parts:
        return spark.createDataFrame([], OUTPUT)
    rows = spark.read.parquet(*parts).withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{9})/[^/]*$", 1).cast("int"))
    return rows.groupBy("id").agg(F.max_by(F.struct("digest", "vector"), "_batch").alias("_v")).select("id", "_v.*")
