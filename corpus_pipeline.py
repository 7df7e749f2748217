"""From documents to sharded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents; the last
adds where each row goes.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import quality, sharding
from lodestone.llm.common import ensure_checkpoint_dir, table, without
from lodestone.llm.lsh_forest import deduplicated
from lodestone.llm.mixing import mixed
from lodestone.llm.spaced_seeds import decontaminated

#: Stages after the first have some languages and sources less; shards are as in the registered query.
SHARDS = 40


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of the threshold and over)."""
    scores = quality.scored(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return without(docs, scores.where(F.col("score") < quality.THRESHOLD))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 and over."""
    return deduplicated(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes: doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: The classifier and the LSH forest cannot be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
