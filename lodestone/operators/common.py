"""Helpers shared by operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast where it was counted to be small; left to a shuffled join otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the cluster's checkpoint folder, or the warehouse where none is named."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut through the shared folder; the rows are computed once for all that reads them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


#: A table is dealt out where it is read in fewer pieces a core than this.
PIECES_A_CORE = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small table's rows dealt over all cores, since its files may hold them in a single piece; tables read in many pieces stay as they lie.

    Without ``keys`` Spark sorts a piece before it deals it out, so that a rerun deals alike.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(PIECES_A_CORE * cores, *keys) if df.rdd.getNumPartitions() < PIECES_A_CORE * cores else df


def pieces(df: DataFrame) -> int:
    """Pieces for work on a table's rows: enough for all cores, and more as the table is read in more."""
    return PIECES_A_CORE * max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())


def group_pieces(df: DataFrame) -> int:
    """Pieces for work on groups of rows: enough for all cores, and as many as a shuffle makes."""
    return max(PIECES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over all cores for work in Python: sizes in bytes, by which Spark joins small pieces, say nothing of what a group takes."""
    return df.repartition(group_pieces(df), *keys)
