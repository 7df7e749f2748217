"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 200_000
#: Words are maximal runs of anything but the six ASCII white space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; where none is set, a folder in the warehouse, which is shared as well."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame, *watched: str) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs no recomputation.

    The rows are counted while they are written (:func:`n_rows`); of columns ``watched`` a checksum is taken too.
    """
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    checksum = [F.bit_xor(F.xxhash64(*watched)).alias("checksum")] if watched else []
    out = df.observe(seen, F.count(F.lit(1)).alias("n"), *checksum).checkpoint(eager=True)
    _SEEN[out] = (seen.get["n"], seen.get.get("checksum"))
    return out


#: (rows, checksum) of the tables that :func:`cut` returned and that are still in use.
_SEEN: WeakKeyDictionary[DataFrame, tuple[int, int | None]] = WeakKeyDictionary()


def seen(df: DataFrame) -> tuple[int, int | None]:
    """Rows and checksum of a table that :func:`cut` returned."""
    return _SEEN[df]


def n_rows(df: DataFrame) -> int:
    """The number of rows, without a job if :func:`cut` returned this table."""
    return _SEEN[df][0] if df in _SEEN else df.count()


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS, at_most: DataFrame | None = None) -> DataFrame:
    """Mark a counted, bounded table for broadcast; a larger one is left to a shuffled join. ``at_most``: a counted table that has as many rows."""
    return F.broadcast(df) if n_rows(df if at_most is None else at_most) <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind them until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n + "_" * k for k in range(1, 2 + len(taken))) if x.lower() not in taken) for n in names]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, whose id and text are not among ``doc_id`` and ``text_hash`` of ``gone``."""
    i, h = fresh(docs, "gone_id", "gone_hash")
    pairs = cut(gone.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct())
    return docs.join(small_or_shuffled(pairs), F.col("doc_id").eqNullSafe(F.col(i)) & F.xxhash64("text").eqNullSafe(F.col(h)), "left_anti")
