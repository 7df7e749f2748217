"""Snapshots of file states that are kept beside a log, trusted only where they still fit it, and remade where not.

A snapshot holds a file's lines as of a position, a digest of them, and a digest of the edits it covers (count and a sum of
hashes, which combine before the shuffle in any order). Replay starts from the snapshots whose digests hold: each stands in the
log as one edit that writes the whole file, followed by the edits after it. Files whose log was changed below the snapshot, or whose
snapshot was damaged, are replayed from their first edit, and only their snapshots are written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.common import bounded, cut
from lodestone.operators.shifts import replayed
from lodestone.streaming.tail import versions

EDIT = ("op", "old_start", "old_lines", "new_text")


def _of_edit() -> Column:
    return F.xxhash64("pos", *EDIT).cast("decimal(20,0)")


def _of_lines(lines: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(F.col(lines) if isinstance(lines, str) else lines)).cast("binary"), 256)


def _covered(commits: DataFrame, upto: DataFrame) -> DataFrame:
    """file, edits, edits_digest of the edits up to each file's position (file, at)."""
    rows = commits.join(bounded(upto.select(F.col("file").alias("_file"), "at")), (F.col("file") == F.col("_file")) & (F.col("pos") <= F.col("at")))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("edits"), F.sum(_of_edit()).alias("edits_digest"))


def taken(commits: DataFrame, at: int) -> DataFrame:
    """file, at, lines, existing, lines_digest, edits, edits_digest: snapshots of all files as of position ``at``."""
    early = commits.where(F.col("pos") <= at)
    states = replayed(early).withColumns({"at": F.lit(at).cast("long"), "lines_digest": _of_lines("lines")})
    return states.join(early.groupBy("file").agg(F.count(F.lit(1)).alias("edits"), F.sum(_of_edit()).alias("edits_digest")), "file")


def keep(snapshots: DataFrame, path: str) -> None:
    """Adds snapshots to the folder; of each file the newest write counts."""
    number = max(versions(snapshots.sparkSession, path), default=-1) + 1
    snapshots.write.parquet(f"{path}/{number:09d}")


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    numbers = versions(spark, path)
    if not numbers:
        return None
    rows = spark.read.parquet(*[f"{path}/{n:09d}" for n in numbers]).withColumn("_n", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{9})/[^/]*$", 1).cast("int"))
    names = [c for c in rows.columns if c not in ("file", "_n")]
    return rows.groupBy("file").agg(F.max_by(F.struct(*names), "_n").alias("_s")).select("file", "_s.*")


def judged(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with ``sound``: the lines are those that were written, and the log up to there is the one they came from."""
    now = _covered(commits, snapshots).select(F.col("file").alias("_file"), F.col("edits").alias("_edits"), F.col("edits_digest").alias("_digest"))
    both = snapshots.join(now, F.col("file") == F.col("_file"), "left")
    sound = (F.col("lines_digest") == _of_lines("lines")) & (F.col("edits") == F.col("_edits")) & (F.col("edits_digest") == F.col("_digest"))
    return both.withColumn("sound", F.coalesce(sound, F.lit(False))).drop("_file", "_edits", "_digest")


def healed(commits: DataFrame, path: str) -> tuple[DataFrame | None, int]:
    """(the snapshots that hold, None where none were ever taken; how many did not and were remade). Nothing else is replayed."""
    held = kept(commits.sparkSession, path)
    if held is None:
        return None, 0
    held = cut(judged(commits, held))
    unsound = held.where("not sound").select("file", "at")
    broken = unsound.count()
    if broken:
        again = commits.join(bounded(unsound.select(F.col("file").alias("_file"), "at")), (F.col("file") == F.col("_file")) & (F.col("pos") <= F.col("at"))).drop("_file")
        states = replayed(again.drop("at")).join(again.groupBy("file").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("edits"), F.sum(_of_edit()).alias("edits_digest")), "file")
        keep(states.withColumn("lines_digest", _of_lines("lines")).select(*[c for c in held.columns if c != "sound"]), path)
    return held.where("sound"), broken


def replayed_from(commits: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(file, lines, existing; number of snapshots that had to be remade). ``commits``: file, pos, op, old_start, old_lines, new_text."""
    sound, broken = healed(commits, path)
    if sound is None:
        return replayed(commits), 0
    start = sound.select("file", F.col("at").alias("pos"), F.when(F.col("existing"), "create").otherwise("delete").alias("op"), F.lit(1).alias("old_start"), F.lit(0).alias("old_lines"), F.col("lines").alias("new_text"))
    after = commits.join(sound.select(F.col("file").alias("_file"), "at"), F.col("file") == F.col("_file"), "left").where("_file is null or pos > at")
    return replayed(after.select("file", "pos", *EDIT).unionByName(start)), broken
