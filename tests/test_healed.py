"""Finding and remaking snapshots costs no replay of the log."""

from pyspark.sql import functions as F

from lodestone.operators import snapshots as N


def test_nothing_is_replayed_where_all_snapshots_hold(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snapshots")
    rows = [(f, p, "create" if p < 4 else "edit", 1, p % 2, [f"{f}{p}"]) for p in range(12) for f in "abc"]
    log = spark.createDataFrame(rows, "file string, pos long, op string, old_start int, old_lines int, new_text array<string>")
    assert N.healed(log, path) == (None, 0)
    N.keep(N.taken(log, 7).withColumn("lines", F.when(F.col("file") == "b", F.array(F.lit("?"))).otherwise(F.col("lines"))), path)
    sound, remade = N.healed(log, path)
    assert remade == 1 and {r.file for r in sound.collect()} == {"a", "c"}
    monkeypatch.setattr(N, "replayed", None)
    sound, remade = N.healed(log, path)
    assert remade == 0 and {r.file for r in sound.collect()} == {"a", "b", "c"}
