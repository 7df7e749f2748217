"""Replay from snapshots equals replay from the first edit, whatever happened to snapshots or log."""

import random

from pyspark.sql import functions as F

from lodestone.operators import shifts as S
from lodestone.operators import snapshots as N


def state(df):
    return {r.file: (list(r.lines), r.existing) for r in df.collect()}


def test_sound_damaged_and_outdated_snapshots(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "snapshots")
    rows = [(rng.choice("abcde"), p, rng.choice(["edit"] * 9 + ["delete", "create"]), rng.randint(1, 5), rng.randint(0, 2)) for p in range(100)]
    rows = [(*r, [] if r[2] == "delete" else [f"{r[1]}.{j}" for j in range(rng.randint(0, 3))]) for r in rows] + [("late", 90, "create", 1, 0, ["x"])]
    frame = lambda rows: spark.createDataFrame(rows, "file string, pos long, op string, old_start int, old_lines int, new_text array<string>")
    log = frame(rows)
    got, remade = N.replayed_from(log, path)
    assert state(got) == state(S.replayed(log)) and remade == 0  # none yet
    N.keep(N.taken(log, 60), path)
    got, remade = N.replayed_from(log, path)
    assert state(got) == state(S.replayed(log)) and remade == 0
    damaged = N.taken(log, 70).withColumn("lines", F.when(F.col("file") == "a", F.array(F.lit("?"))).otherwise(F.col("lines")))
    N.keep(damaged, path)
    changed = frame([(f, p, op, s, n, ["rewritten"] if (f, op) == ("b", "edit") and p < 50 else t) for f, p, op, s, n, t in rows])
    got, remade = N.replayed_from(changed, path)
    assert state(got) == state(S.replayed(changed)) and remade == 2
    got, remade = N.replayed_from(changed, path)
    assert state(got) == state(S.replayed(changed)) and remade == 0
    assert {r.at for r in N.kept(spark, path).collect()} == {70}
