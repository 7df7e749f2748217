"""The scan reads its ranges as streams: no file costs a group of its own, and a file that ranges cut is put together."""

import random

from pyspark.sql import functions as F

from lodestone.operators import shifts as S

SCHEMA = "file string, pos long, op string, old_start int, old_lines int, new_text array<string>"


def log(rng, files, edits):
    rows = [(rng.choice(files), p, rng.choice(["edit"] * 25 + ["delete", "create"]), rng.randint(-1, 9), rng.randint(0, 3), rng.randint(0, 3)) for p in range(edits)]
    return [(f, p, op, s, n, [] if op == "delete" else [f"{p}.{j}" for j in range(w)]) for f, p, op, s, n, w in rows]


def in_order(rows):
    texts = {}
    for f, _, op, s, n, t in rows:
        x, h = texts.get(f, ([], True))[0], max(s - 1, 0)
        texts[f] = ([], False) if op == "delete" else (x[:h] + t + x[h + n :], True)
    return texts


def test_a_file_is_no_group_in_python(spark):
    plan = S.replayed(spark.createDataFrame(log(random.Random(1), ["a", "b"], 30), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_files_that_ranges_cut(spark):
    rng = random.Random(2)
    rows = log(rng, ["hot"] * 6 + ["warm"] * 2 + [f"f{i}" for i in range(9)], 900)
    commits = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for a_run in (1, 3, 512):
        sources = S.line_sources(commits, edits_a_run=a_run)
        assert {r.file: r.last for r in sources.collect()} == {f: max(p for g, p, *_ in rows if g == f) for f in {r[0] for r in rows}}
        assert {r.file: (list(r.lines), r.existing) for r in S.replayed(commits, edits_a_run=a_run).collect()} == in_order(rows)


def test_files_that_are_structs_or_null(spark):
    rows = log(random.Random(3), ["a", "b"], 80)
    commits = spark.createDataFrame([*rows, (None, 99, "create", 1, 0, ["x"])], SCHEMA)
    named = commits.where("file is not null").withColumn("file", F.struct(F.lit(1).alias("branch"), "file"))
    assert {r.file.file: (list(r.lines), r.existing) for r in S.replayed(named).collect()} == in_order(rows)
    assert {r.file for r in S.replayed(commits).collect()} == {"a", "b"}


def test_edits_in_place_equal_maps():
    rng, lines = random.Random(5), lambda segments: [(s, i) for s, a, b in segments for i in range(a, b)]
    for _ in range(1500):
        n = rng.randint(0, 6)
        text, size, maps, sizes = [(S.BEFORE, 0, n)] if n else [], n, [], []
        for p in range(rng.randint(1, 12)):
            edit = (rng.randint(0, 8), rng.randint(0, 3), rng.randint(0, 3), rng.random() < 0.05)
            maps.append(S.edit_map(p, *edit, size))
            sizes.append(S.Sizes.of_edit(*edit))
            size = S.edited(text, size, p, *edit)
            assert size == sum(b - a for _, a, b in text)
        assert lines(text) == lines(S.all_composed(maps)) and S.all_sizes(sizes)(n) == size


def test_blame_of_files_that_ranges_cut(spark):
    rows = log(random.Random(7), ["hot"] * 5 + ["a", "b", "c"], 500)
    commits = spark.createDataFrame(rows, SCHEMA)
    sources = S.line_sources(commits, edits_a_run=3)
    assert "FlatMapGroups" not in sources._jdf.queryExecution().executedPlan().toString()
    got = {(r.file, r.line): r.pos for r in S.blamed(sources).collect()}
    assert got == {(f, i): int(x.split(".")[0]) for f, (text, _) in in_order(rows).items() for i, x in enumerate(text, 1)}
