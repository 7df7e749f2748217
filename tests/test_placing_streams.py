"""Commits are placed out of a stream of rows: no file is a group of its own, and a file may lie in many batches."""

import random

from lodestone.operators import merging as M

SCHEMA = "lineage long, pos long, hash string, type string, origin string, session string, file string, op string, old_start int, old_lines int, old_text array<string>, new_text array<string>, ended boolean, of string, branch long, head long, stopped array<string>"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def histories(rng, files):
    """Rows of target 0 and branch 1, and what a file's commits of the branch and its two texts are."""
    rows, want = [], {}

    def commit(lineage, pos, file, op, start, old, new):
        rows.append({"lineage": lineage, "pos": pos, "hash": f"{lineage}.{pos}", "origin": f"{lineage}.{pos}", "type": "commit", "file": file, "op": op, "old_start": start, "old_lines": len(old), "old_text": old, "new_text": new, "ended": True})

    def edits(lineage, pos, file, text, n):
        made = []
        for k in range(n):
            at, cut = rng.randint(0, len(text)), rng.randint(0, 2)
            old, new = text[at : at + cut], [f"{lineage}.{pos + k}.{j}" for j in range(rng.randint(0, 2))]
            commit(lineage, pos + k, file, "edit", at + 1, old, new)
            made.append({"op": "edit", "old_start": at + 1, "old_lines": len(old), "old_text": old, "new_text": new, "ended": True})
            text = text[:at] + new + text[at + len(old) :]
        return made, text

    for f in range(files):
        file, base = f"f{f}", [f"b{f}.{i}" for i in range(rng.randint(8, 30))]
        commit(0, f, file, "create", 1, [], base)
        theirs = edits(0, 10_000 + 100 * f, file, base, rng.randint(0, 2))[1]
        if f % 9 == 4:
            commit(0, 10_000 + 100 * f + 99, file, "delete", 1, theirs, [])
        ours = edits(1, 1_000_000 + 100 * f, file, base, rng.randint(1, 9))[0]
        if f % 11 == 5:
            want[file] = [("left", None, None, "stopped by an earlier merge")] * len(ours)
        else:
            want[file] = M.Placing((base, True), None if f % 9 == 4 else (theirs, True)).place(ours)
    rows.append({"lineage": 0, "pos": 900_000, "hash": "m", "origin": "m", "type": "merge", "branch": 1, "head": 0, "stopped": [f"f{f}" for f in range(files) if f % 11 == 5]})
    return rows, want


def test_files_over_many_batches(spark):
    rows, want = histories(random.Random(8), 60)
    records = spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in rows], SCHEMA).repartition(5)
    chain = M.chains(spark.createDataFrame([(1, 0, 5_000)], "branch long, parent long, base long"), spark.createDataFrame([(1, 0)], "branch long, target long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        placed = M.placements(M.streams(records, chain), records)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in sorted(placed.collect(), key=lambda r: r.seq):
            got.setdefault(r.file, []).append((r.state, r.start, r.ended, r.why))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and {s for f in want.values() for s, *_ in f} >= {"placed", "conflict", "left"}
    assert "CoGroup" not in plan and "FlatMapGroups" not in plan
