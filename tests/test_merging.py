"""Placing commits on a parent, chains of branches, and the scan of interval maps, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import merging as M
from lodestone.operators import shifts as S

BASE = (["a", "b", "c", "d", "e", "f", "g", "h"], True)


def edit(start, old, new, op="edit", ended=True):
    return {"op": op, "old_start": start, "old_lines": len(old), "old_text": old, "new_text": new, "ended": ended}


def placed(parent, commits, base=BASE):
    p = M.Placing(base, parent)
    return [x[:2] for x in p.place(commits)], p.theirs[0]


def test_commits_shift_by_what_the_parent_added():
    parent = (["new", *BASE[0]], True)
    assert placed(parent, [edit(3, ["c"], ["C"]), edit(8, ["h"], [])]) == ([("placed", 4), ("placed", 9)], ["new", "a", "b", "C", "d", "e", "f", "g"])


def test_same_change_is_done_and_stays_the_parents():
    parent = (["a", "X", *BASE[0][2:]], True)
    assert placed(parent, [edit(2, ["b"], ["X"]), edit(5, ["e"], ["E"])])[0] == [("done", 2), ("placed", 5)]
    assert placed(parent, [edit(2, ["b"], ["X"]), edit(2, ["X"], ["Y"]), edit(5, ["e"], ["E"])])[0] == [("done", 2), ("conflict", None), ("left", None)]


def test_steps_that_end_in_the_parents_text_are_done():
    parent = (["a", "X", "Y", *BASE[0][3:]], True)
    steps = [edit(2, ["b"], ["X"]), edit(3, ["c"], ["Z"]), edit(3, ["Z"], ["Y"])]
    assert placed(parent, [*steps, edit(7, ["g"], ["G"])])[0] == [("done", 2)] * 3 + [("placed", 7)]
    assert placed(parent, steps[:2])[0] == [("conflict", None), ("left", None)]
    assert placed(parent, [steps[0], edit(7, ["g"], ["G"]), *steps[1:]])[0][0] == ("conflict", None)


def test_touching_is_a_conflict():
    parent = (["a", "b", "X", *BASE[0][3:]], True)
    for c in (edit(2, ["b"], ["B"]), edit(4, ["d"], ["D"]), edit(3, [], ["new"]), edit(4, [], ["new"]), edit(2, ["b", "c"], ["Q"])):
        assert placed(parent, [c])[0] == [("conflict", None)], c
    assert placed(parent, [edit(1, ["a"], ["A"])])[0] == [("placed", 1)]
    assert placed(parent, [edit(5, ["e"], ["E"])])[0] == [("placed", 5)]
    assert M.Placing(BASE, (["a", "n", *BASE[0][1:]], True)).place([edit(2, [], ["m"])])[0][3] == "both sides insert at the same point"


def test_existence_comes_first():
    whole = edit(1, BASE[0], [], "delete")
    assert placed(None, [whole])[0] == [("done", 1)]
    assert placed(None, [edit(1, ["a"], ["A"])])[0] == [("conflict", None)]
    assert placed(BASE, [whole]) == ([("placed", 1)], [])
    assert placed((["z"], True), [whole], base=(["z"], True))[0] == [("conflict", None)]  # the text is not the parent's
    assert placed(BASE, [edit(1, [], BASE[0], "create"), edit(2, ["b"], ["B"])], base=M.EMPTY)[0] == [("done", 1), ("placed", 2)]
    assert placed(BASE, [edit(1, [], ["other"], "create")], base=M.EMPTY)[0] == [("conflict", None)]
    assert placed(None, [edit(1, [], ["x"], "create")], base=M.EMPTY) == ([("placed", 1)], ["x"])
    assert placed(BASE, [edit(1, [], [], "untrack"), edit(1, [], ["x"], "create")]) == ([("placed", 1), ("placed", 1)], ["x"])
    assert placed(None, [edit(1, [], [], "untrack")])[0] == [("done", 1)]


def test_final_newline():
    parent = (BASE[0], False)
    p = M.Placing(BASE, parent)
    assert p.place([edit(1, ["a"], ["A"])]) == [("placed", 1, False, None)]
    assert p.place([edit(1, ["A"], ["B"], ended=False)])[0][2] is False
    assert M.Placing((["a\r", "b\r"], True), (["a", "b"], True)).place([edit(1, ["a\r"], ["A\r"])])[0][0] == "placed"


def test_random_merges_keep_both_sides():
    """Where all is placed, the result has every line in the order that lines of a unique name give it."""
    rng = random.Random(6)
    for _ in range(400):
        base = [f"b{i}" for i in range(rng.randint(4, 30))]
        parent, n = list(base), 0
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(parent))
            parent[at : at + rng.randint(0, 2)] = [f"p{n + j}" for j in range(rng.randint(0, 2))]
            n += 2
        ours, commits = list(base), []
        for k in range(rng.randint(1, 5)):
            at, cut, new = rng.randint(0, len(ours)), rng.randint(0, 2), [f"o{k}.{j}" for j in range(rng.randint(0, 2))]
            commits.append(edit(at + 1, ours[at : at + cut], new))
            ours[at : at + cut] = new
        p = M.Placing((base, True), (parent, True))
        states = [x[0] for x in p.place(commits)]
        if set(states) == {"placed"}:
            merged = p.theirs[0]
            gone_b = set(base) - set(ours)
            gone_p = set(base) - set(parent)
            assert sorted(merged) == sorted([x for x in base if x not in gone_b | gone_p] + [x for x in parent if x[0] == "p"] + [x for x in ours if x[0] == "o"])
            assert [x for x in merged if x[0] != "o"] == [x for x in parent if x not in gone_b]
            assert [x for x in merged if x[0] != "p"] == [x for x in ours if x not in gone_p]


@pytest.fixture(scope="module")
def history(spark):
    """Target 0; branch 1 from it, 2 from 1, 3 from 2; sessions, amends, and an earlier merge of 1 up to its position 12."""
    rows = []

    def add(lineage, pos, type, **more):
        rows.append({"lineage": lineage, "pos": pos, "hash": f"{lineage}.{pos}", "type": type, "origin": more.pop("origin", f"{lineage}.{pos}"), **more})

    def commit(lineage, pos, file, start, old, new, op="edit", **more):
        add(lineage, pos, "commit", file=file, op=op, old_start=start, old_lines=len(old), old_text=old, new_text=new, ended=True, **more)

    commit(0, 0, "x", 1, [], BASE[0], "create")
    commit(0, 1, "y", 1, [], ["y1", "y2", "y3"], "create")
    commit(0, 2, "z", 1, [], ["z1", "z2", "z3", "z4"], "create")
    add(1, 10, "session_start", session="S1")
    commit(1, 11, "x", 1, ["a"], ["A"], session="S1")
    commit(1, 12, "y", 2, ["y2"], ["Y2"], session="S1")
    add(1, 13, "session_end", session="S1")
    commit(1, 14, "x", 8, ["h"], ["H", "H2"], session="S1")
    add(2, 20, "session_start", session="S2")
    commit(2, 21, "x", 5, ["e"], [], session="S2")
    commit(2, 22, "z", 1, ["z1"], ["Z1"], session="S2")
    add(2, 23, "amend", of="2.21")
    commit(2, 24, "w", 1, [], ["w"], "create", session="S2")
    commit(2, 29, "late", 1, [], ["not in the base of 3"], "create")
    commit(3, 30, "z", 4, ["z4"], ["Z4"])
    add(3, 31, "amend", of="3.30")
    add(3, 32, "amend", of="1.11")
    # the target went on, and took in branch 1 up to 12
    add(0, 100, "session_start", session="S7", origin="1.10")
    commit(0, 101, "x", 1, ["a"], ["A"], origin="1.11", session="S7")
    commit(0, 102, "y", 2, ["y2"], ["Y2"], origin="1.12", session="S7")
    add(0, 103, "merge", branch=1, head=12, stopped=[])
    commit(0, 104, "z", 1, ["z1"], ["other"])
    commit(0, 105, "x", 3, ["c"], ["c", "c2"])
    schema = "lineage long, pos long, hash string, type string, origin string, session string, file string, op string, old_start int, old_lines int, old_text array<string>, new_text array<string>, ended boolean, of string, branch long, head long, stopped array<string>"
    names = [x.split()[0] for x in schema.split(", ")]
    records = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)
    branches = spark.createDataFrame([(1, 0, 2), (2, 1, 14), (3, 2, 24), (9, 8, 0)], "branch long, parent long, base long")
    wanted = spark.createDataFrame([(3, 0), (2, 1), (9, 0)], "branch long, target long")
    chain = M.chains(branches, wanted)
    stream = M.streams(records, chain).cache()
    return records, chain, stream, M.placements(stream, records).cache()


def test_chain_of_branches(history):
    got = {(r.branch, r.target, r.member, r.depth, r.upto, r.base) for r in history[1].collect()}
    assert got == {(3, 0, 3, 0, None, 2), (3, 0, 2, 1, 24, 2), (3, 0, 1, 2, 14, 2), (2, 1, 2, 0, None, 14)}


def test_new_records_of_the_stream(history):
    new = [r.hash for r in history[2].where("is_new and target = 0").orderBy("seq").collect()]
    assert new == ["1.13", "1.14", "2.20", "2.21", "2.22", "2.23", "2.24", "3.30", "3.31", "3.32"]


def test_places_of_the_chain(history):
    got = {(r.file, r.seq % M.MEMBER): (r.state, r.start) for r in history[3].where("target = 0").collect()}
    assert got == {("x", 14): ("placed", 9), ("x", 21): ("placed", 6), ("z", 22): ("conflict", None), ("z", 30): ("left", None), ("w", 24): ("placed", 1)}


def test_merge_record_of_each_member(history):
    got = {r.member: (r.head, r.adopted, r.already, r.left, [(s.file, s.at) for s in r.stopped]) for r in M.merge_records(history[2], history[3]).where("target = 0").collect()}
    assert got == {1: (14, 1, 0, 0, []), 2: (24, 2, 0, 1, [("z", 22)]), 3: (32, 0, 0, 1, [("z", 22)])}


def test_what_is_appended(history):
    records, _, stream, places = history
    got = [(r.type, r.nth, r.hash, r.session, r.of, r.start) for r in M.appended(stream, places, records).where("target = 0").orderBy("seq").collect()]
    assert got == [
        ("session_end", 1, "1.13", "1.10", None, None),
        ("commit", 1, "1.14", "1.10", None, 9),
        ("session_start", 1, "2.20", "2.20", None, None),
        ("commit", 2, "2.21", "2.20", None, 6),
        ("amend", 1, "2.23", None, "2.21", None),
        ("commit", 3, "2.24", "2.20", None, 1),
        ("amend", 2, "3.32", None, "1.11", None),
    ]


def test_files_stopped_before_stay_stopped(spark, history):
    records, chain, _, _ = history
    more = spark.createDataFrame([(0, 106, "0.106", "merge", "0.106", 2, 20, ["w", "x"])], "lineage long, pos long, hash string, type string, origin string, branch long, head long, stopped array<string>")
    records = records.unionByName(more, allowMissingColumns=True)
    stream = M.streams(records, chain.where("target = 0"))
    got = {(r.file, r.seq % M.MEMBER): r.state for r in M.placements(stream, records).collect()}
    assert got == {("x", 21): "left", ("w", 24): "left", ("z", 22): "conflict", ("z", 30): "left"}


def test_maps_compose_like_edits():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randint(0, 6)
        edits = [(rng.randint(0, 8), rng.randint(0, 3), rng.randint(0, 3), rng.random() < 0.05) for _ in range(rng.randint(1, 12))]
        lines, maps = [(S.BEFORE, i) for i in range(n)], []
        for p, (h, c, w, gone) in enumerate(edits):
            maps.append(S.edit_map(p, h, c, w, gone, len(lines)))
            lines = [] if gone else lines[:h] + [(p, i) for i in range(w)] + lines[h + c :]
        fold = lambda es: __import__("functools").reduce(lambda f, e: f.then(S.Sizes.of_edit(*e)), es, S.Sizes())
        k = rng.randint(0, len(edits))
        assert fold(edits)(n) == len(lines) and all(fold(edits[:k]).then(fold(edits[k:]))(m) == fold(edits)(m) for m in range(12))
        assert [(s, i) for s, a, b in S.all_composed(maps) for i in range(a, b)] == lines


@pytest.mark.parametrize("edits_a_run", [2, 512])
def test_scan_equals_replay_in_order(spark, edits_a_run):
    rng = random.Random(edits_a_run)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), p, rng.choice(["edit"] * 12 + ["delete", "create"]), rng.randint(-1, 6), rng.randint(0, 3), [f"{p}.{j}" for j in range(rng.randint(0, 3))]) for p in range(120)]
    rows = [(f, p, op, s, n, [] if op == "delete" else t) for f, p, op, s, n, t in rows if f]
    want, wrote = {}, {}
    for f, p, op, s, n, t in rows:
        x = want.setdefault(f, [])
        h = max(s - 1, 0)
        want[f] = [] if op == "delete" else x[:h] + t + x[h + n :]
        wrote[f] = op != "delete"
    commits = spark.createDataFrame(rows, "file string, pos long, op string, old_start int, old_lines int, new_text array<string>")
    assert {r.file: (list(r.lines), r.existing) for r in S.replayed(commits, edits_a_run=edits_a_run).collect()} == {f: (want[f], wrote[f]) for f in want}
    blame = {(r.file, r.line): r.pos for r in S.blamed(S.line_sources(commits, edits_a_run=edits_a_run)).collect()}
    assert blame == {(f, i): int(x.split(".")[0]) for f, lines in want.items() for i, x in enumerate(lines, 1)}
    early = S.replayed(commits, until=F.lit(60), edits_a_run=edits_a_run).count()
    assert early == len({f for f, p, *_ in rows if p <= 60}) and S.replayed(commits.limit(0)).count() == 0


def test_groups_in_python_take_all_cores(spark):
    """The maps of small files are not put together into one task because their rows are few bytes."""
    rows = [(f, p, "create" if p == 0 else "edit", 1, 0, ["x"]) for f in range(40) for p in range(3)]
    commits = spark.createDataFrame(rows, "file long, pos long, op string, old_start int, old_lines int, new_text array<string>")
    sources = S.line_sources(commits)
    assert "REPARTITION_BY_NUM" in sources._jdf.queryExecution().executedPlan().toString()
    assert {r["file"]: len(r["lines"]) for r in S.replayed(commits).collect()} == dict.fromkeys(range(40), 3)
