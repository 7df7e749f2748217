"""Merging a chain of branches: what of a branch's history its parent takes in, and where it goes.

A branch may have started from a branch, so a merge takes the chain of branches between it and the
history it goes into; chains are found level by level over the table of branches. What earlier merges
took in is left out (the furthest head of any member counts), files that they stopped stay stopped.

A commit's place: the parent's changes since the branch's base are marked in the lines of the branch and
move with its commits. A commit away from every mark shifts by what the marks above it added. One that makes exactly a marked
change, or begins a run of edits that stay inside a mark and end in the parent's text, is done already. One that
overlaps or touches a mark, or replaces text that is not the parent's, is a conflict, and stops its file. A file's existence comes first:
deleting what the parent deleted, and creating what it created alike, is done; creating it otherwise, and editing what
it deleted, is a conflict; untracking always works.

States of files at the base and in the parent come from the scan of interval maps; files are placed
side by side, and a file's commits are read in order by one task, since each place depends on the ones before.

Records: lineage, pos (whole, ascending in a lineage), hash, type (session_start, session_end, commit, amend, merge),
origin (the hash that a copy was first written as, the own hash otherwise), session, file, op, old_start, old_lines, old_text, new_text, ended, of
(the commit that an amend is about), branch, head, stopped (of merges: the branch, the position it was taken to, its stopped files).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.lines import join_lines, line_regions
from lodestone.operators.common import bounded, by_groups, cut
from lodestone.operators.shifts import replayed

#: Room for the positions of one member of a chain in the order of the whole chain.
MEMBER = 1 << 40

EMPTY: tuple[list[str], bool] = ([], True)


def plain(lines: list[str]) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in lines]


@dataclass
class Mark:
    """A change of the parent's in the branch's lines of the moment: ``size`` lines from ``start`` on, of which it has ``grown`` more."""

    start: int
    size: int
    grown: int

    def touches(self, first: int, end: int) -> bool:
        return first <= self.start + self.size and self.start <= end


class Placing:
    """One file: ours (the branch's text), theirs (the parent's, as commits are placed) and whether the parent has the file."""

    def __init__(self, base: tuple[list[str], bool], parent: tuple[list[str], bool] | None):
        self.ours, self.theirs, self.there = base, parent or EMPTY, parent is not None
        regions = line_regions(join_lines(plain(base[0]), base[1]), join_lines(plain(self.theirs[0]), self.theirs[1]))
        self.marks = [Mark(os, ol, nl - ol) for os, ol, _, nl in regions]

    def _their_lines_are(self, at: int, lines: list[str]) -> bool:
        return at >= 1 and plain(self.theirs[0][at - 1 : at - 1 + len(lines)]) == plain(lines) and at - 1 + len(lines) <= len(self.theirs[0])

    def _newline_agrees(self, ended: bool, reaches_end: bool) -> bool:
        return ended == self.theirs[1] if reaches_end else ended in (self.ours[1], self.theirs[1])

    def _settled(self, text: tuple[list[str], bool], there: bool) -> None:
        """Both sides have the same text, which nobody's change stands in the way of."""
        self.ours, self.theirs, self.there, self.marks = text, text, there, []

    def _move(self, from_line: int, by: int, but: Mark | None = None) -> None:
        for m in self.marks:
            if m is not but and m.start >= from_line:
                m.start += by

    def _about_existence(self, c: dict) -> tuple[str, str | None] | None:
        if c["op"] == "delete" and not self.there:
            return "done", None
        if c["op"] == "create" and self.there:
            alike = plain(self.theirs[0]) == plain(c["new_text"]) and self.theirs[1] == c["ended"]
            return ("done", None) if alike else ("conflict", "both sides create it")
        if c["op"] not in ("create", "delete") and not self.there:
            return "conflict", "the parent deleted the file"
        return None

    def _steps_within(self, mark: Mark, commits: list[dict], at: int) -> int:
        """How many of the commits, all edits inside the mark, lead to the parent's text there; 0 if they do not."""
        text, size = self.ours, mark.size
        for n, c in enumerate(commits, 1):
            first = max(1, c["old_start"])
            if c["op"] != "edit" or first < mark.start or first + c["old_lines"] > mark.start + size:
                return 0
            text = (text[0][: first - 1] + c["new_text"] + text[0][first - 1 + c["old_lines"] :], c["ended"])
            size += len(c["new_text"]) - c["old_lines"]
            inside = text[0][mark.start - 1 : mark.start - 1 + size]
            if size == mark.size + mark.grown and len(inside) == size and self._their_lines_are(at, inside) and self._newline_agrees(text[1], mark.start - 1 + size == len(text[0])):
                self._move(mark.start + 1, size - mark.size, mark)
                self.ours, mark.size, mark.grown = text, size, 0
                return n
        return 0

    def place(self, commits: list[dict]) -> list[tuple[str, int | None, bool | None, str | None]]:
        """(state, start, ended, why) of each commit: placed, done, conflict, or left behind one."""
        out: list[tuple] = []
        while len(out) < len(commits):
            c = commits[len(out)]
            if c["op"] == "untrack":
                out.append(("placed" if self.there else "done", 1, True, None))
                self._settled(EMPTY, False)
                continue
            first = max(1, c["old_start"])
            end = first + c["old_lines"]
            if found := self._about_existence(c):
                if found[0] == "conflict":
                    out.append(("conflict", None, None, found[1]))
                    break
                out.append(("done", 1, self.theirs[1], None))
                self._settled(EMPTY if c["op"] == "delete" else self.theirs, c["op"] != "delete")
                continue
            touched = [m for m in self.marks if m.touches(first, end)]
            at = first + sum(m.grown for m in self.marks if m.start + m.size < first)
            only = touched[0] if len(touched) == 1 and c["op"] != "delete" else None
            grows = len(c["new_text"]) - c["old_lines"]
            if only and (only.start, only.size, only.grown) == (first, c["old_lines"], grows) and self._their_lines_are(at, c["new_text"]) and self._newline_agrees(c["ended"], end > len(self.ours[0])):
                out.append(("done", at, self.theirs[1], None))
                self.ours = (self.ours[0][: first - 1] + c["new_text"] + self.ours[0][end - 1 :], c["ended"])
                self._move(end, grows, only)
                only.size, only.grown = len(c["new_text"]), 0  # still the parent's: a later commit that touches it is a conflict
                continue
            if only and (n := self._steps_within(only, commits[len(out) :], only.start + at - first)):
                out += [("done", only.start + at - first, self.theirs[1], None)] * n
                continue
            if why := self._in_the_way(c, touched, first, at):
                out.append(("conflict", None, None, why))
                break
            ended = c["ended"] if c["ended"] != self.ours[1] else self.theirs[1]
            out.append(("placed", at, True if c["op"] == "delete" else ended, None))
            if c["op"] == "delete":
                self.ours, self.theirs, self.there = EMPTY, EMPTY, False
            else:
                self.theirs = (self.theirs[0][: at - 1] + c["new_text"] + self.theirs[0][at - 1 + c["old_lines"] :], ended)
                self.ours = (self.ours[0][: first - 1] + c["new_text"] + self.ours[0][end - 1 :], c["ended"])
                self.there = True
            self._move(end, grows)
        return out + [("left", None, None, None)] * (len(commits) - len(out))

    def _in_the_way(self, c: dict, touched: list[Mark], first: int, at: int) -> str | None:
        if touched:
            both_insert = touched[0].size == 0 and c["old_lines"] == 0 and touched[0].start == first
            return "both sides insert at the same point" if both_insert else "it overlaps or touches a change the parent made"
        if not self._their_lines_are(at, c["old_text"]):
            return "the text it replaces is not the parent's there"
        if c["op"] == "delete" and at - 1 + c["old_lines"] != len(self.theirs[0]):
            return "it deletes a file the parent changed"
        return None


def chains(branches: DataFrame, wanted: DataFrame) -> DataFrame:
    """branch, target, member, depth, upto, base: the branches that a merge of ``branch`` into ``target`` takes in, ``depth`` 0 being itself.

    ``branches``: branch, parent, base (the position in the parent's history that it sees); ``wanted``: branch, target. A member counts up to
    ``upto`` (null: all of it); ``base`` is where the target was left. A merge whose branch does not lead to its target has no rows.
    """
    step = branches.select(F.col("branch").alias("_b"), F.col("parent").alias("_parent"), F.col("base").alias("_base"))
    level = wanted.select("branch", "target", F.col("branch").alias("member"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("upto"))
    found, n = None, branches.count()
    for depth in range(1, n + 2):  # a longer chain would be a loop
        level = cut(level.join(bounded(step), F.col("member") == F.col("_b")))
        rows = level.select("branch", "target", "member", "depth", "upto", F.when(F.col("_parent") == F.col("target"), F.col("_base")).alias("base"))
        found = rows if found is None else found.unionByName(rows)
        level = level.where("_parent is not null and _parent <> target").select("branch", "target", F.col("_parent").alias("member"), F.lit(depth).alias("depth"), F.col("_base").cast("long").alias("upto"))
        if level.isEmpty():
            break
    whole = Window.partitionBy("branch", "target")
    return found.withColumn("base", F.max("base").over(whole)).where("base is not null")


def streams(records: DataFrame, chain: DataFrame) -> DataFrame:
    """The records of each merge's chain in one order (``seq``), with ``member``, ``depth`` and ``is_new``: not taken in by an earlier merge of the target.

    The target's own records up to the base come first, as member null.
    """
    deepest = F.max("depth").over(Window.partitionBy("branch", "target"))
    chain = cut(chain.withColumn("_first", (deepest - F.col("depth") + 1) * F.lit(MEMBER)))
    keys = chain.select("branch", "target", "base").distinct()
    names = [F.col(f"r.{c}") for c in records.columns if c not in ("branch",)]
    own = records.alias("r").join(bounded(keys.alias("k")), (F.col("r.lineage") == F.col("k.target")) & (F.col("r.pos") <= F.col("k.base")))
    own = own.select(F.col("k.branch").alias("into_branch"), "k.target", F.lit(None).cast(chain.schema["member"].dataType).alias("member"), F.lit(None).cast("int").alias("depth"), F.col("r.pos").cast("long").alias("seq"), *names)
    # the furthest place that an earlier merge of any member reached
    heads = records.where("type = 'merge'").select(F.col("lineage").alias("target"), F.col("branch").alias("member"), "head")
    taken = chain.join(heads, ["target", "member"]).groupBy("branch", "target").agg(F.max(F.col("_first") + F.col("head")).alias("_taken"))
    theirs = records.alias("r").join(bounded(chain.alias("k")), (F.col("r.lineage") == F.col("k.member")) & (F.col("k.upto").isNull() | (F.col("r.pos") <= F.col("k.upto"))))
    theirs = theirs.select(F.col("k.branch").alias("into_branch"), "k.target", "k.member", "k.depth", (F.col("k._first") + F.col("r.pos")).alias("seq"), *names)
    rows = own.unionByName(theirs)
    taken = bounded(taken.select(F.col("branch").alias("into_branch"), "target", "_taken"))
    out = rows.join(taken, ["into_branch", "target"], "left")
    return out.withColumn("is_new", F.col("member").isNotNull() & (F.col("seq") > F.coalesce("_taken", F.lit(-1)))).drop("_taken")


_PLACED = "into_branch {b}, target {t}, file {f}, seq long, state string, start int, ended boolean, why string"


_COMMIT = ("op", "old_start", "old_lines", "old_text", "new_text", "ended")
_PLACE_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string())
#: Places that a task hands on at once.
PLACES_AT_ONCE = 10_000


def _files(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple[tuple, dict, list[tuple]]]:
    """(keys, state, commits) of each file, out of rows in order; ``kinds`` gets the types of the keys."""
    held = None
    for batch in batches:
        names = batch.schema.names
        kinds[:] = [batch.schema.field(c).type for c in names[:3]]
        for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if row[3] is None:
                if held is not None:
                    yield held
                held = row[:3], dict(zip(names, row, strict=True)), []
            else:
                held[2].append(row[3:10])
    if held is not None:
        yield held


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each file's commits, in order."""
    kinds: list = []
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        types = (*kinds, *_PLACE_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["into_branch", "target", "file", "seq", "state", "start", "ended", "why"])

    text = lambda x: None if x is None else (x["lines"], bool(x["ended"]))
    for keys, state, commits in _files(batches, kinds):
        if state["stopped"]:
            found = [("left", None, None, "stopped by an earlier merge")] * len(commits)
        else:
            edits = [
                {"op": op, "old_start": start, "old_lines": n, "old_text": old or [], "new_text": new or [], "ended": ended is None or ended}
                for _, op, start, n, old, new, ended in commits
            ]
            found = Placing(text(state["base"]) or EMPTY, text(state["parent"])).place(edits)
        out += [(*keys, c[0], *f) for c, f in zip(commits, found, strict=True)]
        if len(out) >= PLACES_AT_ONCE:
            yield made()
            out = []
    if out:
        yield made()


def placements(stream: DataFrame, records: DataFrame) -> DataFrame:
    """into_branch, target, file, seq, state, start, ended, why of every new commit of each merge."""
    commits = stream.where("type = 'commit'")
    new = commits.where("is_new")
    keys = ["into_branch", "target", "file"]
    touched = cut(new.select(*[F.col(c).alias(c) for c in keys]).distinct())
    named = lambda d: d.withColumn("_key", F.struct(*keys))
    final = lambda d, order: d.groupBy(*keys).agg(F.max_by("ended", order).alias("ended"))
    before = cut(named(commits.where("not is_new").join(touched, keys, "left_semi")))
    parent_rows = records.where("type = 'commit'").select(F.col("lineage").alias("target"), "file", "pos", "op", "old_start", "old_lines", "new_text", "ended").join(touched, ["target", "file"])
    parent_rows = cut(named(parent_rows))

    def state(rows: DataFrame, order: str, name: str) -> DataFrame:
        text = replayed(rows, "_key", order).select("_key.*", "lines", "existing").join(final(rows, order), keys)
        return text.select(*keys, F.when(F.col("existing"), F.struct("lines", "ended")).alias(name))

    stopped = records.where("type = 'merge'").select(F.col("lineage").alias("target"), F.col("branch").alias("member"), F.explode("stopped").alias("file"))
    members = stream.where("member is not null").select("into_branch", "target", "member").distinct()
    stopped = stopped.join(members, ["target", "member"]).select(*keys, F.lit(True).alias("stopped")).distinct()
    states = touched.join(state(before, "seq", "base"), keys, "left").join(state(parent_rows, "pos", "parent"), keys, "left").join(stopped, keys, "left")

    kinds = {c: stream.schema[n].dataType.simpleString() for c, n in (("b", "into_branch"), ("t", "target"), ("f", "file"))}
    narrow = new.select(*keys, "seq", *_COMMIT)
    # a file's state comes before its commits
    rows = by_groups(narrow.unionByName(states, allowMissingColumns=True), *keys).sortWithinPartitions(*keys, F.col("seq").asc_nulls_first())
    return rows.mapInArrow(_placed, _PLACED.format(**kinds))


def merge_records(stream: DataFrame, placed: DataFrame) -> DataFrame:
    """into_branch, target, member, head, adopted, already, left, stopped: one for each member with anything new.

    ``stopped`` has the files that a member left commits of, with the place of the commit at which the file stopped.
    """
    keys = ["into_branch", "target"]
    new = stream.where("is_new").select(*keys, "member", "seq", "pos", "type", "file")
    heads = new.groupBy(*keys, "member").agg(F.max("pos").alias("head"))
    rows = new.where("type = 'commit'").join(placed.select(*keys, "file", "seq", "state"), [*keys, "file", "seq"])
    is_left = F.col("state").isin("conflict", "left")
    stop = F.min(F.when(is_left, F.col("seq"))).over(Window.partitionBy(*keys, "file"))
    by_file = rows.withColumn("_at", stop % MEMBER).groupBy(*keys, "member", "file").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("placed", "done")], F.count_if(is_left).alias("left"), F.min("_at").alias("at"))
    stops = F.array_sort(F.collect_list(F.when(F.col("left") > 0, F.struct("file", "at"))))
    sums = by_file.groupBy(*keys, "member").agg(F.sum("placed").alias("adopted"), F.sum("done").alias("already"), F.sum("left").alias("left"), stops.alias("stopped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.array().cast(sums.schema["stopped"].dataType)
    return heads.join(sums, [*keys, "member"], "left").select(*keys, "member", "head", zero("adopted"), zero("already"), zero("left"), F.coalesce("stopped", none).alias("stopped"))


def appended(stream: DataFrame, placed: DataFrame, records: DataFrame) -> DataFrame:
    """into_branch, target, seq, type, nth, hash, session, of, start, ended: what each merge appends to its target, in the branch's order.

    A session's start is taken in once, whatever way it came; its end if the start is here and the end is not yet; a commit
    where it was placed; an amend if its commit has a copy here and it has none itself. ``nth`` counts sessions and commits, each from
    1; ``session`` and ``of`` are origins (the copies' ids follow from ``nth``, or from the copy that is here).
    """
    keys = ["into_branch", "target"]
    new = stream.where("is_new").select(*keys, "seq", "type", "hash", "origin", "session", "of").join(placed.select(*keys, "seq", "state", "start", "ended"), [*keys, "seq"], "left")
    here = records.select(F.col("lineage").alias("target"), F.col("type").alias("_type"), F.col("origin").alias("_origin"), F.lit(True).alias("_here")).distinct()
    # sessions and commits that are in the target, or that this merge brings; names of a session are its start's origin
    brought = new.where("type = 'session_start' or (type = 'commit' and state = 'placed')").select(*keys, F.col("type").alias("_type"), F.col("origin").alias("_origin")).distinct().withColumn("_brought", F.lit(True))
    starts = stream.where("type = 'session_start'").groupBy(*keys, "session").agg(F.max_by("origin", "seq").alias("_start"))
    origins = stream.where("type = 'commit'").select(*keys, F.col("hash").alias("of"), F.col("origin").alias("_commit"))
    rows = new.join(starts, [*keys, "session"], "left").join(origins, [*keys, "of"], "left")
    target_of = F.when(F.col("type") == "session_end", F.col("_start")).when(F.col("type") == "amend", F.col("_commit"))
    kind_of = F.when(F.col("type") == "session_end", "session_start").when(F.col("type") == "amend", "commit")
    rows = rows.withColumns({"_needs": target_of, "_needs_type": kind_of})
    known = here.select("target", F.col("_type").alias("_needs_type"), F.col("_origin").alias("_needs"), F.col("_here").alias("_needed_here"))
    bring = brought.select(*keys, F.col("_type").alias("_needs_type"), F.col("_origin").alias("_needs"), F.col("_brought").alias("_needed_brought"))
    rows = rows.join(known, ["target", "_needs_type", "_needs"], "left").join(bring, [*keys, "_needs_type", "_needs"], "left")
    rows = rows.join(here.select("target", F.col("_type").alias("type"), F.col("_origin").alias("origin"), "_here"), ["target", "type", "origin"], "left")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "type", "origin").orderBy("seq")))
    fresh = F.col("_here").isNull() & (F.col("_nth") == 1)
    wanted = F.when(F.col("type") == "session_start", fresh).when(F.col("type") == "commit", F.col("state") == "placed")
    wanted = wanted.when(F.col("type").isin("session_end", "amend"), fresh & (F.col("_needed_here").isNotNull() | F.col("_needed_brought").isNotNull())).otherwise(False)
    counted = numbered(rows.where(F.coalesce(wanted, F.lit(False))), keys)
    session = F.when(F.col("type") == "session_start", F.col("origin")).otherwise(F.col("_start"))
    return counted.select(*keys, "seq", "type", "nth", "hash", session.alias("session"), F.when(F.col("type") == "amend", F.col("_commit")).alias("of"), "start", "ended")


def numbered(rows: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """``nth`` of rows within keys and type, in the order of ``seq``: ranges of the order are counted, then numbered inside."""
    ranged = cut(rows.repartitionByRange(parts, *keys, "seq").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "type", "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = bounded(counts.select(*keys, "type", "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*keys, "type", "_part").orderBy("seq"))
    return ranged.withColumn("_in", inside).join(before, [*keys, "type", "_part"]).withColumn("nth", (F.col("_before") + F.col("_in")).cast("long"))
