"""Branches: registry, ranges, status, and placing a branch's changes on its parent.

Windows over one file or one level at a time; no pairs of regions are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.store import running_base


def deep_listing(entries: DataFrame) -> DataFrame:
    """id, name, path, depth of entries (id, name, parent) below those without a parent; one join for each level of the tree.

    An entry whose parent is not there, or that is its own ancestor, is not reached.
    """
    level = entries.where("parent is null").select("id", "name", F.col("name").alias("path"), F.lit(0).alias("depth"))
    out, depth, children = level, 0, entries.where("parent is not null")
    up = lambda d: d.select(F.col("id").alias("_up"), F.col("path").alias("_path"))
    while not level.isEmpty():
        depth += 1
        level = children.join(up(level), F.col("parent") == F.col("_up")).select("id", "name", F.concat_ws("/", "_path", "name").alias("path"), F.lit(depth).alias("depth"))
        out = out.union(level)
    return out


def looked_up(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """ref, state, id of references (ref) to entries (id, name) by id or by name; of several names none is taken."""
    by_id = entries.select(F.col("id").cast("string").alias("ref"), "id", F.lit(0).alias("how"))
    by_name = entries.select(F.col("name").alias("ref"), "id", F.lit(1).alias("how"))
    known = by_id.union(by_name).groupBy("ref").agg(F.min("how").alias("how"), F.count(F.lit(1)).alias("n"), F.min(F.struct("how", "id"))["id"].alias("id"), F.count_if(F.col("how") == 0).alias("ids"))
    state = F.when(F.col("n").isNull(), "none").when((F.col("ids") == 0) & (F.col("n") > 1), "ambiguous").otherwise("found")
    return wanted.join(known, "ref", "left").select("ref", state.alias("state"), F.when(state == "found", F.col("id")).alias("id"))


def registry_after(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Entries (id, folder) after edits (id, pos, op, folder): the last edit of an id decides; ``forget`` removes, ``move`` sets the folder."""
    last = edits.groupBy("id").agg(F.max_by(F.struct("op", F.col("folder").alias("to")), "pos").alias("_e"))
    both = entries.join(last, "id", "left").where("_e is null or _e.op <> 'forget'")
    return both.select("id", F.when(F.col("_e.op") == "move", F.col("_e.to")).otherwise(F.col("folder")).alias("folder"))


def session_ranges(commits: DataFrame, session: str = "session", pos: str = "pos") -> DataFrame:
    """session, first, last, own, inside: a session's range by position and all commits in it, those of other sessions too."""
    placed = running_base(commits.withColumn("one", F.lit(1)), "one", [pos])
    ends = placed.where(F.col(session).isNotNull()).groupBy(session).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("own"), F.min("base").alias("_a"), F.max("base").alias("_b"))
    return ends.select(session, "first", "last", "own", (F.col("_b") - F.col("_a") + 1).cast("long").alias("inside"))


def ref_ranges(commits: DataFrame, wanted: DataFrame, ref: str = "ref", pos: str = "pos") -> DataFrame:
    """request, state, first, last, inside of ranges (request, from, to) between two commits named by ``ref``, both ends included.

    ``not_found`` where an end is no commit, ``empty_range`` where the second lies before the first.
    """
    placed = running_base(commits.withColumn("one", F.lit(1)), "one", [pos])
    ends = [placed.select(F.col(ref).alias(x), F.col(pos).alias(n), F.col("base").alias(f"_{n}")) for x, n in (("from", "first"), ("to", "last"))]
    both = wanted.join(ends[0], "from", "left").join(ends[1], "to", "left")
    state = F.when(F.col("first").isNull() | F.col("last").isNull(), "not_found").when(F.col("first") > F.col("last"), "empty_range").otherwise("ok")
    found = lambda c: F.when(state == "ok", c)
    return both.select("request", state.alias("state"), found(F.col("first")).alias("first"), found(F.col("last")).alias("last"), found((F.col("_last") - F.col("_first") + 1).cast("long")).alias("inside"))


def file_status(tracked: DataFrame, working: DataFrame) -> DataFrame:
    """file, status of every file: tracked (file, lines, existing) against the working tree (file, lines)."""
    t = tracked.where("existing").select("file", F.col("lines").alias("_old"))
    both = t.join(working.select("file", F.col("lines").alias("_new")), "file", "full_outer")
    return both.select("file", F.when(F.col("_old").isNull(), "untracked").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "clean").otherwise("modified").alias("status"))


def adopted(parent: DataFrame, ours: DataFrame) -> DataFrame:
    """file, old_start, old_lines, new_lines, text, state, shift: where each region of a branch's file goes on its parent.

    Both hold regions of (file, old_start, old_lines, new_lines, text) relative to the common base; the
    regions of one side do not overlap. A region shifts by what the parent's earlier regions added. It is
    ``done`` if the parent has the same change, a ``conflict`` if it touches a changed place, and after a
    conflict the rest of the file is ``left``.
    """
    side = lambda d, mine: d.select("file", "old_start", "old_lines", "new_lines", "text", F.lit(mine).alias("_mine"))
    rows = side(parent, 0).union(side(ours, 1))
    end = F.col("old_start") + F.col("old_lines")
    region = F.when(F.col("_mine") == 0, F.struct("old_start", "old_lines", "text", end.alias("end")))
    in_order = Window.partitionBy("file").orderBy("old_start", "old_lines", "_mine")
    before, after = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    at_end = Window.partitionBy("file").orderBy(F.when(F.col("_mine") == 0, end).otherwise(F.col("old_start"))).rangeBetween(Window.unboundedPreceding, 0)
    added = F.when(F.col("_mine") == 0, F.col("new_lines") - F.col("old_lines"))
    here = F.when((F.col("_mine") == 0) & (F.col("old_lines") == 0), F.col("new_lines"))
    rows = rows.select(
        "*",
        F.last(region, ignorenulls=True).over(before).alias("_before"),
        F.first(region, ignorenulls=True).over(after).alias("_after"),
        F.coalesce(F.sum(added).over(at_end), F.lit(0)).alias("_added"),
        # an insertion of the parent's at the very place
        F.coalesce(F.sum(here).over(Window.partitionBy("file", "old_start")), F.lit(0)).alias("_here"),
    ).where("_mine = 1")
    width, start = F.greatest("old_lines", F.lit(1)), F.col("old_start")
    same = lambda c: F.coalesce((F.col(f"{c}.old_start") == start) & (F.col(f"{c}.old_lines") == F.col("old_lines")) & (F.col(f"{c}.text") == F.col("text")), F.lit(False))
    earlier = lambda c: (F.col(f"{c}.end") <= start) & ~((F.col(f"{c}.old_lines") == 0) & (F.col(f"{c}.old_start") == start) & (F.col("old_lines") == 0))
    touches = lambda c: F.coalesce(~earlier(c) & (F.col(f"{c}.old_start") < start + width) & (start < F.col(f"{c}.old_start") + F.greatest(F.col(f"{c}.old_lines"), F.lit(1))), F.lit(False))
    state = F.when(same("_before") | same("_after"), "done").when(touches("_before") | touches("_after"), "conflict").otherwise("placed")
    stopped = F.max((F.col("_state") == "conflict").cast("int")).over(Window.partitionBy("file").orderBy("old_start", "old_lines").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_state", state).withColumn("state", F.when(F.coalesce(stopped, F.lit(0)) == 1, "left").otherwise(F.col("_state")))
    shift = F.when(F.col("state") == "placed", (F.col("_added") - F.when(F.col("old_lines") == 0, F.col("_here")).otherwise(0)).cast("long"))
    return rows.select("file", "old_start", "old_lines", "new_lines", "text", "state", shift.alias("shift"))


def merge_record(placed: DataFrame, branch: Column) -> DataFrame:
    """branch, adopted, already, left, stopped (the files a conflict stopped, with its place) of placed regions."""
    rows = placed.withColumn("branch", branch)
    n = lambda s: F.count_if(F.col("state") == s)
    stops = F.array_sort(F.collect_list(F.when(F.col("state") == "conflict", F.struct("file", F.col("old_start").alias("at")))))
    return rows.groupBy("branch").agg(n("placed").alias("adopted"), n("done").alias("already"), (n("left") + n("conflict")).alias("left"), stops.alias("stopped"))
