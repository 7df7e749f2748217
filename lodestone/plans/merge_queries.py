"""Registered queries of merging and of the scan of interval maps.

Events are edits of files of 24 lines, one line each: even ones are the target's before branch 1 left it, odd ones fall to the
target, to branch 1, to branch 2 that left 1, and to branch 3 that left 2; branch 3 is merged into the target. Some files are
deleted by the target later on, some are created by branch 1, by the target, or by both.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lodestone.operators import merging as M
from lodestone.operators import shifts as S
from lodestone.operators import snapshots as N
from lodestone.operators.common import cut, shared_folder
from lodestone.plans.log_queries import EDITS, commits
from lodestone.plans.registry import query, table

#: Positions from which a history is past what the next branch sees of it.
LATER, LAST = 100_000_000_000, 200_000_000_000


def _records(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (3 * (F.from_json("props", "k int")["k"] % 7) + 2).alias("ln"))
    odd = F.col("event_id") % 2 == 1
    e = e.withColumn("lineage", F.when(odd, F.floor(F.col("event_id") / 2) % 4).otherwise(0))
    e = e.withColumn("pos", 4 * F.col("event_id") + F.when(odd & (F.col("lineage") > 0) & (F.col("event_id") % 3 == 0), LAST).when(odd, LATER).otherwise(0))
    lines = lambda letter: F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.concat(F.lit(letter), i.cast("string")))
    none = F.array().cast("array<string>")
    text = F.concat(F.lit("v"), (F.floor(F.col("event_id") / 8) % 3).cast("string"))
    columns = ["lineage", "pos", "type", "file", "op", "old_start", "old_lines", "new_text"]
    name = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    edits = e.select("lineage", "pos", F.lit("commit").alias("type"), name.alias("file"), F.lit("edit").alias("op"), F.col("ln").cast("int").alias("old_start"), F.lit(1).alias("old_lines"), F.array(text).alias("new_text"))
    # what a line held before in the same history: branches see the target's early part, and each other's up to LAST
    users = e.select("user_id").distinct()
    whole = lambda file, lineage, pos, op, n, new: (F.lit(lineage).cast("long").alias("lineage"), pos.cast("long").alias("pos"), F.lit("commit").alias("type"), F.concat(F.lit(file), F.col("user_id").cast("string")).alias("file"), F.lit(op).alias("op"), F.lit(1).alias("old_start"), F.lit(n).alias("old_lines"), new.alias("new_text"))
    new_at = LATER + 4 * F.col("user_id") + 2
    made = users.select(*whole("f", 0, F.lit(-1), "create", 0, lines("b")))
    gone = users.where("user_id % 7 = 3").select(*whole("f", 0, F.lit(3 * LATER), "delete", 24, none))
    ours = users.where("user_id % 5 = 0").select(*whole("n", 1, new_at, "create", 0, lines("b")))
    alike = users.where("user_id % 10 = 0 and user_id % 15 <> 0").select(*whole("n", 0, new_at, "create", 0, lines("b")))
    other = users.where("user_id % 15 = 0").select(*whole("n", 0, new_at, "create", 0, lines("c")))
    rows = edits.unionByName(made).unionByName(gone).unionByName(ours).unionByName(alike).unionByName(other).select(*columns)
    # the text that an edit replaces, which a commit records
    order = F.when(F.col("lineage") == 0, F.col("pos")).otherwise(F.col("lineage") * M.MEMBER * 4 + F.col("pos"))
    seen = F.when(F.col("lineage") == 0, F.col("pos") < LATER).otherwise(F.col("pos") < LAST)
    from pyspark.sql import Window

    by_line = Window.partitionBy("file", "old_start").orderBy("_order")
    own = Window.partitionBy("lineage", "file", "old_start").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last(F.when(F.col("_seen"), F.get("new_text", F.lit(0))), ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    last_own = F.last(F.get("new_text", F.lit(0)), ignorenulls=True).over(own)
    edits = rows.where("op = 'edit'").withColumns({"_order": order, "_seen": seen})
    old = F.coalesce(last_own, earlier, F.concat(F.lit("b"), F.col("old_start").cast("string")))
    edits = edits.withColumn("old_text", F.array(old)).drop("_order", "_seen")
    rest = rows.where("op <> 'edit'").withColumn("old_text", none)
    done = edits.unionByName(rest).withColumns({"hash": F.concat_ws(".", "lineage", "pos", "file"), "ended": F.lit(True)})
    amends = done.where("op = 'edit' and lineage > 0 and pos % 44 = 4").select("lineage", (F.col("pos") + 1).alias("pos"), F.lit("amend").alias("type"), F.concat_ws(".", "lineage", (F.col("pos") + 1), "file").alias("hash"), F.col("hash").alias("of"))
    out = done.unionByName(amends, allowMissingColumns=True).withColumn("origin", F.col("hash"))
    more = {"session": "string", "branch": "long", "head": "long", "stopped": "array<string>"}
    return cut(out.withColumns({c: F.lit(None).cast(t) for c, t in more.items()}))


def _merge(spark, sf):
    records = _records(spark, sf)
    branches = spark.createDataFrame([(1, 0, LATER - 1), (2, 1, LAST - 1), (3, 2, LAST - 1)], "branch long, parent long, base long")
    chain = M.chains(branches, spark.createDataFrame([(3, 0)], "branch long, target long"))
    stream = cut(M.streams(records, chain))
    return records, stream, cut(M.placements(stream, records))


PLACES = f"""e AS (SELECT event_id, user_id, 3 * ((props->>'$.k')::INT % 7) + 2 AS ln, CASE WHEN event_id % 2 = 1 THEN event_id // 2 % 4 ELSE 0 END AS lineage,
  4 * event_id + CASE WHEN event_id % 2 = 0 THEN 0 WHEN event_id // 2 % 4 > 0 AND event_id % 3 = 0 THEN {LAST} ELSE {LATER} END AS pos, 'v' || (event_id // 8 % 3) AS txt FROM events),
t AS (SELECT user_id, ln, coalesce(arg_max(txt, pos) FILTER (lineage = 0 AND pos < {LATER}), 'b' || ln) AS base, coalesce(arg_max(txt, pos) FILTER (lineage = 0), 'b' || ln) AS parent FROM e GROUP BY user_id, ln),
s AS (SELECT e.*, lineage * {M.MEMBER} + pos AS seq, base <> parent AS mark, parent FROM e JOIN t USING (user_id, ln) WHERE lineage > 0 AND (lineage = 3 OR pos < {LAST})),
g AS (SELECT *, coalesce(ln <> lag(ln) OVER (PARTITION BY user_id ORDER BY seq), true)::INT AS starts FROM s),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM g),
d AS (SELECT *, CASE WHEN user_id % 7 = 3 THEN 'conflict' WHEN NOT mark THEN 'placed'
  WHEN max(CASE WHEN txt = parent THEN seq END) OVER (PARTITION BY user_id, island) >= seq THEN 'done' ELSE 'conflict' END AS st FROM i),
p AS (SELECT 'f' || user_id AS file, lineage AS member, pos, seq, CASE WHEN coalesce(bool_or(st = 'conflict') OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'left' ELSE st END AS state, ln AS line FROM d
  UNION ALL SELECT DISTINCT 'n' || user_id, 1, {LATER} + 4 * user_id + 2, {M.MEMBER + LATER} + 4 * user_id + 2, CASE WHEN user_id % 15 = 0 THEN 'conflict' WHEN user_id % 10 = 0 THEN 'done' ELSE 'placed' END, 1 FROM events WHERE user_id % 5 = 0)"""


@query("h16_placed_on_target", sql=f"WITH {PLACES} SELECT file, seq, state, CASE WHEN state IN ('placed', 'done') THEN line::INT END AS start FROM p")
def h16_chain(spark, sf):
    """Every commit of three branches on their target: shifted, done in one or several steps, in conflict, or left."""
    return _merge(spark, sf)[2].select("file", "seq", "state", "start")


@query("h17_chain_records", sql=f"""WITH {PLACES}, f AS (SELECT *, min(CASE WHEN state IN ('conflict', 'left') THEN seq END) OVER (PARTITION BY file) AS stop FROM p),
h AS (SELECT member, max(pos) AS head FROM (SELECT member, pos FROM p UNION ALL SELECT member, pos + 1 FROM p WHERE file[1] = 'f' AND pos % 44 = 4) GROUP BY member)
SELECT f.member, h.head, count_if(state = 'placed') AS adopted, count_if(state = 'done') AS already, count_if(state IN ('conflict', 'left')) AS left,
  array_to_string(list_sort(list_distinct(list(CASE WHEN state IN ('conflict', 'left') THEN file || '@' || (stop % {M.MEMBER}) END))), ' ') AS stopped FROM f JOIN h ON h.member = f.member GROUP BY f.member, h.head""")
def h17_chain(spark, sf):
    """The merge record of each branch of the chain."""
    _, stream, placed = _merge(spark, sf)
    r = M.merge_records(stream, placed)
    shown = F.array_join(F.array_sort(F.transform("stopped", lambda x: F.concat_ws("@", x["file"], x["at"].cast("string")))), " ")
    return r.select("member", "head", "adopted", "already", "left", shown.alias("stopped"))


@query("h32_appended_records", sql=f"""WITH {PLACES}, a AS (SELECT seq, 'commit' AS type, line::INT AS start FROM p WHERE state = 'placed' UNION ALL SELECT seq + 1, 'amend', NULL FROM p WHERE state = 'placed' AND file[1] = 'f' AND pos % 44 = 4)
SELECT seq, type, row_number() OVER (PARTITION BY type ORDER BY seq) AS nth, start FROM a""")
def h32_appended(spark, sf):
    """What the merge appends: the placed commits and the amends of those, numbered in the branch's order."""
    records, stream, placed = _merge(spark, sf)
    return M.appended(stream, placed, records).select("seq", "type", "nth", "start")


@query("h2_replay_by_scan", sql=f"WITH RECURSIVE {EDITS} SELECT file, len(lines)::INT AS n, array_to_string(lines, chr(10)) AS text, op <> 'delete' AS existing FROM rp QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1")
def h2_scan(spark, sf):
    return S.replayed(commits(spark, sf), edits_a_run=64).select("file", F.size("lines").alias("n"), F.concat_ws("\n", "lines").alias("text"), "existing")


TAGS = EDITS.replace("[]::VARCHAR[] AS lines", "[]::BIGINT[] AS lines").replace("THEN []::VARCHAR[] ELSE list_concat(list_concat(r.lines[1:e.head], e.txt)", "THEN []::BIGINT[] ELSE list_concat(list_concat(r.lines[1:e.head], [e.pos FOR x IN e.txt])")


@query("h4_blame_by_scan", sql=f"WITH RECURSIVE {TAGS}, z AS (SELECT file, lines FROM rp QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1) SELECT file, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS pos FROM z")
def h4_scan(spark, sf):
    """Which edit wrote each line, out of the map of the whole log."""
    return S.blamed(S.line_sources(commits(spark, sf), edits_a_run=64))


@query("h15_healed_snapshots", sql=f"WITH RECURSIVE {EDITS} SELECT file, len(lines)::INT AS n, array_to_string(lines, chr(10)) AS text, op <> 'delete' AS existing, (SELECT count(DISTINCT user_id) FILTER (user_id % 3 = 0) FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)) AS remade, 0::BIGINT AS remade_again FROM rp QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1")
def h15(spark, sf):
    """Snapshots half way, a third of them damaged; replay finds and remakes those, and the next one finds none."""
    path = os.path.join(shared_folder(spark), f"snapshots-{uuid.uuid4().hex}")
    edits = cut(commits(spark, sf).select("file", "pos", *N.EDIT))
    half = (edits.agg(F.max("pos")).first()[0] or 0) // 2
    snapshots = N.taken(edits, half)
    N.keep(snapshots.withColumn("lines", F.when(F.col("file") % 3 == 0, F.concat("lines", F.array(F.lit("damage")))).otherwise(F.col("lines"))), path)
    states, remade = N.replayed_from(edits, path)
    states, (_, again) = cut(states), N.healed(edits, path)
    count = lambda n, name: F.lit(n).cast("long").alias(name)
    return states.select("file", F.size("lines").alias("n"), F.concat_ws("\n", "lines").alias("text"), "existing", count(remade, "remade"), count(again, "remade_again"))
