"""History as sessions and commits: the fold of decoded records, session requests, commits from a difference, blame of current lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.lines import diff_regions
from lodestone.operators.history import blame


def commit_sessions(records: DataFrame) -> DataFrame:
    """pos, hash, session, orphan, intent, behavior, amendments, amended_by of every commit.

    ``records``: pos, type, id, session, hash, of, user, intent, behavior. A commit belongs to its
    session if that was started before it; otherwise it is an orphan. Later amendments of its hash
    give it their words, the last in the log being the latest; one of no hash amends nothing, and a
    commit without hash has none. Both joins are by key with the position decided inside windows, so a
    session or commit named often makes no pairs; these windows only grow from row to row, since a frame
    to the end of a group is read anew for each of its rows.
    """
    w = Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = records.where("type in ('commit', 'session_start')").withColumn("name", F.when(F.col("type") == "commit", F.col("session")).otherwise(F.col("id")))
    started = F.last(F.when(F.col("type") == "session_start", F.col("pos")), ignorenulls=True).over(w)
    commits = named.withColumn("_started", started).where("type = 'commit'")
    amends = records.where("type = 'amend' and of is not null").select(F.col("of").alias("hash"), "pos", "type", "user", "intent", "behavior", F.lit(None).cast("string").alias("session"), F.lit(None).cast("long").alias("_started"))
    rows = commits.select("hash", "pos", "type", "user", "intent", "behavior", "session", "_started").union(amends)
    # commits without hash stay apart
    after = Window.partitionBy("hash", F.when(F.col("hash").isNull(), F.col("pos"))).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    amend = F.col("type") == "amend"
    latest = F.first(F.when(amend, F.struct("intent", "behavior", "user")), ignorenulls=True).over(after)
    n = F.count(F.when(amend, True)).over(after)
    return rows.withColumn("_a", latest).withColumn("amendments", n).where("type = 'commit'").select(
        "pos", "hash", "session", F.col("_started").isNull().alias("orphan"),
        F.when(F.col("_a").isNull(), F.col("intent")).otherwise(F.col("_a.intent")).alias("intent"),
        F.when(F.col("_a").isNull(), F.col("behavior")).otherwise(F.col("_a.behavior")).alias("behavior"),
        "amendments", F.col("_a.user").alias("amended_by"),
    )


def session_requests(requests: DataFrame, by: str, pos: str) -> DataFrame:
    """``requests`` (op start or end, msg) with ``answer`` and the number of the session that a start opens or an end closes.

    An accepted or refused start leaves a session open, an accepted or refused end leaves none, so the
    request before decides; a start without a purpose changes nothing.
    """
    w = Window.partitionBy(by).orderBy(pos)
    counts = F.when((F.col("op") == "start") & (F.coalesce(F.trim("msg"), F.lit("")) == ""), F.lit(None)).otherwise(F.col("op"))
    before = F.last(counts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    is_open = F.coalesce(before == "start", F.lit(False))
    answer = F.when(counts.isNull(), "message_required").when((F.col("op") == "start") & is_open, "session_active").when((F.col("op") == "end") & ~is_open, "no_active_session").otherwise("ok")
    rows = requests.withColumn("answer", answer)
    opened = F.count(F.when((F.col("answer") == "ok") & (F.col("op") == "start"), True)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("session", F.when(F.col("answer") == "ok", opened))


def commit_records(files: DataFrame) -> DataFrame:
    """file, answer and the record of a commit (file, old, new): exactly one changed region, else nothing_to_commit or several_regions."""
    rows = files.select("file", "old", "new").withColumn("_r", diff_regions("old", "new"))
    answer = F.when(F.size("_r") == 0, "nothing_to_commit").when(F.size("_r") > 1, "several_regions").otherwise("ok")
    one, op = F.get("_r", F.lit(0)), F.when(F.coalesce("old", F.lit("")) == "", "create").when(F.coalesce("new", F.lit("")) == "", "delete").otherwise("edit")
    cut = lambda text, at, n: F.when(n > 0, F.slice(F.split(text, "\n"), at, n)).otherwise(F.array().cast("array<string>"))
    ok = F.col("answer") == "ok"
    old, new = cut("old", F.col("_o.old_start"), F.col("_o.old_lines")), cut("new", F.col("_o.new_start"), F.col("_o.new_lines"))
    return rows.withColumn("answer", answer).withColumn("_o", F.when(F.col("answer") == "ok", one)).select("file", "answer", F.when(ok, op).alias("op"), "_o.old_start", "_o.old_lines", "_o.new_start", "_o.new_lines", F.when(ok, old).alias("old_text"), F.when(ok, new).alias("new_text"))


def committed_line(regions: Column, line: Column) -> Column:
    """The line of the committed text that a line of the current text stands for; null for a line of a pending region."""
    inside = F.exists(regions, lambda r: (line >= r["new_start"]) & (line < r["new_start"] + r["new_lines"]))
    moved = F.aggregate(regions, F.lit(0), lambda a, r: a + F.when(line >= r["new_start"] + r["new_lines"], r["new_lines"] - r["old_lines"]).otherwise(0))
    return F.when(~inside, line - moved)


def blame_current(commits: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """file, line, pending, pos for asked lines (file, line) of the current text: ``files`` holds file, committed, current."""
    regions = files.select("file", diff_regions("committed", "current").alias("_r"))
    asked = lines.join(regions, "file").select("file", F.col("line").alias("_asked"), committed_line(F.col("_r"), F.col("line").cast("int")).alias("line"))
    hits = blame(commits, asked.where("line is not null").select("file", "line").distinct())
    return asked.join(hits, ["file", "line"], "left").select("file", F.col("_asked").alias("line"), F.col("line").isNull().alias("pending"), "pos")


def files_of_session(commits: DataFrame, session: str = "session", pos: str = "pos") -> DataFrame:
    """session, file, place: files in the order of their first commit, without those whose last commit stops tracking them."""
    ends = commits.where(F.col(session).isNotNull()).groupBy(session, "file").agg(F.min(pos).alias("_first"), F.max_by("op", pos).alias("_op")).where("_op <> 'untrack'")
    return ends.select(session, "file", F.row_number().over(Window.partitionBy(session).orderBy("_first")).alias("place"))


def shell_word(s: Column) -> Column:
    """Quoted for a shell unless it holds plain characters only."""
    quoted = F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(s.rlike(r"\A[A-Za-z0-9_./@%+=:,-]+\z"), s).otherwise(quoted)


def finish_message(subject: Column, ticket: Column) -> Column:
    """The commit's subject in one line, with the ticket behind it unless it ends so already."""
    line = F.regexp_replace(F.regexp_replace(subject, r"\A\s+|\s+\z", ""), r"\s+", " ")
    mark = F.concat(F.lit("("), ticket, F.lit(")"))
    return F.when(F.endswith(line, mark), line).otherwise(F.concat_ws(" ", line, mark))


def finish_command(files: Column, message: Column, *logs: str) -> Column:
    """The command that records a session's files, in order, and the logs beside them."""
    paths = F.concat(files, F.array(*[F.lit(x) for x in logs]).cast("array<string>"))
    return F.concat(F.lit("git add -- "), F.array_join(F.transform(paths, shell_word), " "), F.lit(" && git commit -m "), shell_word(message))


def finish_comment(session: Column, message: Column, ticket: Column, done: Column, **more: Column) -> Column:
    """The ticket's closing comment; of ``more`` (decided, left, tests, not_verified) those that say something, in that order."""
    head = F.concat(F.lit("Done in "), session, F.lit('; git: "'), message, F.lit('" (`git log --grep '), ticket, F.lit("`)."))
    part = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"**{name}.** "), F.trim(c)))
    given = [part(n.capitalize().replace("_", " "), more[n]) for n in ("decided", "left", "tests", "not_verified") if n in more]
    return F.concat_ws("\n\n", head, F.concat(F.lit("**Done.** "), F.trim(done)), *given)


def finished(touched: DataFrame, active: DataFrame, pending: DataFrame) -> DataFrame:
    """ticket, session, code, files: what a ticket's closing would record, or why it may not be closed.

    ``touched``: session, file, place, kept (not kept: the last commit took the file out). ``active``: ticket, session
    (null: none). ``pending``: file with edits that no commit has. ``no_session`` comes before ``pending_edits``.
    """
    mine = touched.join(pending.select("file").distinct().withColumn("_open", F.lit(True)), "file", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("place", "file")))), lambda x: x["file"])
    per = mine.groupBy("session").agg(ordered.alias("files"), F.coalesce(F.bool_or("_open"), F.lit(False)).alias("_open"))
    code = F.when(F.col("session").isNull(), "no_session").when(F.col("_open"), "pending_edits")
    none = F.array().cast("array<string>")
    return active.join(per, "session", "left").select("ticket", "session", code.alias("code"), F.when(code.isNull(), F.coalesce("files", none)).otherwise(none).alias("files"))
