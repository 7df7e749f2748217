"""Edits in order: replay, blame, islands, running state, reviews.

Replay and blame fold each file's edits, in order of position, as an array expression; a file is one
group, and its edits are gathered because the result depends on their order. Files run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GONE = ("delete", "untrack")
EDIT = ("op", "old_start", "old_lines", "new_start", "new_lines", "new_text")


def applied(lines: Column, edit: Column) -> Column:
    """Lines after one region edit: out-of-range places are clamped, delete and untrack empty the file."""
    head = F.greatest(edit["old_start"] - 1, F.lit(0))
    tail = F.greatest(head + edit["old_lines"], F.lit(0))
    kept = F.when(head > 0, F.slice(lines, F.lit(1), head)).otherwise(F.array().cast("array<string>"))
    rest = F.when(tail < F.size(lines), F.slice(lines, tail + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    return F.when(edit["op"].isin(*GONE), F.array().cast("array<string>")).otherwise(F.concat(kept, edit["new_text"], rest))


def ordered_edits(commits: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    edits = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), *EDIT)))
    return commits.groupBy(file).agg(edits.alias("edits"))


def replay(commits: DataFrame, file: str = "file", pos: str = "pos", until: Column | None = None) -> DataFrame:
    """file, lines, existing as of a position (all of the log without one)."""
    rows = commits if until is None else commits.where(F.col(pos) <= until)
    folded = F.aggregate("edits", F.array().cast("array<string>"), applied)
    return ordered_edits(rows, file, pos).select(file, folded.alias("lines"), (~F.element_at("edits", -1)["op"].isin(*GONE)).alias("existing"))


def blame(commits: DataFrame, lines: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    """file, line, pos of the edit that wrote each asked line (file, line) of the current text; null where the walk ends first."""
    start = F.struct(F.col("line").cast("int").alias("line"), F.lit(None).cast("long").alias("hit"), F.lit(False).alias("over"))

    def step(s: Column, e: Column) -> Column:
        end = e["new_start"] + e["new_lines"]
        inside = (s["line"] >= e["new_start"]) & (s["line"] < end)
        shifted = F.when(s["line"] >= end, s["line"] - e["new_lines"] + e["old_lines"]).otherwise(s["line"])
        gone = e["op"].isin(*GONE)
        go = ~s["over"]
        return F.struct(
            F.when(go & ~gone & ~inside, shifted).otherwise(s["line"]).alias("line"),
            F.when(go & ~gone & inside, e["pos"].cast("long")).otherwise(s["hit"]).alias("hit"),
            (s["over"] | gone | inside | (e["op"] == "create")).alias("over"),
        )

    edits = ordered_edits(commits, file, pos).withColumn("edits", F.reverse("edits"))
    return edits.join(lines, file).select(file, "line", F.aggregate("edits", start, step)["hit"].alias("pos"))


def islands(rows: DataFrame, same: list[str], by: list[str], pos: str) -> DataFrame:
    """Numbers runs of neighbouring rows with equal values as ``island``, from 1 in each ``by``."""
    w = Window.partitionBy(*by).orderBy(pos)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    starts = (change | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_start", starts).withColumn("island", F.sum("_start").over(w).cast("long")).drop("_start")


def gaps(rows: DataFrame, by: list[str], ts: str, seconds: int, pos: str) -> DataFrame:
    """Marks rows that come more than ``seconds`` after the one before."""
    w = Window.partitionBy(*by).orderBy(pos)
    at = F.col(ts).cast("timestamp").cast("double")
    return rows.withColumn("gap", F.coalesce(at - F.lag(at).over(w) > seconds, F.lit(False)))


def running_state(rows: DataFrame, by: list[str], pos: str, opens: Column, closes: Column, value: Column) -> DataFrame:
    """The value that the last opening row set and no closing row has cleared since."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(opens, F.struct(value.alias("v"))).when(closes, F.struct(F.lit(None).cast("string").alias("v")))
    return rows.withColumn("active", F.last(mark, ignorenulls=True).over(w)["v"])


def page_of(rows: DataFrame, size: int, page: int, *order: Column) -> DataFrame:
    """Rows of a page, whose number is clamped to what there is, with ``page``, ``pages`` and ``total``."""
    total = rows.count()
    pages = max(1, -(-total // size))
    at = min(max(page, 1), pages)
    return rows.orderBy(*order).offset((at - 1) * size).limit(size).withColumns({"page": F.lit(at), "pages": F.lit(pages), "total": F.lit(total)})


def message_checks(intent: Column, behavior: Column, previous: Column, changed: Column, forced: Column, whole_delete: Column) -> Column:
    """Codes of what is wrong with a commit's words, in order."""
    from lodestone.config import LEAST_WORDS, TOO_SIMILAR
    from lodestone.functions.text import jaccard, word_set

    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    close = lambda a, b: F.coalesce(jaccard(word_set(a), word_set(b)) >= TOO_SIMILAR, F.lit(False))
    free = forced | whole_delete
    codes = F.array(
        F.when((words(intent) < LEAST_WORDS) | (words(behavior) < LEAST_WORDS), F.lit("message_too_short")),
        F.when(~free & close(behavior, intent), F.lit("behavior_repeats_intent")),
        F.when(~free & close(behavior, previous), F.lit("behavior_repeats_previous")),
        F.when(~free & close(behavior, changed), F.lit("behavior_restates_code")),
    )
    return F.filter(codes, lambda c: c.isNotNull())
