"""Append-only logs: framing, decoding, hash chains and folds to current state.

Every fold orders records by an explicit position, never by row order. Latest-per-key folds use
``max_by`` aggregates rather than windows: they combine before the shuffle, so a key that holds a
third of the log costs no more than its partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "type string, id string, source string, path string, title string, mime string, contentHash string, bytes long, fetchedAt string, indexedAt string, chunkCount int, chunkBase long, etag string, meta string, `from` string, rel string, `to` string, createdAt string"
SOURCE = "type string, id string, kind string, locator string, title string, collection string, createdAt string, status string"
HISTORY = "type string, id string, user string, session string, file string, op string, old_start int, old_lines int, new_start int, new_lines int, eof_nl boolean, old_text array<string>, new_text array<string>, intent string, behavior string, msg string, meta map<string,string>, done string, decided string, `left` string, `of` string, ts string, `from` string, name string, parent string, base string, branch string, head string, prev string"
ITEM = "id string, kind string, title string, description string, status string, created string, updated string, epic string, milestone string, size string, priority string, assignee string, labels array<string>"
BOARD = f"op string, item struct<{ITEM.replace(' ', ':').replace(',:', ',')}>, ticket string, author string, body string, id string, at string, `by` string, reason string"


def framed(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line, complete of the lines of each log file; only the last line can be incomplete."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("_lines"))
    # counted before the lines are exploded, so that no line carries the file along
    lines = files.withColumn("_n", F.size("_lines")).select("file", "_n", F.posexplode("_lines").alias("pos", "line"))
    return lines.where("line <> ''").select("file", "pos", "line", (F.col("pos") < F.col("_n") - 1).alias("complete"))


def records(lines: DataFrame, schema: str) -> DataFrame:
    """file, pos, r: complete lines parsed; an incomplete last line is dropped; ``bad`` marks a complete line that is no record."""
    r = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    return lines.where("complete").withColumn("r", r).withColumn("bad", F.col("r.type").isNull() if "type string" in schema else F.col("r.op").isNull())


def latest(rows: DataFrame, key: str | list[str], pos: str, *values: str) -> DataFrame:
    """The values of each key's last record."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), pos).alias("_v"), F.max(pos).alias(pos)).select(*keys, pos, "_v.*")


def fold_documents(log: DataFrame, key: str = "id", pos: str = "pos", kind: str = "type", fetched: str = "fetchedAt", values: tuple[str, ...] = ()) -> DataFrame:
    """Living documents: the last ``document`` record wins, a later ``touch`` moves only the fetch time, ``forget`` is for good until filed anew."""
    at = lambda k: F.max(F.when(F.col(kind) == k, F.col(pos)))
    is_fetch = F.col(kind).isin("document", "touch")
    folded = log.where(F.col(kind).isin("document", "touch", "forget")).groupBy(key).agg(
        at("document").alias("_doc"),
        at("forget").alias("_gone"),
        F.max_by(F.struct(*values), F.when(F.col(kind) == "document", F.col(pos))).alias("_v") if values else F.lit(None).alias("_v"),
        F.max_by(F.when(is_fetch, F.col(fetched)), F.when(is_fetch, F.col(pos))).alias("fetched_at"),
    )
    alive = folded.where(F.col("_doc").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_doc"))))
    return alive.select(key, F.col("_doc").alias("document_pos"), "fetched_at", *(["_v.*"] if values else []))


def fold_set(log: DataFrame, keys: list[str], pos: str, kind: str, add: str, remove: str) -> DataFrame:
    """Keys whose last add or remove record is an add: links, edges, tracked files."""
    return log.where(F.col(kind).isin(add, remove)).groupBy(*keys).agg(F.max_by(kind, pos).alias("_k"), F.max(pos).alias(pos)).where(F.col("_k") == add).drop("_k")


def fold_board(log: DataFrame) -> DataFrame:
    """Items (id, item, comments, archive) of a board log with columns pos, op, item, ticket, author, body, id, at, by, reason."""
    puts = log.where("op = 'put'").select(F.col("item.id").alias("id"), "pos", "item")
    state = latest(puts, "id", "pos", "item").drop("pos")
    first = puts.groupBy("id").agg(F.min("pos").alias("born"))
    gone = log.where("op = 'delete'").groupBy("id").agg(F.max("pos").alias("deleted"))
    alive = state.join(puts.groupBy("id").agg(F.max("pos").alias("put")), "id").join(gone, "id", "left").where("deleted is null or deleted < put").select("id", "item")
    # a mark counts only where the item existed by then
    marks = log.where("op in ('archive', 'unarchive')").join(first, "id").where("pos > born")
    marked = marks.groupBy("id").agg(F.max_by(F.when(F.col("op") == "archive", F.struct("at", "by", "reason")), "pos").alias("archive"))
    said = log.where("op = 'comment'").groupBy(F.col("ticket").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "author", "body", "at"))), lambda c: F.struct(c["author"].alias("author"), c["body"].alias("body"), c["at"].alias("at"))).alias("comments"))
    return alive.join(said, "id", "left").join(marked, "id", "left")


def chain_breaks(lines: DataFrame, pos: str, line: str, prev: str, lineage: list[str]) -> DataFrame:
    """Rows whose ``prev`` is not the sha-256 of the line before; the first line's is 64 zeros. Lineages run side by side."""
    before = F.lag(F.sha2(F.col(line), 256), 1, "0" * 64).over(Window.partitionBy(*lineage).orderBy(pos))
    return lines.withColumn("_want", before).where(F.col(prev) != F.col("_want")).drop("_want")


def chunk_name(path: Column) -> tuple[Column, Column]:
    """(lineage, number) of ``<lineage>.<n>.jsonl``."""
    name = F.substring_index(path, "/", -1)  # a pattern would be tried from every letter of a long path
    return F.regexp_extract(name, r"^([^/]+)\.[0-9]+\.jsonl$", 1), F.regexp_extract(name, r"\.([0-9]+)\.jsonl$", 1).try_cast("int")


def missing_chunks(names: DataFrame) -> DataFrame:
    """lineage, n of the first chunk after each gap in (lineage, n)."""
    before = F.lag("n", 1, 0).over(Window.partitionBy("lineage").orderBy("n"))
    return names.withColumn("_before", before).where(F.col("n") != F.col("_before") + 1).select("lineage", "n")
