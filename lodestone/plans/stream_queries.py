"""Registered queries of tails, appended logs and budgeted embedding: files and streams made from the given tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.common import shared_folder
from lodestone.plans.registry import query, table
from lodestone.sources import log_source as L
from lodestone.sources import logs
from lodestone.streaming import embedding as E

FILES = 16


def _place(spark, what: str) -> str:
    return os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")


def write_files(rows: DataFrame, folder: str) -> None:
    """Files of ``rows`` (name, pos, text) in the order of pos, written whole and then put in place; the texts are taken as they are."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = L._place(folder)
        system.create_dir(place, recursive=True)
        own, name, out, n = f"{place}/.{uuid.uuid4().hex}", None, None, 0
        for batch in batches:
            for file, text in zip(batch["name"], batch["text"], strict=True):
                if file != name:
                    if out is not None:
                        out.close()
                        system.move(own, f"{place}/{name}")
                    name, out, n = file, system.open_output_stream(own), n + 1
                out.write(text.encode())
        if out is not None:
            out.close()
            system.move(own, f"{place}/{name}")
        yield pd.DataFrame({"n": [n]})

    rows.repartition("name").sortWithinPartitions("name", "pos").mapInPandas(task, "n long").agg(F.sum("n")).collect()  # one number


@query("s19_tail_of_files", sql=f"SELECT user_id % {FILES} AS file, count(*) AS lines, sum(event_id)::BIGINT AS ids, max(event_id) AS last FROM events WHERE user_id % {FILES} <> 3 OR event_id % 4 = 0 GROUP BY 1")
def s19_tail(spark, sf):
    """Log files that grow with a torn last line, are completed, and of which one is written anew and shorter; three runs of one tail."""
    folder, target, checkpoint = (_place(spark, x) for x in ("tail", "tail-table", "tail-checkpoint"))
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % FILES).alias("file"))
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    rows = e.select(F.concat("file", F.lit(".jsonl")).alias("name"), F.col("event_id").alias("pos"), F.concat(line, F.lit("\n")).alias("text"), "file", "event_id")
    early = rows.where(F.col("event_id") <= half)
    torn = rows.where(F.col("event_id") > half).groupBy("name").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text")).withColumn("text", F.substring("text", 1, 5))
    for step in (early.select("name", "pos", "text").unionByName(torn), rows.select("name", "pos", "text"), rows.where("file = 3 and event_id % 4 = 0").select("name", "pos", "text")):
        write_files(step, folder)
        L.tail_to_table(spark, folder, target, checkpoint)
    found = L.tailed(spark, target).select(F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("file"), F.get_json_object("line", "$.id").cast("long").alias("id"))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum("id").alias("ids"), F.max("id").alias("last"))


RECORD = """'{"type":"' || CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'session_end' ELSE 'amend' END || '"' || CASE WHEN event_type IN ('signup', 'error') THEN ',"id":"S' ELSE ',"of":"' END || event_id || '"'"""


@query("w1_appended_log", sql=f"""WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {RECORD} AS head FROM events),
c AS (SELECT user_id, i, head || ',"prev":"' || repeat('0', 64) || '"}}' AS line FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, r.head || ',"prev":"' || sha256(c.line) || '"}}' FROM c JOIN r ON r.user_id = c.user_id AND r.i = c.i + 1)
SELECT user_id::VARCHAR AS lineage, count(*) AS records, sha256(arg_max(line, i)) AS head, 0::BIGINT AS breaks FROM c GROUP BY user_id""")
def w1_log(spark, sf):
    """Requests of events appended to a log in two batches, read back, each line holding the hash of the one before."""
    folder = _place(spark, "log")
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "error", "session_end").otherwise("amend")
    own = F.col("event_id").cast("string")
    # the words of an amend are checked elsewhere; here they are forced
    asked = e.select(F.col("user_id").cast("string").alias("lineage"), F.col("event_id").alias("pos"), kind.alias("type"), F.when(kind != "amend", F.concat(F.lit("S"), own)).alias("id"), F.when(kind == "amend", own).alias("of"))
    made = L.as_records(asked)
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for batch in (made.where(F.col("pos") <= half), made.where(F.col("pos") > half)):
        L.append(batch.select("lineage", "pos", "record"), folder)
    lines = L.log_lines(spark, folder)
    lineage, n = logs.chunk_name(F.col("file"))
    rows = lines.select(lineage.alias("lineage"), F.struct(n.alias("n"), "pos").alias("at"), "line", F.get_json_object("line", "$.prev").alias("prev"))
    breaks = logs.chain_breaks(rows, "at", "line", "prev", ["lineage"]).groupBy("lineage").agg(F.count(F.lit(1)).alias("breaks"))
    out = rows.groupBy("lineage").agg(F.count(F.lit(1)).alias("records"), F.sha2(F.max_by("line", "at"), 256).alias("head"))
    return out.join(breaks, "lineage", "left").select("lineage", "records", "head", F.coalesce("breaks", F.lit(0)).cast("long").alias("breaks"))


@query("w12_checked_requests", sql="""WITH w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS intent, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations),
s AS (SELECT *, list_filter(string_split_regex(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(trim(coalesce(intent, '')), '\\s+'), lambda x: x <> '') AS b FROM w)
SELECT conv_id, turn, len(a) < 3 OR len(b) < 3 AS too_short FROM s""")
def w12_checked(spark, sf):
    """Turns as commits whose intent is the turn before: those whose words are too few."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("commit").alias("type"), F.col("text").alias("behavior"), F.lag("text").over(w).alias("intent"), F.lag("text", 2).over(w).alias("previous"))
    made = L.as_records(rows.select("type", "behavior", "intent", "previous", F.concat_ws("/", "conv_id", "turn").alias("lineage"), F.struct("conv_id", "turn").alias("pos")))
    return made.select("pos.conv_id", "pos.turn", F.array_contains("problems", "message_too_short").alias("too_short"))


def _letters(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count("a"), t.count("e")] for t in texts], dtype=np.float64)


@query("z4_embedded_in_runs", sql="SELECT doc_id::VARCHAR AS id, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS v1, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS v2 FROM documents WHERE text IS NOT NULL")
def z4_runs(spark, sf):
    """Texts embedded in three runs, two of which may do a quarter each; the rest waits in the state of the stream."""
    grants, target, checkpoint = (_place(spark, x) for x in ("grants", "vectors", "embedding-checkpoint"))
    docs = table(spark, sf, "documents")
    n, shards = docs.where("text is not null").count(), 4 * spark.sparkContext.defaultParallelism
    # as a pattern, since a stream takes no single file
    requests = lambda: spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parque[t]").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.lit("1").alias("digest"), "text")
    for budget in (n // 4, n // 4, n * shards):
        E.grant(spark, grants, shards, budget)
        E.run(requests(), grants, _letters, target, checkpoint, shards)
    return E.vectors(spark, target).select("id", *[F.get("vector", F.lit(k)).alias(f"v{k}") for k in range(3)])
