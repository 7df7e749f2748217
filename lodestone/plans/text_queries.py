"""Registered queries of the vectorised text algorithms, the hybrid search plan and streaming."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.chunks import OVERLAP, TARGET, chunks
from lodestone.functions.lines import diff_regions
from lodestone.operators.common import shared_folder
from lodestone.operators.layout import layout
from lodestone.plans.registry import query, table
from lodestone.plans.search import hybrid_search
from lodestone.streaming import tail


@query("t8_text_chunks", sql=f"SELECT doc_id, ceil(greatest(strlen(text) - {OVERLAP}, 1) / ({TARGET} - {OVERLAP})::DOUBLE) <= count_upper AS enough, strlen(text) AS last_end FROM (SELECT *, 1000000 AS count_upper FROM documents) WHERE strlen(text) > 0")
def t8(spark, sf):
    c = chunks(table(spark, sf, "documents"), "doc_id", "text", "text")
    whole = c.groupBy("doc_id").agg(F.max("end").alias("last_end"), F.min("start").alias("first"), F.max(F.col("end") - F.col("start")).alias("longest"))
    return whole.select("doc_id", ((F.col("first") == 0) & (F.col("longest") <= TARGET)).alias("enough"), "last_end")


WORDS = "SELECT p_partkey, 0 AS ordinal, 0 AS start, 7 * 40 * p_size AS size FROM part WHERE p_size > 0"


@query("t8_snapped_windows", sql=f"WITH RECURSIVE c AS ({WORDS} UNION ALL SELECT p_partkey, ordinal + 1, (start + {TARGET}) // 7 * 7 - {OVERLAP}, size FROM c WHERE size - start > {TARGET}) SELECT p_partkey, ordinal, start, CASE WHEN size - start > {TARGET} THEN (start + {TARGET}) // 7 * 7 ELSE size END AS \"end\" FROM c")
def t8s(spark, sf):
    """Windows over words of six letters end behind a space."""
    text = F.repeat(F.lit("abcdef "), F.col("p_size").cast("int") * 40)
    docs = table(spark, sf, "part").where("p_size > 0").select("p_partkey", text.alias("text"))
    return chunks(docs, "p_partkey", "text", "text").select("p_partkey", "ordinal", "start", "end")


@query("t4_html_chunks")
def t4c(spark, sf):
    return chunks(table(spark, sf, "pages"), "page_id", "html", "html").orderBy("page_id", "ordinal")


@query("h6_line_diff")
def h6(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("old", F.lag("text").over(w))
    return c.select("conv_id", "turn", diff_regions("old", "text").alias("regions"))


@query("h6_diff_of_copies", sql="SELECT doc_id, 0 AS regions FROM documents")
def h6b(spark, sf):
    """A text against itself has no region."""
    return table(spark, sf, "documents").select("doc_id", F.size(diff_regions("text", "text")).alias("regions"))


@query("g8_hybrid_search")
def g8(spark, sf):
    """Keyword and vector lists, score fusion, snippets of the ten best for every benchmark item."""
    docs = table(spark, sf, "documents")
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    q = b.join(e, F.col("doc_id") == F.col("query"), "left").select("query", "text", F.col("embedding").alias("qv"))
    return hybrid_search(docs, "doc_id", "text", e, "embedding", q)


@query("r2_force_layout")
def r2(spark, sf):
    l = table(spark, sf, "lineitem")
    # the graph of each supplier: its parts around it
    return layout(l.select(F.col("l_suppkey").alias("graph"), (F.col("l_partkey") + 1_000_000).alias("from"), F.col("l_suppkey").alias("to")).distinct(), "graph", steps=20)


@query("z1_tail_fold", sql="SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def z1(spark, sf):
    """Events as log files, tailed to the last record of each user."""
    work = os.path.join(shared_folder(spark), f"tail-{uuid.uuid4().hex}")
    table(spark, sf, "events").select("event_id", "user_id", "event_type").repartitionByRange(4, "event_id").write.json(f"{work}/log")
    records = tail.stream_records(spark, f"{work}/log", "event_id long, user_id long, event_type string", files_a_batch=2)
    tail.tail_to_state(records, f"{work}/state", f"{work}/offsets", "user_id", "event_id").awaitTermination()
    return tail.current_state(spark, f"{work}/state").select("user_id", "event_id", "event_type")


@query("z6_sessions", sql="WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR, true) AS new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def z6(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tail.sessions(e, "user_id", "ts", "1 hour").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("x8_path_join", sql="SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'b/x' WHEN page_id % 3 = 1 THEN 'a/b/y' END AS path FROM pages")
def x8(spark, sf):
    rel = F.when(F.col("page_id") % 3 == 0, "../../b/./x").when(F.col("page_id") % 3 == 1, "y").otherwise("../../../z")
    return table(spark, sf, "pages").select("page_id", X.join_path(F.lit("a/b"), rel).alias("path"))


@query("x13_slugs", sql=r"SELECT s_suppkey, regexp_replace(trim(regexp_replace(lower(s_name), '[^\p{L}\p{N}\s_-]', '', 'g')), '\s', '-', 'g') AS slug FROM supplier")
def x13(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", X.slug("s_name").alias("slug"))


@query("j7_byte_labels", sql="SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE printf('%.1f', round(strlen(text) / 1024.0, 1)) || ' KB' END AS size FROM documents")
def j7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.format_bytes(F.octet_length("text")).alias("size"))


@query("j9_marked_terms", sql="SELECT doc_id, md5(regexp_replace(text, '(?i)(der|the)', '[\\1]', 'g')) AS marked FROM documents")
def j9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.marked("text", F.array(F.lit("der"), F.lit("the")))).alias("marked"))


@query("x19_board_snippet", sql=r"WITH p AS (SELECT doc_id, text, strpos(lower(text), 'licensed') AS at0 FROM documents) SELECT doc_id, CASE WHEN at0 > 61 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(at0 - 60, 1), at0 + 100 - greatest(at0 - 60, 1)), '\s+', ' ', 'g')) || CASE WHEN at0 + 100 <= length(text) THEN '…' ELSE '' END AS snippet FROM p WHERE at0 > 0")
def x19(spark, sf):
    from lodestone.operators.board import snippet

    return table(spark, sf, "documents").select("doc_id", snippet(F.col("text"), "licensed").alias("snippet")).where("snippet is not null")


@query("x2_folded_contains", sql="SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licensed under')")
def x2(spark, sf):
    return table(spark, sf, "documents").where(X.contains_folded("text", F.lit("LICENSED under"))).select("doc_id")


@query("x5_timestamps", sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events")
def x5(spark, sf):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, sf, "events").select("event_id", iso.alias("iso"), F.unix_timestamp(F.try_to_timestamp(iso)).alias("epoch"))


@query("x6_content_hash", sql="SELECT doc_id, sha256(text) AS hash FROM documents")
def x6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("x14_line_of_offset", sql="SELECT doc_id, (length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), chr(10), '')) + 1)::INT AS line FROM documents")
def x14(spark, sf):
    """The line on which the five hundredth character stands."""
    return table(spark, sf, "documents").select("doc_id", (F.regexp_count(F.substring("text", 1, 500), F.lit("\n")) + 1).alias("line"))


@query("x15_json_equality", sql="SELECT event_id, (props->>'$.k')::INT = 7 AS same FROM events")
def x15(spark, sf):
    same = F.to_json(F.parse_json("props")) == F.to_json(F.parse_json(F.lit('{ "k" : 7 }')))
    return table(spark, sf, "events").select("event_id", same.alias("same"))


@query("h30_line_endings", sql="SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, suffix(text, chr(10)) AS ended FROM documents")
def h30(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.endswith("text", F.lit("\n")).alias("ended"))
