"""Registered queries of logs and history, over events and conversations as logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import history as H
from lodestone.plans.registry import query, table
from lodestone.sources import logs as L

KIND = "CASE event_type WHEN 'signup' THEN 'document' WHEN 'view' THEN 'touch' WHEN 'error' THEN 'forget' WHEN 'click' THEN 'link' ELSE 'unlink' END"
SEC = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
LOG = f"lg AS (SELECT event_id AS pos, user_id AS id, {KIND} AS type, {SEC} AS seen, value, ts FROM events)"


def event_log(spark, sf):
    """Events as records of a document log: pos, id, type, seen."""
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("id"), F.expr(KIND).alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("seen"), "value", "ts")


FOLD = """fd AS (SELECT id, max(pos) FILTER (type = 'document') AS document_pos, max(pos) FILTER (type = 'forget') AS gone,
  arg_max(seen, pos) FILTER (type IN ('document', 'touch')) AS fetched_at, arg_max(value, pos) FILTER (type = 'document') AS value FROM lg WHERE type IN ('document', 'touch', 'forget') GROUP BY id),
docs AS (SELECT id, document_pos, fetched_at, value FROM fd WHERE document_pos IS NOT NULL AND (gone IS NULL OR gone < document_pos))"""


@query("s1_document_log_fold", sql=f"WITH {LOG}, {FOLD} SELECT id, document_pos, fetched_at, value FROM docs")
def s1(spark, sf):
    return L.fold_documents(event_log(spark, sf), fetched="seen", values=("value",))


@query("s2_source_log_fold", sql=f"WITH {LOG}, k AS (SELECT id, arg_max(type, pos) AS t, max(pos) AS pos FROM lg WHERE type IN ('document', 'forget') GROUP BY id) SELECT id, pos FROM k WHERE t = 'document'")
def s2(spark, sf):
    return L.fold_set(event_log(spark, sf), ["id"], "pos", "type", "document", "forget")


@query("s3_framing", sql="SELECT doc_id, len(list_filter(l[:-2], lambda x: x <> ''))::INT AS whole_lines, l[-1] <> '' AS torn FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def s3(spark, sf):
    lines = F.split("text", "\n")
    whole = F.filter(F.slice(lines, 1, F.size(lines) - 1), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", F.size(whole).alias("whole_lines"), (F.element_at(lines, -1) != "").alias("torn"))


@query("s4_history_order", sql="SELECT user_id AS lineage, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS nth, event_id FROM events")
def s4(spark, sf):
    """Chunks of a lineage (its days) as one stream: chunk order, then place in the chunk."""
    w = Window.partitionBy("user_id").orderBy(F.to_date("ts"), "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("lineage"), F.row_number().over(w).cast("long").alias("nth"), "event_id")


CHAIN = "ch AS (SELECT *, user_id || '|' || event_type || '|' || value::INT AS line FROM events), cp AS (SELECT *, CASE WHEN event_type = 'error' AND value > 50 THEN 'broken' ELSE lag(sha256(line), 1, repeat('0', 64)) OVER (PARTITION BY user_id ORDER BY event_id) END AS prev FROM ch)"


def chained(spark, sf):
    e = table(spark, sf, "events").withColumn("line", F.concat_ws("|", "user_id", "event_type", F.round("value").cast("int")))
    before = F.lag(F.sha2("line", 256), 1, "0" * 64).over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("prev", F.when((F.col("event_type") == "error") & (F.col("value") > 50), "broken").otherwise(before))


@query("o6_chain_breaks", sql="SELECT user_id, count(*) AS breaks, min(event_id) AS first FROM events WHERE event_type = 'error' AND value > 50 GROUP BY user_id")
def o6(spark, sf):
    return L.chain_breaks(chained(spark, sf), "event_id", "line", "prev", ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("breaks"), F.min("event_id").alias("first"))


@query("s5_decoded_records", sql="SELECT event_id, (props->>'$.k')::INT AS k, event_type FROM events")
def s5(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), "event_type")


@query("o1_latest_per_key", sql="SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def o1(spark, sf):
    return L.latest(table(spark, sf, "events"), "user_id", "event_id", "event_type", "value")


@query("e6_tracked_set", sql="SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def e6(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("op")).where("op <> 'error'").select("user_id")


@query("h22_fetch_history", sql=f"WITH {LOG} SELECT id, pos, seen, type = 'document' AS changed FROM lg WHERE type IN ('document', 'touch')")
def h22(spark, sf):
    return event_log(spark, sf).where(F.col("type").isin("document", "touch")).select("id", "pos", "seen", (F.col("type") == "document").alias("changed"))


@query("o5_previous_of_file", sql="SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, event_id = max(event_id) OVER (PARTITION BY user_id) AS head FROM events")
def o5(spark, sf):
    w = Window.partitionBy("user_id")
    return table(spark, sf, "events").select("event_id", F.lag("event_id").over(w.orderBy("event_id")).alias("prev"), (F.col("event_id") == F.max("event_id").over(w)).alias("head"))


@query("o8_islands", sql="WITH f AS (SELECT *, coalesce((event_type IS DISTINCT FROM lag(event_type) OVER w)::INT, 1) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f) SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island")
def o8(spark, sf):
    return H.islands(table(spark, sf, "events"), ["event_type"], ["user_id"], "event_id").groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


TIMELINE = "g AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER w) > 3600, false) AS gap, coalesce(event_type <> lag(event_type) OVER w, false) AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), t AS (SELECT *, sum((gap OR moved)::INT) OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS node FROM g)"


@query("o9_timeline", sql=f"WITH {TIMELINE} SELECT user_id, count(DISTINCT node) AS nodes, sum(gap::INT)::BIGINT AS gaps, sum((moved)::INT)::BIGINT AS moves FROM t GROUP BY user_id")
def o9(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = H.gaps(table(spark, sf, "events"), ["user_id"], "ts", 3600, "event_id").withColumn("moved", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(False)))
    rows = rows.withColumn("node", F.sum((F.col("gap") | F.col("moved")).cast("int")).over(w) + 1)
    return rows.groupBy("user_id").agg(F.count_distinct("node").alias("nodes"), F.sum(F.col("gap").cast("long")).alias("gaps"), F.sum(F.col("moved").cast("long")).alias("moves"))


@query("o10_headings_once", sql="SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN role END AS heading FROM conversations")
def o10(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(~F.col("role").eqNullSafe(F.lag("role").over(w)), F.col("role")).alias("heading"))


@query("o14_running_session", sql="SELECT event_id, (last_value(CASE event_type WHEN 'signup' THEN {'v': event_id::VARCHAR} WHEN 'purchase' THEN {'v': NULL::VARCHAR} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)).v AS active FROM events")
def o14(spark, sf):
    return H.running_state(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", F.col("event_id").cast("string")).select("event_id", "active")


@query("o15_previous_behavior", sql="SELECT conv_id, turn, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def o15(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag(F.md5("text")).over(w).alias("previous"))


@query("h23_missing_chunks", sql="WITH n AS (SELECT DISTINCT user_id AS lineage, (day(ts))::INT AS n FROM events), g AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY lineage ORDER BY n) AS b FROM n) SELECT lineage, n FROM g WHERE n <> b + 1")
def h23(spark, sf):
    return L.missing_chunks(table(spark, sf, "events").select(F.col("user_id").alias("lineage"), F.dayofmonth("ts").alias("n")).distinct())


# region edits from events: a file for each user
def commits(spark, sf):
    k = F.from_json("props", "k int")["k"]
    op = F.expr("CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'edit' END")
    n = F.when(op == "delete", F.array().cast("array<string>")).otherwise(F.slice(F.array(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), k.cast("string"), F.lit("end")), F.lit(1), k % 3 + 1))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("file"), op.alias("op"), (k % 4 + 1).alias("old_start"), (k % 2).alias("old_lines"), (k % 4 + 1).alias("new_start"), F.size(n).alias("new_lines"), n.alias("new_text"), "ts"
    )


EDITS = """ev AS (SELECT *, (props->>'$.k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
ed AS (SELECT event_id AS pos, user_id AS file, i, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'edit' END AS op, k % 4 AS head, k % 2 AS cut, CASE WHEN event_type = 'error' THEN []::VARCHAR[] ELSE [event_type || ':' || event_id, k::VARCHAR, 'end'][1:k % 3 + 1] END AS txt FROM ev),
rp AS (SELECT file, 0::BIGINT AS i, []::VARCHAR[] AS lines, '' AS op, 0::BIGINT AS pos FROM ed WHERE i = 1
  UNION ALL SELECT r.file, e.i, CASE WHEN e.op = 'delete' THEN []::VARCHAR[] ELSE list_concat(list_concat(r.lines[1:e.head], e.txt), r.lines[e.head + e.cut + 1:]) END, e.op, e.pos FROM rp r JOIN ed e ON e.file = r.file AND e.i = r.i + 1)"""


@query("h2_replay", sql=f"WITH RECURSIVE {EDITS} SELECT file, len(lines)::INT AS n, array_to_string(lines, chr(10)) AS text, op <> 'delete' AS existing FROM rp QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1")
def h2(spark, sf):
    return H.replay(commits(spark, sf)).select("file", F.size("lines").alias("n"), F.concat_ws("\n", "lines").alias("text"), "existing")


@query("h1_apply_steps", sql=f"WITH RECURSIVE {EDITS} SELECT file, sum(len(lines))::BIGINT AS total, max(len(lines))::INT AS most FROM rp WHERE i > 0 GROUP BY file")
def h1(spark, sf):
    sizes = lambda s, e: F.struct(H.applied(s["lines"], e).alias("lines"), F.concat(s["n"], F.array(F.size(H.applied(s["lines"], e)))).alias("n"))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.array().cast("array<int>").alias("n"))
    n = F.aggregate("edits", start, sizes)["n"]
    return H.ordered_edits(commits(spark, sf)).select("file", F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(n).alias("most"))


@query("h4_blame", sql=f"""WITH RECURSIVE {EDITS}, tp AS (SELECT file, max(i) AS i FROM ed GROUP BY file), fin AS (SELECT r.file, r.i, len(r.lines) AS n FROM rp r JOIN tp USING (file, i)),
w AS (SELECT file, unnest(range(1, n + 1))::INT AS line, NULL::BIGINT AS hit, i, false AS over, 0 AS orig FROM fin),
w0 AS (SELECT file, line AS asked, line, hit, i, over FROM w),
bl AS (SELECT * FROM w0 UNION ALL SELECT b.file, b.asked,
  CASE WHEN b.line >= e.head + 1 + len(e.txt) THEN b.line - len(e.txt) + e.cut ELSE b.line END,
  CASE WHEN e.op <> 'delete' AND b.line >= e.head + 1 AND b.line < e.head + 1 + len(e.txt) THEN e.pos END,
  b.i - 1, e.op IN ('delete', 'create') OR (b.line >= e.head + 1 AND b.line < e.head + 1 + len(e.txt))
  FROM bl b JOIN ed e ON e.file = b.file AND e.i = b.i WHERE NOT b.over)
SELECT file, asked AS line, max(hit) AS pos FROM bl GROUP BY file, asked""")
def h4(spark, sf):
    edits = commits(spark, sf)
    lines = H.replay(edits).where("size(lines) > 0").select("file", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("line"))
    return H.blame(edits, lines)


@query("a11_review_totals", sql="WITH s AS (SELECT user_id, arg_max(event_id, event_id) FILTER (event_type = 'signup') AS first FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS commits, count(DISTINCT e.event_type) AS kinds, strftime(min(ts), '%Y-%m-%d %H:%M') AS from_ts, strftime(max(ts), '%Y-%m-%d %H:%M') AS to_ts FROM events e JOIN s ON s.user_id = e.user_id AND e.event_id >= s.first GROUP BY e.user_id")
def a11(spark, sf):
    """From each user's last session start on."""
    e = table(spark, sf, "events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("first"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return e.join(first, "user_id").where("event_id >= first").groupBy("user_id").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("event_type").alias("kinds"), at(F.min("ts")).alias("from_ts"), at(F.max("ts")).alias("to_ts"))


@query("n13_sessions", sql="WITH s AS (SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events WHERE event_type = 'signup') SELECT s.event_id, s.user_id, count(e.event_id) AS commits, min(e.event_id) FILTER (e.event_type = 'purchase') AS ended FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_id > s.event_id AND (s.nxt IS NULL OR e.event_id < s.nxt) GROUP BY ALL")
def n13(spark, sf):
    """Each start with its end and what lies between: the running session numbers the rows, so no range join is needed."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("start", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)).where("start is not null")
    return rows.groupBy(F.col("start").alias("event_id"), "user_id").agg(F.count_if(F.col("event_id") > F.col("start")).alias("commits"), F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("ended"))


@query("n12_commit_sessions", sql="SELECT coalesce(s.event_id::VARCHAR, 'no session') AS session, count(*) AS commits FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_type = 'signup') s ON s.event_id = e.event_id - (e.event_id % 5) GROUP BY 1")
def n12(spark, sf):
    e = table(spark, sf, "events")
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("sid"))
    return e.join(s, F.col("sid") == F.col("event_id") - F.col("event_id") % 5, "left").groupBy(F.coalesce(F.col("sid").cast("string"), F.lit("no session")).alias("session")).agg(F.count(F.lit(1)).alias("commits"))


@query("n11_amendments", sql="WITH a AS (SELECT user_id, event_id, event_type || event_id AS t FROM events WHERE event_type = 'click') SELECT c.event_id, list_aggregate(list_sort(list(a.event_id)), 'string_agg', ',') AS earlier, arg_max(a.t, a.event_id) AS latest FROM events c JOIN a ON a.user_id = c.user_id AND a.event_id > c.event_id WHERE c.event_type = 'signup' GROUP BY c.event_id")
def n11(spark, sf):
    """Amendments after each commit: one list a user, of which every commit takes the end; the list is the result's own size."""
    e = table(spark, sf, "events").where("event_type in ('click', 'signup')")
    click = F.col("event_type") == "click"
    later = Window.partitionBy("user_id").orderBy(F.col("event_id").desc()).rangeBetween(Window.unboundedPreceding, -1)
    n, last = F.count(F.when(click, 1)).over(later), F.max(F.when(click, F.col("event_id"))).over(later)
    commits_ = e.select("user_id", "event_id", "event_type", n.cast("int").alias("n"), last.alias("last")).where("event_type = 'signup' and n > 0")
    lists = e.where(click).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("all"))
    ends = commits_.join(lists, "user_id").select("event_id", "last", F.slice("all", F.size("all") - F.col("n") + 1, F.col("n")).alias("ids"))
    return ends.select("event_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("earlier"), F.concat(F.lit("click"), F.col("last").cast("string")).alias("latest"))


@query("f13_history_filter", sql="SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type IN ('click', 'view') AND (event_id::VARCHAR = '9001' OR contains(props, '1'))")
def f13(spark, sf):
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    kept = e.crossJoin(F.broadcast(newest)).where((F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAYS")) & F.col("event_type").isin("click", "view"))
    return kept.where((F.col("event_id").cast("string") == "9001") | F.contains("props", F.lit("1"))).select("event_id", "user_id", "event_type")


@query("f14_text_search_in_lines", sql="SELECT conv_id, turn, list_position(list_transform(l, lambda x: contains(x, 'en ')), true)::INT AS first_line FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations) WHERE contains(text, 'en ') AND role <> 'system'")
def f14(spark, sf):
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("en "))), True)
    return table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", at.cast("int").alias("first_line")).where("first_line > 0")


@query("f15_range_start", sql="SELECT 'recent' AS name, strftime(date_trunc('day', max(ts)), '%Y-%m-%d') AS start FROM events UNION ALL SELECT '3d', strftime(date_trunc('day', max(ts)) - INTERVAL 2 DAY, '%Y-%m-%d') FROM events UNION ALL SELECT '30d', strftime(date_trunc('day', max(ts)) - INTERVAL 29 DAY, '%Y-%m-%d') FROM events")
def f15(spark, sf):
    day = F.date_trunc("day", F.max("ts"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.date_format(day - F.expr(f"INTERVAL {d} DAYS"), "yyyy-MM-dd").alias("start")) for n, d in (("recent", 0), ("3d", 2), ("30d", 29))])
    return table(spark, sf, "events").agg(rows.alias("r")).select(F.inline("r"))


@query("f19_commit_references", sql="WITH h AS (SELECT event_id, sha256(event_id::VARCHAR) AS hash FROM events), r AS (SELECT event_id AS of, substr(hash, 1, 7) AS ref FROM h) SELECT r.of, CASE WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS state, min(h.event_id) AS first FROM r JOIN h ON substr(h.hash, 1, 7) = r.ref GROUP BY r.of")
def f19(spark, sf):
    h = table(spark, sf, "events").select("event_id", F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 7).alias("ref"))
    found = h.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return h.withColumnRenamed("event_id", "of").join(found, "ref").select("of", F.when(F.col("n") == 1, "found").otherwise("ambiguous").alias("state"), "first")


@query("q10_newest_first", sql="SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def q10(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(25)


@query("q5_page", sql="SELECT event_id, 3 AS page, ceil((SELECT count(*) FROM events) / 50)::INT AS pages, (SELECT count(*) FROM events)::INT AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def q5(spark, sf):
    return H.page_of(table(spark, sf, "events").select("event_id", "ts"), 50, 3, F.desc("ts"), F.desc("event_id")).select("event_id", "page", "pages", "total")


@query("h25_commit_point", sql="SELECT user_id, event_id, row_number() OVER (ORDER BY event_id) AS dense FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id)")
def h25(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    from lodestone.operators.store import running_base

    placed = running_base(e.withColumn("one", F.lit(1)), "one", ["event_id"])
    return placed.groupBy("user_id").agg(F.max("event_id").alias("event_id"), (F.max_by("base", "event_id") + 1).cast("long").alias("dense"))


@query("t14_message_checks", sql=r"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
s AS (SELECT *, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS a, list_distinct(regexp_extract_all(translate(prev, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS b FROM c)
SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) < 3 AS short, coalesce(len(list_intersect(a, b)) >= 0.8 * (len(a) + len(b) - len(list_intersect(a, b))) AND len(a) + len(b) > 0, false) AS repeats FROM s""")
def t14(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(w))
    codes = H.message_checks(F.col("text"), F.col("text"), F.col("prev"), F.lit(None).cast("string"), F.lit(False), F.lit(False))
    return c.select("conv_id", "turn", F.array_contains(codes, "message_too_short").alias("short"), F.array_contains(codes, "behavior_repeats_previous").alias("repeats"))


@query("e4_word_set_similarity", sql=r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS s FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def e4(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.word_set("text").alias("s"))
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("b")), ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("s"), F.col("b")), 6).alias("similarity"))


@query("h24_recovery_point", sql="WITH t AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS last_merge FROM events GROUP BY user_id) SELECT e.user_id, min(e.event_id) AS redo_from, bool_and(e.event_type <> 'signup') AS own_only FROM events e JOIN t ON t.user_id = e.user_id AND e.event_id > coalesce(t.last_merge, -1) GROUP BY e.user_id")
def h24(spark, sf):
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(-1)).alias("last"))
    return e.join(last, "user_id").where("event_id > last").groupBy("user_id").agg(F.min("event_id").alias("redo_from"), F.bool_and(F.col("event_type") != "signup").alias("own_only"))
