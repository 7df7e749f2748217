"""Registered queries of the board, pages and trees: nations are epics, customers milestones, orders tickets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.config import PRIORITIES, STATUSES
from lodestone.functions import text as X
from lodestone.operators import board as B
from lodestone.plans.registry import query, table
from lodestone.sources import logs as L

TICKETS = """ticket AS (SELECT 'T-' || o_orderkey AS id, o_orderkey AS n, 'M-' || c_custkey AS milestone, 'E-' || c_nationkey AS epic,
  ['backlog', 'todo', 'doing', 'review', 'done'][(o_orderkey % 5 + 1)::INT] AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
  'user' || o_custkey % 9 AS assignee, c_mktsegment AS label, o_orderpriority || ' ' || c_name AS title, o_orderkey % 23 = 0 AS archived FROM orders JOIN customer ON o_custkey = c_custkey)"""


def tickets(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        X.make_id("T", n).alias("id"), n.alias("n"), X.make_id("M", F.col("c_custkey")).alias("milestone"), X.make_id("E", F.col("c_nationkey")).alias("epic"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (n % 5 + 1).cast("int")).alias("status"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END").alias("priority"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 9).cast("string")).alias("assignee"), F.col("c_mktsegment").alias("label"), F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"), (n % 23 == 0).alias("archived"),
    )


PIVOT = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)


@query("a5_count_by_status", sql=f"WITH {TICKETS} SELECT milestone, {PIVOT} FROM ticket GROUP BY milestone")
def a5(spark, sf):
    return B.count_by_status(tickets(spark, sf), ["milestone"])


@query("a6_epic_progress", sql=f"WITH {TICKETS} SELECT epic, count(*) AS tickets, count(*) FILTER (status = 'done') AS done, count(DISTINCT milestone) AS milestones, count(*) FILTER (archived) AS archived FROM ticket GROUP BY epic")
def a6(spark, sf):
    return tickets(spark, sf).groupBy("epic").agg(F.count(F.lit(1)).alias("tickets"), F.count_if(F.col("status") == "done").alias("done"), F.count_distinct("milestone").alias("milestones"), F.count_if("archived").alias("archived"))


FACET = {"status": ["todo", "doing"], "priority": ["high", "urgent"], "label": []}


@query("a7_facet_counts", sql=f"WITH {TICKETS} SELECT 'status' AS field, status AS value, count(*) AS n FROM ticket WHERE priority IN ('high', 'urgent') GROUP BY status UNION ALL SELECT 'priority', priority, count(*) FROM ticket WHERE status IN ('todo', 'doing') GROUP BY priority UNION ALL SELECT 'label', label, count(*) FROM ticket WHERE status IN ('todo', 'doing') AND priority IN ('high', 'urgent') GROUP BY label")
def a7(spark, sf):
    return B.facet_counts(tickets(spark, sf), FACET)


@query("a8_facet_options", sql=f"WITH {TICKETS} SELECT list_aggregate(list_sort(list(DISTINCT assignee)), 'string_agg', ',') AS assignees, list_aggregate(list_sort(list(DISTINCT label)), 'string_agg', ',') AS labels FROM ticket")
def a8(spark, sf):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return tickets(spark, sf).agg(joined("assignee").alias("assignees"), joined("label").alias("labels"))


@query("a9_keyword_counts", sql="SELECT keyword, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS keyword FROM part) GROUP BY keyword")
def a9(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("a10_session_list", sql="SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last, arg_max(role, turn) = 'user' AS active FROM conversations GROUP BY conv_id")
def a10(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last"), (F.max_by("role", "turn") == "user").alias("active"))


@query("a12_branch_state", sql="WITH b AS (SELECT l_suppkey, count(*) AS since_base, count(*) FILTER (l_returnflag = 'A') AS merged, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY l_suppkey) SELECT *, CASE WHEN merged = since_base THEN 'merged' WHEN merged > 0 THEN 'partly merged' ELSE 'active' END AS state FROM b")
def a12(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("since_base"), F.count_if(F.col("l_returnflag") == "A").alias("merged"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    return b.withColumn("state", F.when(F.col("merged") == F.col("since_base"), "merged").when(F.col("merged") > 0, "partly merged").otherwise("active"))


@query("a15_reject_buckets", sql=r"SELECT CASE WHEN regexp_matches(url, '/\.') THEN 'hidden' WHEN regexp_matches(url, '/(node_modules|vendor)/') THEN 'vendored' WHEN contains(url, '?') THEN 'other type' WHEN strlen(html) > 8192 THEN 'large' WHEN strlen(html) = 0 THEN 'empty' ELSE 'taken' END AS bucket, count(*) AS n FROM pages GROUP BY 1")
def a15(spark, sf):
    u, size = F.col("url"), F.octet_length("html")
    bucket = F.when(u.rlike(r"/\."), "hidden").when(u.rlike("/(node_modules|vendor)/"), "vendored").when(F.contains(u, F.lit("?")), "other type").when(size > 8192, "large").when(size == 0, "empty").otherwise("taken")
    return table(spark, sf, "pages").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("a20_first_touch_order", sql="SELECT user_id, list_aggregate(list_transform(list_sort(list({'p': p, 't': event_type})), lambda x: x.t), 'string_agg', ',') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id")
def a20(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    return first.groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"])).alias("kinds"))


@query("f11_board_filter", sql=f"WITH {TICKETS} SELECT id FROM ticket WHERE NOT archived AND status = 'doing' AND epic = 'E-3' AND lower(trim(label)) = 'building'")
def f11(spark, sf):
    return tickets(spark, sf).where(~F.col("archived") & (F.col("status") == "doing") & (F.col("epic") == "E-3") & (F.lower(F.trim("label")) == "building")).select("id")


@query("f12_sidebar_filter", sql=f"WITH {TICKETS} SELECT id FROM ticket WHERE (lower(id) = 't-7' OR contains(lower(id), '77') OR contains(lower(title), '77')) AND priority IN ('high', 'low') AND status <> 'done'")
def f12(spark, sf):
    needle = lambda c: F.contains(F.lower(c), F.lit("77"))
    return tickets(spark, sf).where(((F.lower("id") == "t-7") | needle("id") | needle("title")) & F.col("priority").isin("high", "low") & (F.col("status") != "done")).select("id")


@query("f16_page_filter", sql="SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'small']) AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'eco')")
def f16(spark, sf):
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    words = F.forall(F.array(F.lit("brand#1"), F.lit("eco")), lambda w: F.contains(text, w))
    return table(spark, sf, "part").where(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("small"))) & words).select("p_partkey")


@query("f17_metadata_equality", sql="SELECT event_id FROM events WHERE (props->>'$.k')::INT = 42 AND event_type = 'click'")
def f17(spark, sf):
    return table(spark, sf, "events").where((F.from_json("props", "map<string,int>")["k"] == 42) & (F.col("event_type") == "click")).select("event_id")


@query("f20_references_in_prose", sql=r"SELECT doc_id, len(regexp_extract_all(text, '[A-Z]{2,}[0-9A-Z]*'))::INT AS refs FROM documents WHERE regexp_matches(text, '[A-Z]{2,}[0-9A-Z]*')")
def f20(spark, sf):
    refs = F.regexp_extract_all("text", F.lit(r"[A-Z]{2,}[0-9A-Z]*"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.size(refs).alias("refs")).where("refs > 0")


@query("f9_hidden_or_vendored", sql=r"SELECT page_id FROM pages WHERE len(list_filter(string_split(url, '/'), lambda s: s IN ('vendor', 'node_modules', 'fr', '742') OR s LIKE '.%')) > 0")
def f9(spark, sf):
    return table(spark, sf, "pages").where(F.exists(F.split("url", "/"), lambda s: s.isin("vendor", "node_modules", "fr", "742") | s.startswith("."))).select("page_id")


RULES = [(1, r"^https?://www\.", True), (2, r"/en/", True), (3, r"\?", False), (4, r"#top$", True)]


@query("f10_ignore_rules", sql="WITH r(no, p, ignored) AS (VALUES " + ", ".join(f"({n}, '{p}', {str(i).lower()})" for n, p, i in RULES) + "), m AS (SELECT page_id, arg_max(ignored, no) AS ignored FROM pages JOIN r ON regexp_matches(url, p) GROUP BY page_id) SELECT page_id FROM m WHERE ignored")
def f10(spark, sf):
    """The last rule that matches decides; rules become one expression, not a join."""
    verdict = F.lit(False)
    for _, pattern, ignored in RULES:
        verdict = F.when(F.col("url").rlike(pattern), F.lit(ignored)).otherwise(verdict)
    return table(spark, sf, "pages").where(verdict).select("page_id")


@query("n16_inherited_archive", sql=f"WITH {TICKETS}, i AS (SELECT id, milestone, epic, archived FROM ticket UNION ALL SELECT 'M-' || c_custkey, NULL, 'E-' || c_nationkey, c_custkey % 31 = 0 FROM customer UNION ALL SELECT 'E-' || n_nationkey, NULL, NULL, n_nationkey % 6 = 0 FROM nation) SELECT coalesce(CASE WHEN i.archived THEN 'own' END, CASE WHEN m.id IS NOT NULL THEN 'milestone' END, CASE WHEN e.id IS NOT NULL THEN 'epic' END) AS via, count(*) AS n FROM i LEFT JOIN i m ON m.id = i.milestone AND m.archived LEFT JOIN i e ON e.id = i.epic AND e.archived GROUP BY 1")
def n16(spark, sf):
    return B.with_archive(items(spark, sf)).groupBy(F.col("archived_via").alias("via")).agg(F.count(F.lit(1)).alias("n"))


def items(spark, sf):
    none = F.lit(None).cast("string")
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    m = c.select(X.make_id("M", F.col("c_custkey")).alias("id"), none.alias("milestone"), X.make_id("E", F.col("c_nationkey")).alias("epic"), (F.col("c_custkey") % 31 == 0).alias("archived"))
    e = n.select(X.make_id("E", F.col("n_nationkey")).alias("id"), none.alias("milestone"), none.alias("epic"), (F.col("n_nationkey") % 6 == 0).alias("archived"))
    return tickets(spark, sf).select("id", "milestone", "epic", "archived").union(m).union(e)


ITEMS = f"{TICKETS}, i AS (SELECT id, milestone, epic FROM ticket UNION ALL SELECT 'M-' || c_custkey, NULL, 'E-' || c_nationkey FROM customer UNION ALL SELECT 'E-' || n_nationkey, NULL, NULL FROM nation)"


@query("n17_filter_closure", sql=f"WITH {ITEMS}, m AS (SELECT * FROM i WHERE id LIKE '%99') SELECT DISTINCT id FROM (SELECT id FROM m UNION ALL SELECT milestone FROM m UNION ALL SELECT epic FROM m UNION ALL SELECT id FROM i WHERE milestone IN (SELECT id FROM m) OR epic IN (SELECT id FROM m)) WHERE id IS NOT NULL")
def n17(spark, sf):
    i = items(spark, sf)
    return B.closure(i, i.where(F.col("id").like("%99")))


@query("n18_ticket_sessions", sql="SELECT o_orderkey AS ticket, count(l_linenumber) AS commits, count(DISTINCT l_suppkey) AS sessions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def n18(spark, sf):
    """Commits are counted before the join, so the join sees one row a ticket."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("l_suppkey").alias("sessions"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ticket")).join(l, F.col("ticket") == F.col("l_orderkey"), "left").select("ticket", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query("n1_with_parent", sql="SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def n1(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


@query("n10_working_tree", sql="WITH o AS (SELECT l_partkey AS path, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_partkey AS path, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.v <> n.v THEN 'modified' ELSE 'same' END AS state FROM o FULL JOIN n ON o.path = n.path")
def n10(spark, sf):
    l = table(spark, sf, "lineitem")
    of = lambda f, v: l.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_quantity").alias(v))
    both = of("A", "o").join(of("R", "n"), "path", "full_outer")
    return both.select("path", F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified").otherwise("same").alias("state"))


@query("n8_first_candidate", sql="WITH c AS (SELECT s_suppkey AS file, unnest([s_suppkey * 2, s_suppkey + 7, s_nationkey]) AS path, unnest([1, 2, 3]) AS priority FROM supplier) SELECT file, arg_min(path, priority) AS resolved FROM c WHERE path IN (SELECT p_partkey FROM part) AND path <> file GROUP BY file")
def n8(spark, sf):
    tries = F.array(*[F.struct(F.lit(i).alias("priority"), p.cast("long").alias("path")) for i, p in enumerate((F.col("s_suppkey") * 2, F.col("s_suppkey") + 7, F.col("s_nationkey")))])
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.inline(tries)).where("path <> file")
    return c.join(table(spark, sf, "part").select(F.col("p_partkey").alias("path")), "path", "left_semi").groupBy("file").agg(F.min_by("path", "priority").alias("resolved"))


@query("n14_merged_sessions", sql="WITH a AS (SELECT user_id, md5(event_id::VARCHAR) AS h FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, md5((event_id - 3)::VARCHAR) AS came FROM events WHERE event_type = 'purchase') SELECT 'adopted' AS kind, count(*) AS n FROM a WHERE h IN (SELECT came FROM b) UNION ALL SELECT 'own', count(*) FROM a WHERE h NOT IN (SELECT came FROM b) UNION ALL SELECT 'rest', count(*) FROM b WHERE came NOT IN (SELECT h FROM a)")
def n14(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type = 'signup'").select(F.md5(F.col("event_id").cast("string")).alias("h"))
    b = e.where("event_type = 'purchase'").select(F.md5((F.col("event_id") - 3).cast("string")).alias("h"), F.lit(1).alias("came"))
    both = a.withColumn("own", F.lit(1)).join(b, "h", "full_outer")
    kind = F.when(F.col("own").isNull(), "rest").when(F.col("came").isNull(), "own").otherwise("adopted")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


CHAIN = "WITH RECURSIVE l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - 1 END AS came FROM orders), c AS (SELECT id, id AS origin, 0 AS steps FROM l WHERE came IS NULL UNION ALL SELECT l.id, c.origin, c.steps + 1 FROM c JOIN l ON l.came = c.id WHERE c.steps < 32) SELECT id, origin, steps FROM c"


@query("n15_copy_chains", sql=CHAIN)
def n15(spark, sf):
    """Copies of copies back to the origin: hop by hop, at most 32 hops, as long as any moved."""
    o = table(spark, sf, "orders")
    links = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - 1).alias("came"))
    at = links.where("came is null").select("id", F.col("id").alias("origin"), F.lit(0).alias("steps"))
    out = at
    for step in range(1, 33):
        at = links.join(at.select(F.col("id").alias("came"), "origin"), "came").select("id", "origin", F.lit(step).alias("steps"))
        if at.isEmpty():
            break
        out = out.union(at)
    return out


@query("q7_board_search", sql=f"WITH {TICKETS} SELECT id, (CASE WHEN lower(id) = '1-urgent 77' THEN 100 ELSE 0 END + CASE WHEN contains(lower(id), '1-urgent') THEN 8 ELSE 0 END + CASE WHEN contains(lower(title), '1-urgent') THEN 4 ELSE 0 END + CASE WHEN contains(lower(label), '1-urgent') THEN 2 ELSE 0 END + CASE WHEN contains(lower(assignee), '1-urgent') THEN 2 ELSE 0 END + CASE WHEN contains(lower(id), '77') THEN 8 ELSE 0 END + CASE WHEN contains(lower(title), '77') THEN 4 ELSE 0 END + CASE WHEN contains(lower(label), '77') THEN 2 ELSE 0 END + CASE WHEN contains(lower(assignee), '77') THEN 2 ELSE 0 END)::INT AS score FROM ticket WHERE (contains(lower(id), '1-urgent') OR contains(lower(title), '1-urgent') OR contains(lower(label), '1-urgent') OR contains(lower(assignee), '1-urgent')) AND (contains(lower(id), '77') OR contains(lower(title), '77') OR contains(lower(label), '77') OR contains(lower(assignee), '77'))")
def q7(spark, sf):
    """T13 and Q7."""
    t = tickets(spark, sf)
    score = B.search_score("1-URGENT 77", {"id": F.col("id"), "title": F.col("title"), "labels": F.col("label"), "assignee": F.col("assignee")}, F.col("id"))
    return t.select("id", score.alias("score")).where("score is not null")


@query("q8_kanban", sql=f"WITH {TICKETS} SELECT id, list_position(['backlog', 'todo', 'doing', 'review', 'done'], status)::INT AS column_no, (row_number() OVER (PARTITION BY status ORDER BY list_position(['low', 'medium', 'high', 'urgent'], priority) DESC, id))::INT AS place FROM ticket")
def q8(spark, sf):
    return B.kanban(tickets(spark, sf)).select("id", "column_no", "place")


@query("q9_page_order", sql="SELECT p_partkey, (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC))::BIGINT AS place FROM part")
def q9(spark, sf):
    from lodestone.operators.store import running_base

    rows = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.lit(1).alias("one"))
    return running_base(rows, "one", [F.desc("p_retailprice"), F.desc("p_partkey")]).select("p_partkey", (F.col("base") + 1).cast("long").alias("place"))


@query("q11_tree_order", sql="SELECT id, depth FROM (SELECT 'R' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'R' || n_regionkey || '/N' || n_nationkey, 1 FROM nation UNION ALL SELECT 'R' || n_regionkey || '/N' || n_nationkey || '/C' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def q11(spark, sf):
    """Depth-first order under parents: a recursive query whose path is the sort key."""
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    edges = r.select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"))
    edges = edges.union(n.select(F.concat(F.lit("N"), F.col("n_nationkey")), F.concat(F.lit("R"), F.col("n_regionkey")))).union(c.select(F.concat(F.lit("C"), F.col("c_custkey")), F.concat(F.lit("N"), F.col("c_nationkey"))))
    at = edges.where("parent is null").select("id", F.col("id").alias("path"), F.lit(0).alias("depth"))
    out = at
    for d in range(1, 33):
        at = edges.join(at.select(F.col("id").alias("parent"), "path"), "parent").select("id", F.concat_ws("/", "path", "id").alias("path"), F.lit(d).alias("depth"))
        if at.isEmpty():
            break
        out = out.union(at)
    return out.select(F.col("path").alias("id"), "depth").orderBy("id")


@query("e5_normalised_keywords", sql=r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name || ' ' || p_type || ' ' || lower(p_type), ' '), lambda x: lower(trim(x))))), ',') AS keywords FROM part")
def e5(spark, sf):
    words = F.transform(F.split(F.concat_ws(" ", "p_name", "p_type", F.lower("p_type")), " "), lambda x: F.lower(F.trim(x)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(words)), ",").alias("keywords"))


@query("e2_union_of_members", sql="SELECT l_partkey AS key, bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 4 END)::INT AS tags FROM lineitem GROUP BY l_partkey")
def e2(spark, sf):
    tag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(4)
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.bit_or(tag).alias("tags"))


@query("r6_quick_archivable", sql=f"WITH {TICKETS} SELECT milestone FROM ticket WHERE NOT archived GROUP BY milestone HAVING count(*) > 0 AND bool_and(status IN ('done', 'review'))")
def r6(spark, sf):
    return tickets(spark, sf).where("not archived").groupBy("milestone").agg(F.bool_and(F.col("status").isin("done", "review")).alias("all_done")).where("all_done").select("milestone")


@query("j5_summary_rows", sql=f"WITH {TICKETS} SELECT id, title, status, priority || '/' || assignee AS facts FROM ticket WHERE NOT archived")
def j5(spark, sf):
    return tickets(spark, sf).where("not archived").select("id", "title", "status", F.concat_ws("/", "priority", "assignee").alias("facts"))


@query("j10_form_results", sql="SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'skipped') AS answer FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j10(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"), F.lit("skipped")).alias("answer"))


@query("j11_area_of_path", sql="WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages) SELECT page_id, CASE WHEN len(p) > 1 THEN p[1] ELSE '' END AS area FROM p")
def j11(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.area_of(F.regexp_replace("url", "^[a-z]+://", "")).alias("area"))


@query("j14_browse_rows", sql="SELECT doc_id, substr(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')), 1, 80) AS line FROM documents ORDER BY n_chars DESC, doc_id LIMIT 51")
def j14(spark, sf):
    """One row more than shown tells whether there are more."""
    d = table(spark, sf, "documents")
    return d.orderBy(F.desc("n_chars"), "doc_id").limit(51).select("doc_id", F.substring(X.one_line("text"), 1, 80).alias("line"))


@query("w16_json_rows", sql="SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}' AS json FROM supplier")
def w16(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))).alias("json"))


@query("s7_board_fold", sql="WITH p AS (SELECT user_id AS id, event_id AS pos, event_type FROM events), f AS (SELECT id, min(pos) FILTER (event_type = 'signup') AS born, max(pos) FILTER (event_type = 'signup') AS put, max(pos) FILTER (event_type = 'error') AS gone FROM p GROUP BY id), m AS (SELECT p.id, arg_max(event_type, pos) AS last FROM p JOIN f USING (id) WHERE event_type IN ('click', 'purchase') AND pos > born GROUP BY p.id) SELECT 'T-' || f.id AS id, 'title ' || f.put AS title, (SELECT count(*) FROM p WHERE p.id = f.id AND event_type = 'view') AS comments, coalesce(m.last = 'click', false) AS archived FROM f LEFT JOIN m ON m.id = f.id WHERE f.put IS NOT NULL AND (gone IS NULL OR gone < put)")
def s7(spark, sf):
    """Events as a board log: signup puts, view comments, error deletes, click archives, purchase unarchives."""
    e = table(spark, sf, "events")
    id = X.make_id("T", F.col("user_id"))
    item = F.from_json(F.to_json(F.struct(id.alias("id"), F.lit("ticket").alias("kind"), F.concat(F.lit("title "), F.col("event_id")).alias("title"))), L.ITEM)
    op = F.expr("CASE event_type WHEN 'signup' THEN 'put' WHEN 'view' THEN 'comment' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'archive' ELSE 'unarchive' END")
    log = e.select(F.col("event_id").alias("pos"), op.alias("op"), F.when(op == "put", item).alias("item"), id.alias("ticket"), F.lit("a").alias("author"), F.lit("b").alias("body"), id.alias("id"), F.col("ts").cast("string").alias("at"), F.lit("me").alias("by"), F.lit(None).cast("string").alias("reason"))
    return L.fold_board(log).select("id", F.col("item.title").alias("title"), F.coalesce(F.size("comments"), F.lit(0)).cast("long").alias("comments"), F.col("archive").isNotNull().alias("archived"))


@query("h18_branch_view", sql="WITH RECURSIVE b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey - 1 END AS parent FROM supplier), v AS (SELECT id, id AS part, 0 AS depth FROM b UNION ALL SELECT v.id, b.parent, v.depth + 1 FROM v JOIN b ON b.id = v.part WHERE b.parent IS NOT NULL AND v.depth < 32) SELECT id, count(*) AS lineages, min(part) AS root FROM v GROUP BY id")
def h18(spark, sf):
    """A branch sees its parent's chunks and its own, recursively."""
    table(spark, sf, "supplier").createOrReplaceTempView("_suppliers")
    return spark.sql("""WITH RECURSIVE b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey - 1 END AS parent FROM _suppliers),
      v(id, part, depth) AS (SELECT id, id, 0 FROM b UNION ALL SELECT v.id, b.parent, v.depth + 1 FROM v JOIN b ON b.id = v.part WHERE b.parent IS NOT NULL AND v.depth < 32)
      SELECT id, count(*) AS lineages, min(part) AS root FROM v GROUP BY id""")
