"""Registered queries of the remaining rows: reviews, sessions, branches, shaped rows, writers' plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.code import metadata_kind
from lodestone.operators import history as H
from lodestone.plans.log_queries import EDITS, commits
from lodestone.plans.registry import query, table
from lodestone.plans.store_queries import DOCS_SQL, documents


@query("h10_net_change", sql=f"WITH RECURSIVE {EDITS}, a AS (SELECT file, array_to_string(lines, chr(10)) AS t FROM rp WHERE pos < 5000 OR i = 0 QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1), b AS (SELECT file, array_to_string(lines, chr(10)) AS t FROM rp QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1) SELECT b.file, a.t <> b.t AS changed, (SELECT count(*) FROM ed WHERE ed.file = b.file AND ed.pos >= 5000) AS commits FROM b JOIN a ON a.file = b.file WHERE EXISTS (SELECT 1 FROM ed WHERE ed.file = b.file AND ed.pos >= 5000)")
def h10(spark, sf):
    """State before the range and after it, for the files that the range touches."""
    c = commits(spark, sf)
    text = lambda f, name: f.select("file", F.concat_ws("\n", "lines").alias(name))
    before, after = text(H.replay(c, until=F.lit(4999)), "before"), text(H.replay(c), "after")
    touched = c.where("pos >= 5000").groupBy("file").agg(F.count(F.lit(1)).alias("commits"))
    return touched.join(after, "file").join(before, "file", "left").select("file", (F.coalesce("before", F.lit("")) != F.col("after")).alias("changed"), "commits")


@query("h3_snapshot_seed", sql=f"WITH RECURSIVE {EDITS} SELECT file, array_to_string(lines, chr(10)) AS text FROM rp QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1")
def h3(spark, sf):
    """Replay in two steps, from a snapshot."""
    c = commits(spark, sf)
    snap = H.replay(c, until=F.lit(4999)).select("file", F.col("lines").alias("seed"))
    rest = H.ordered_edits(c.where("pos > 4999")).withColumnRenamed("edits", "later")
    both = H.replay(c).join(snap, "file", "left").join(rest, "file", "left")
    none = F.array().cast("array<string>")
    seeded = F.when(F.col("later").isNull(), F.coalesce("seed", none)).otherwise(F.aggregate("later", F.coalesce("seed", none), H.applied))
    return both.select("file", F.concat_ws("\n", seeded).alias("text"))


@query("h12_show_commit", sql="WITH a AS (SELECT user_id, event_id AS pos, value FROM events WHERE event_type = 'click') SELECT c.event_id, c.event_type, count(a.pos) AS amended, arg_max(a.value, a.pos) AS latest FROM events c LEFT JOIN a ON a.user_id = c.user_id AND a.pos > c.event_id WHERE c.event_type = 'purchase' GROUP BY ALL")
def h12(spark, sf):
    """Amendments of every commit, however late: running counts from the end of its user's events."""
    e = table(spark, sf, "events").where("event_type in ('click', 'purchase')")
    later = Window.partitionBy("user_id").orderBy(F.col("event_id").desc()).rangeBetween(Window.unboundedPreceding, -1)
    click = F.col("event_type") == "click"
    last = F.max(F.when(click & F.col("value").isNotNull(), F.struct("event_id", "value"))).over(later)
    found = e.select("user_id", "event_id", "event_type", F.count(F.when(click, 1)).over(later).alias("n"), last.alias("last")).where("event_type = 'purchase'")
    known = F.col("user_id").isNotNull() & F.col("event_id").isNotNull()
    counted = F.sum(F.when(known, F.col("n")).otherwise(F.lit(0)))
    return found.groupBy("event_id", "event_type").agg(counted.alias("amended"), F.max(F.when(known, F.col("last")))["value"].alias("latest"))


@query("h14_verify", sql="SELECT user_id, count(*) AS records, count(*) FILTER (event_type = 'error' AND value > 50) AS breaks FROM events GROUP BY user_id")
def h14(spark, sf):
    """Records and chain breaks of every lineage."""
    from lodestone.plans.log_queries import chained
    from lodestone.sources.logs import chain_breaks

    e = chained(spark, sf)
    bad = chain_breaks(e, "event_id", "line", "prev", ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("b"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("records")).join(bad, "user_id", "left").select("user_id", "records", F.coalesce("b", F.lit(0)).alias("breaks"))


@query("h19_session_reference", sql="SELECT user_id || '/S' || nth AS ref, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'signup')")
def h19(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = table(spark, sf, "events").where("event_type = 'signup'").withColumn("nth", F.row_number().over(w))
    return s.select(F.concat(F.col("user_id").cast("string"), F.lit("/S"), F.col("nth").cast("string")).alias("ref"), "event_id")


@query("h27_sessions_by_metadata", sql="SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system')")
def h27(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_or(F.col("role") == "system").alias("s")).where("s").drop("s")


@query("h28_branch_list", sql="WITH k AS (SELECT l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS merged, true AS known FROM lineitem UNION ALL SELECT s_suppkey, 0, false FROM supplier) SELECT id, max(merged)::INT AS merged, bool_or(known) AS known FROM k GROUP BY id")
def h28(spark, sf):
    """Registered branches and those known by their chunks; the state that merged furthest wins."""
    rank = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    known = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.max(rank).alias("merged")).withColumn("known", F.lit(True))
    registered = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0).alias("merged"), F.lit(False).alias("known"))
    return known.unionByName(registered).groupBy("id").agg(F.max("merged").alias("merged"), F.bool_or("known").alias("known"))


@query("h29_unchanged_files", sql="SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = a.p_partkey AND l.l_quantity = a.p_size)")
def h29(spark, sf):
    """Files whose size and time are not cached: an anti-join on the facts."""
    seen = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("p_size")).distinct()
    return table(spark, sf, "part").join(seen, ["p_partkey", "p_size"], "left_anti").select("p_partkey")


@query("h32_adoption_append", sql="WITH b AS (SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('signup', 'purchase', 'click')) SELECT event_id, CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'purchase' THEN 'session_end' ELSE 'commit' END AS kind, (SELECT count(*) FROM events) - 1 + row_number() OVER (ORDER BY user_id, event_id) AS new_id FROM b")
def h32(spark, sf):
    """Adopted records in branch order with the next ids after the parent's."""
    from lodestone.operators.store import running_base

    e = table(spark, sf, "events")
    last = e.agg(F.count(F.lit(1)).alias("last"))  # one row
    b = e.where(F.col("event_type").isin("signup", "purchase", "click")).select("event_id", "user_id", "event_type", F.lit(1).alias("one"))
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "purchase", "session_end").otherwise("commit")
    return running_base(b, "one", ["user_id", "event_id"]).crossJoin(F.broadcast(last)).select("event_id", kind.alias("kind"), (F.col("last") + F.col("base")).alias("new_id"))


@query("o7_heading_context", sql="WITH l AS (SELECT *, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS lv FROM conversations), s AS (SELECT *, max(CASE WHEN lv = 1 THEN turn END) OVER w AS p1, max(CASE WHEN lv = 2 THEN turn END) OVER w AS p2 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, CASE WHEN lv > 1 THEN p1 END AS level1, CASE WHEN lv > 2 AND p2 > coalesce(p1, -1) THEN p2 END AS level2 FROM s")
def o7(spark, sf):
    """The open heading of each shallower level; one closes those below it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    lv = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    s = table(spark, sf, "conversations").withColumn("lv", lv)
    s = s.withColumn("p1", F.last(F.when(F.col("lv") == 1, F.col("turn")), ignorenulls=True).over(w)).withColumn("p2", F.last(F.when(F.col("lv") == 2, F.col("turn")), ignorenulls=True).over(w))
    return s.select("conv_id", "turn", F.when(F.col("lv") > 1, F.col("p1")).alias("level1"), F.when((F.col("lv") > 2) & (F.col("p2") > F.coalesce("p1", F.lit(-1))), F.col("p2")).alias("level2"))


@query("n4_symbol_to_chunk", sql="WITH s AS (SELECT doc_id, strlen(substr(text, 1, strpos(text, 'licensed') - 1)) AS at_byte, strlen(text) AS size FROM documents WHERE contains(text, 'licensed')) SELECT doc_id, c::INT AS ordinal FROM s, unnest(range(0, 100)) t(c) WHERE c * 1600 <= at_byte AND at_byte < least((c + 1) * 1600, size)")
def n4(spark, sf):
    """Containment in fixed spans as an equality on the span's number."""
    at = F.octet_length(F.substring_index("text", "licensed", 1))
    return table(spark, sf, "documents").where(F.contains("text", F.lit("licensed"))).select("doc_id", F.floor(at / 1600).cast("int").alias("ordinal"))


@query("j12_document_with_chunk_count", sql=f"WITH {DOCS_SQL} SELECT id, title, ceil(bytes / 1600.0)::BIGINT AS chunks, (SELECT count(*) FROM labels l WHERE l.doc_id = dd.pos) AS links FROM dd")
def j12(spark, sf):
    l = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("pos")).agg(F.count(F.lit(1)).alias("links"))
    return documents(spark, sf).join(l, "pos", "left").select("id", "title", F.ceil(F.col("bytes") / 1600).alias("chunks"), F.coalesce("links", F.lit(0)).alias("links"))


@query("j13_coerced_rows", sql="SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, coalesce(d.lang, '') AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def j13(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("lang", F.lit("")).alias("lang"))


@query("j15_rail_page", sql=f"WITH {DOCS_SQL} SELECT id, title, collection || ' · ' || source AS description FROM dd WHERE pos + 1 < 500 ORDER BY pos DESC LIMIT 25")
def j15(spark, sf):
    from lodestone.operators.store import page_after

    return page_after(documents(spark, sf), X.id_number("id"), 500, 25, reverse=True).select("id", "title", F.concat_ws(" · ", "collection", "source").alias("description"))


@query("j17_locators", sql="SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages")
def j17(spark, sf):
    name = F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), "[^A-Za-z0-9._-]", "_")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), name.alias("name"))


@query("j6_region_labels", sql="SELECT event_id, CASE WHEN (props->>'$.k')::INT % 3 = 0 THEN 'line ' || ((props->>'$.k')::INT % 4 + 1) ELSE 'lines ' || ((props->>'$.k')::INT % 4 + 1) || '–' || ((props->>'$.k')::INT % 4 + 1 + (props->>'$.k')::INT % 3) END AS label FROM events WHERE event_type <> 'error'")
def j6(spark, sf):
    c = commits(spark, sf).where("op <> 'delete'")
    s, n = F.col("new_start"), F.col("new_lines")
    return c.select(F.col("pos").alias("event_id"), F.when(n == 1, F.concat_ws(" ", F.lit("line"), s)).otherwise(F.concat(F.lit("lines "), s, F.lit("–"), s + n - 1)).alias("label"))


@query("w14_move_cascade", sql="SELECT 'T-' || o_orderkey AS id, 'M-' || o_custkey AS milestone, 'E-' || ((c_nationkey + 1) % 25) AS epic FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7")
def w14(spark, sf):
    """Moving milestones to another epic moves their tickets."""
    moved = table(spark, sf, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"), X.make_id("E", (F.col("c_nationkey") + 1) % 25).alias("epic"))
    return table(spark, sf, "orders").join(moved, "o_custkey").select(X.make_id("T", F.col("o_orderkey")).alias("id"), X.make_id("M", F.col("o_custkey")).alias("milestone"), "epic")


@query("w15_page_upsert", sql="SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_name || ' v2' ELSE p_name END AS title, p_partkey AS created, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS updated FROM part")
def w15(spark, sf):
    """Republishing keeps the creation, takes the new title."""
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("created"), F.lit(1).alias("updated"))
    new = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" v2")).alias("title"), F.lit(None).cast("long").alias("created"), F.lit(2).alias("updated"))
    return old.unionByName(new).groupBy("id").agg(F.max_by("title", "updated").alias("title"), F.min("created").alias("created"), F.max("updated").alias("updated"))


@query("x16_typed_metadata", sql=r"SELECT event_id, CASE WHEN regexp_matches(v, '^-?(0|[1-9][0-9]*)(\.[0-9]+)?$') THEN 'number' WHEN v IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '0' || event_id WHEN 2 THEN 'true' ELSE event_type END AS v FROM events)")
def x16(spark, sf):
    i = F.col("event_id")
    v = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(F.lit("0"), i.cast("string"))).when(i % 4 == 2, "true").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", metadata_kind(v).alias("kind"))


@query("x18_gap_labels", sql="WITH g AS (SELECT event_id, floor((epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))) / 60)::BIGINT AS m FROM events) SELECT event_id, CASE WHEN m < 60 THEN m || ' min later' WHEN m < 1440 THEN (m // 60) || ' h later' ELSE (m // 1440) || ' days later' END AS label FROM g WHERE m >= 5")
def x18(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    e = table(spark, sf, "events").withColumn("m", F.floor((at - F.lag(at).over(w)) / 60)).where("m >= 5")
    n = lambda k, unit: F.concat(F.floor(F.col("m") / k).cast("string"), F.lit(unit))
    return e.select("event_id", F.when(F.col("m") < 60, n(1, " min later")).when(F.col("m") < 1440, n(60, " h later")).otherwise(n(1440, " days later")).alias("label"))


FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)), lambda a, u: (xor(a, u) * 16777619) & 4294967295::BIGINT)"


@query("x7_node_hash", sql=f"SELECT id, {FNV} / 4294967296.0::DOUBLE AS place FROM (SELECT 'D-' || doc_id AS id FROM documents)")
def x7(spark, sf):
    """Places of nodes from their names."""
    ids = table(spark, sf, "documents").select(X.make_id("D", F.col("doc_id")).alias("id"))
    return ids.select("id", X.node_hash("id").alias("place"))


@query("g7_confident_first", sql="WITH s AS (SELECT conv_id AS query, turn AS key, length(text)::DOUBLE AS score FROM conversations), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY query ORDER BY score DESC, key)) SELECT query, key, score >= 2 * coalesce(second, 0) AS confident FROM r WHERE rank = 1")
def g7(spark, sf):
    """The first of a list is kept first where it leads the second by the given factor."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    s = table(spark, sf, "conversations").withColumn("score", F.length("text").cast("double"))
    r = s.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rank = 1")
    return r.select(F.col("conv_id").alias("query"), F.col("turn").alias("key"), (F.col("score") >= 2 * F.coalesce("second", F.lit(0.0))).alias("confident"))
