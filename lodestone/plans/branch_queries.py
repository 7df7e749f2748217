"""Registered queries of branches and reviews, and of readers of source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import code as C
from lodestone.functions import text as X
from lodestone.operators import branches as Br
from lodestone.operators import history as H
from lodestone.plans.log_queries import EDITS, commits
from lodestone.plans.registry import query, table
from lodestone.sources import files


@query("h9_file_status", sql=f"WITH RECURSIVE {EDITS}, w AS (SELECT file, op <> 'delete' AS ok, lines FROM rp QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1), t AS (SELECT file, op <> 'delete' AS ok, lines FROM rp WHERE i > 0 AND pos < 700 QUALIFY row_number() OVER (PARTITION BY file ORDER BY i DESC) = 1) SELECT coalesce(t.file, w.file) AS file, CASE WHEN t.file IS NULL THEN 'untracked' WHEN w.file IS NULL THEN 'deleted' WHEN t.lines = w.lines THEN 'clean' ELSE 'modified' END AS status FROM (SELECT * FROM t WHERE ok) t FULL OUTER JOIN (SELECT * FROM w WHERE ok) w ON t.file = w.file")
def h9(spark, sf):
    """What was tracked at a position against the files of now."""
    c = commits(spark, sf)
    return Br.file_status(H.replay(c, until=F.lit(699)), H.replay(c).where("existing"))


@query("h11_session_ranges", sql="WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS session, row_number() OVER (ORDER BY event_id) AS n FROM events) SELECT session, min(event_id) AS first, max(event_id) AS last, count(*) AS own, (max(n) - min(n) + 1)::BIGINT AS inside FROM e WHERE session IS NOT NULL GROUP BY session")
def h11(spark, sf):
    """A session's range is positional: commits of other sessions between its first and last belong to it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return Br.session_ranges(table(spark, sf, "events").select(F.col("event_id").alias("pos"), start.alias("session")))


@query("h13_before_after", sql=f"WITH RECURSIVE {EDITS} SELECT a.file, a.pos, array_to_string(b.lines, chr(10)) AS before, array_to_string(a.lines, chr(10)) AS after FROM rp a JOIN rp b ON b.file = a.file AND b.i = a.i - 1 QUALIFY row_number() OVER (PARTITION BY a.file ORDER BY a.i DESC) = 1")
def h13(spark, sf):
    """The text before and after the newest commit of every file, both from one fold."""
    edits = H.ordered_edits(commits(spark, sf))
    none = F.array().cast("array<string>")
    before = F.aggregate(F.slice("edits", F.lit(1), F.size("edits") - 1), none, H.applied)
    shown = edits.select("file", F.element_at("edits", -1).alias("_e"), before.alias("_b"))
    return shown.select("file", "_e.pos", F.concat_ws("\n", "_b").alias("before"), F.concat_ws("\n", H.applied(F.col("_b"), F.col("_e"))).alias("after"))


def _registry(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("fix-"), (F.col("s_suppkey") % 7).cast("string")).alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("parent"))
    return r.union(n).union(s)


REGISTRY = "reg AS (SELECT 'R' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation UNION ALL SELECT 'S' || s_suppkey, 'fix-' || (s_suppkey % 7), 'N' || s_nationkey FROM supplier)"


@query("h26_branch_listing", sql=f"WITH RECURSIVE {REGISTRY}, deep AS (SELECT id, name, name AS path, 0 AS depth FROM reg WHERE parent IS NULL UNION ALL SELECT reg.id, reg.name, deep.path || '/' || reg.name, deep.depth + 1 FROM reg JOIN deep ON reg.parent = deep.id) SELECT id, name, path, depth FROM deep")
def h26(spark, sf):
    return Br.deep_listing(_registry(spark, sf))


@query("h26_branch_lookup", sql=f"WITH {REGISTRY}, w AS (SELECT DISTINCT unnest([id, name, name || '?']) AS ref FROM reg) SELECT ref, CASE WHEN (SELECT count(*) FROM reg WHERE id = ref) > 0 OR (SELECT count(*) FROM reg WHERE name = ref) = 1 THEN 'found' WHEN (SELECT count(*) FROM reg WHERE name = ref) > 1 THEN 'ambiguous' ELSE 'none' END AS state, CASE WHEN (SELECT count(*) FROM reg WHERE id = ref) > 0 THEN ref WHEN (SELECT count(*) FROM reg WHERE name = ref) = 1 THEN (SELECT min(id) FROM reg WHERE name = ref) END AS id FROM w")
def h26b(spark, sf):
    reg = _registry(spark, sf)
    wanted = reg.select(F.explode(F.array("id", "name", F.concat("name", F.lit("?")))).alias("ref")).distinct()
    return Br.looked_up(wanted, reg)


@query("h31_registry_edits", sql="WITH l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS t, max(event_id) AS p FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id) SELECT s_suppkey AS id, CASE WHEN t = 'purchase' THEN 'moved/' || p ELSE 'home/' || s_nationkey END AS folder FROM supplier LEFT JOIN l ON l.id = s_suppkey WHERE t IS DISTINCT FROM 'error'")
def h31(spark, sf):
    entries = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("home/"), F.col("s_nationkey").cast("string")).alias("folder"))
    e = table(spark, sf, "events").where("event_type in ('error', 'purchase')")
    edits = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "forget").otherwise("move").alias("op"), F.concat(F.lit("moved/"), F.col("event_id").cast("string")).alias("folder"))
    return Br.registry_after(entries, edits)


# a file for each order; its parent's regions and its branch's, relative to the common base
SIDES = """l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey AS file, (10 * l_linenumber)::INT AS os, (l_partkey % 7)::INT AS ol, (l_suppkey % 4)::INT AS nl, (l_partkey % 2)::VARCHAR AS t FROM l WHERE l_linenumber <= 5),
m AS (SELECT l_orderkey AS file, (10 * l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_partkey % 9 - 2 END)::INT AS os, (CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 7 ELSE l_suppkey % 2 END)::INT AS ol, (l_partkey % 5)::INT AS nl, (l_suppkey % 2)::VARCHAR AS t FROM l)"""
PLACED = f"""WITH {SIDES},
j AS (SELECT m.file, m.os, m.ol, m.nl, m.t, bool_or(p.os = m.os AND p.ol = m.ol AND p.t = m.t) AS same,
  bool_or(NOT (p.os + p.ol <= m.os AND NOT (p.ol = 0 AND p.os = m.os AND m.ol = 0)) AND p.os < m.os + greatest(m.ol, 1) AND m.os < p.os + greatest(p.ol, 1)) AS hit,
  sum(CASE WHEN p.os + p.ol <= m.os AND NOT (p.ol = 0 AND p.os = m.os AND m.ol = 0) THEN p.nl - p.ol ELSE 0 END) AS shift
  FROM m LEFT JOIN p ON p.file = m.file GROUP BY ALL),
s AS (SELECT *, CASE WHEN coalesce(same, false) THEN 'done' WHEN coalesce(hit, false) THEN 'conflict' ELSE 'placed' END AS st FROM j),
r AS (SELECT *, CASE WHEN coalesce(max((st = 'conflict')::INT) OVER (PARTITION BY file ORDER BY os, ol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'left' ELSE st END AS state FROM s)"""


def _sides(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    third = F.col("l_suppkey") % 3 == 0
    parent = l.where("l_linenumber <= 5").select(F.col("l_orderkey").alias("file"), (10 * F.col("l_linenumber")).cast("int").alias("old_start"), (F.col("l_partkey") % 7).cast("int").alias("old_lines"), (F.col("l_suppkey") % 4).cast("int").alias("new_lines"), (F.col("l_partkey") % 2).cast("string").alias("text"))
    start = 10 * F.col("l_linenumber") + F.when(third, 0).otherwise(F.col("l_partkey") % 9 - 2)
    ours = l.select(F.col("l_orderkey").alias("file"), start.cast("int").alias("old_start"), F.when(third, F.col("l_partkey") % 7).otherwise(F.col("l_suppkey") % 2).cast("int").alias("old_lines"), (F.col("l_partkey") % 5).cast("int").alias("new_lines"), (F.col("l_suppkey") % 2).cast("string").alias("text"))
    return parent, ours


@query("h16_merge_adoption", sql=f"{PLACED} SELECT file, os AS old_start, ol AS old_lines, nl AS new_lines, t AS text, state, CASE WHEN state = 'placed' THEN shift::BIGINT END AS shift FROM r")
def h16(spark, sf):
    """Every region of a branch on its parent: placed and shifted, done already, in conflict, or left behind one."""
    return Br.adopted(*_sides(spark, sf))


@query("o17_adoption_offset", sql=f"{PLACED} SELECT file, sum(shift)::BIGINT AS shifted, count(*) AS regions FROM r WHERE state = 'placed' GROUP BY file")
def o17(spark, sf):
    return Br.adopted(*_sides(spark, sf)).where("state = 'placed'").groupBy("file").agg(F.sum("shift").alias("shifted"), F.count(F.lit(1)).alias("regions"))


@query("h17_merge_record", sql=f"{PLACED} SELECT file % 10 AS branch, count(*) FILTER (state = 'placed') AS adopted, count(*) FILTER (state = 'done') AS already, count(*) FILTER (state IN ('left', 'conflict')) AS left, count(*) FILTER (state = 'conflict') AS stops, min(file) FILTER (state = 'conflict') AS first_stop FROM r GROUP BY 1")
def h17(spark, sf):
    record = Br.merge_record(Br.adopted(*_sides(spark, sf)), F.col("file") % 10)
    return record.select("branch", "adopted", "already", "left", F.size("stopped").cast("long").alias("stops"), F.get("stopped", F.lit(0))["file"].alias("first_stop"))


@query("h20_history_page", sql="WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM events), s AS (SELECT session, count(*) AS commits, max(event_id) AS last FROM e WHERE session IS NOT NULL AND contains(props, '1') GROUP BY session) SELECT session, commits, 2 AS page, ceil((SELECT count(*) FROM s) / 20)::INT AS pages, (SELECT count(*) FROM s)::INT AS total FROM s ORDER BY last DESC, session DESC LIMIT 20 OFFSET 20")
def h20(spark, sf):
    """Sessions with a matching commit, newest first, one page of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").withColumn("session", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    s = e.where(F.col("session").isNotNull() & F.contains("props", F.lit("1"))).groupBy("session").agg(F.count(F.lit(1)).alias("commits"), F.max("event_id").alias("last"))
    return H.page_of(s, 20, 2, F.desc("last"), F.desc("session")).select("session", "commits", "page", "pages", "total")


# source files written from parts, whose declarations are known
SOURCE = "'#include <' || lower(replace(p_brand, '#', '')) || '.h>' || chr(10) || '#include \"own' || (p_partkey % 3) || '.h\"' || chr(10) || 'struct s' || p_size || ' {' || chr(10) || '};' || chr(10) || 'int f' || p_partkey || '(int x) {' || chr(10) || '  return x + ' || p_size || '; /* ' || p_name || ' */' || chr(10) || '}' || chr(10)"


def _sources(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(SOURCE.replace("chr(10)", "'\\n'")).alias("source"))


@query("t10_symbols", sql="SELECT p_partkey, 's' || p_size AS name, 'type' AS kind, 3 AS line FROM part UNION ALL SELECT p_partkey, 'f' || p_partkey, 'function', 5 FROM part")
def t10(spark, sf):
    return _sources(spark, sf).select("p_partkey", F.inline(C.symbols_of("source", "c")))


@query("t11_imports", sql="SELECT p_partkey, lower(replace(p_brand, '#', '')) || '.h' AS spec, true AS system FROM part UNION ALL SELECT p_partkey, 'own' || (p_partkey % 3) || '.h', false FROM part")
def t11(spark, sf):
    return _sources(spark, sf).select("p_partkey", F.inline(C.imports_of("source", "c")))


@query("j4_code_meta", sql="SELECT p_partkey, 'c' AS language, 's' || p_size || ',f' || p_partkey AS symbols FROM part")
def j4(spark, sf):
    meta = C.code_meta("source", "c")
    return _sources(spark, sf).select("p_partkey", meta["language"].alias("language"), F.concat_ws(",", meta["symbols"]).alias("symbols"))


@query("x20_display_tokens", sql=f"SELECT p_partkey, {SOURCE} AS joined, '/* ' || p_name || ' */' AS comment, 'struct,return' AS keywords FROM part")
def x20(spark, sf):
    """Tokens of a line lexer: their texts join to the source again."""
    t = _sources(spark, sf).select("p_partkey", C.display_tokens_of("source").alias("t"))
    of = lambda kind: F.transform(F.filter("t", lambda x: x["kind"] == kind), lambda x: x["text"])
    comment = F.element_at(of("comment"), -1)
    return t.select("p_partkey", F.concat_ws("", F.transform("t", lambda x: x["text"])).alias("joined"), comment.alias("comment"), F.concat_ws(",", of("keyword")).alias("keywords"))


@query("t15_section_files", sql="SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'text_before_section' WHEN 1 THEN 'section_repeated: Intent' WHEN 2 THEN 'section_empty: Behavior' END AS error, CASE WHEN event_id % 4 = 3 THEN event_type END AS intent, CASE WHEN event_id % 4 = 3 THEN event_id || chr(10) || 'more' END AS behavior FROM events")
def t15(spark, sf):
    i, t, n = F.col("event_id").cast("string"), F.col("event_type"), F.lit("\n")
    whole = F.concat(F.lit("Intent: "), t, n, F.lit("Behavior:"), n, i, n, F.lit("more"), n)
    text = F.when(F.col("event_id") % 4 == 0, F.concat(t, n, whole)).when(F.col("event_id") % 4 == 1, F.concat(whole, F.lit("Intent: x"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Intent: "), t, n, F.lit("Behavior: "), n)).otherwise(whole)
    s = C.sections_of(text, ("Intent", "Behavior"))
    return table(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", "s.error", F.col("s.sections")["Intent"].alias("intent"), F.col("s.sections")["Behavior"].alias("behavior"))


PLACES = ("src/a.c", "node_modules/x/a.js", "a/third-party/b.py", "venv/lib/a.py", "dist/a.js", "build/b.c", ".git/config", "a/.hidden/b.md", "bower_components/a.js", "lib/site-packages/a.py", "target/a.rs", "vendored/a.c", "a/__pycache__/b.py", "third_party/a.go", "a/vendor", "b/vendor/x.go")
NAMES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "Cargo.lock", "cargo.lock", "a.min.js", "b.min.mjs", "c.min.css", "d.bundle.js", "e.pb.go", "f_pb2.py", "g.pb.h", "h.pb.cc", "i.g.dart", "j.designer.cs", "k.map", "go.sum", "poetry.lock", "composer.lock", "Gemfile.lock", "Pipfile.lock", "yarn.lock", "main.c", "min.js")
FILES = ("Makefile", "GNUmakefile", "x/Dockerfile", "CMakeLists.txt", "README", "CHANGELOG", "docs/CONTRIBUTING", "a.md", "a.MD", "a.html", "a.py", "b.txt", "no_extension")
_nth = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % len(xs) + 1).cast("int"))
_sql = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + f"][p_partkey % {len(xs)} + 1]"


@query("f9_scanned_folders", sql=f"WITH p AS (SELECT p_partkey, {_sql(PLACES)} AS path FROM part) SELECT p_partkey, CASE WHEN regexp_matches(path, '(^|/)[.]') THEN 'hidden' WHEN regexp_matches(path, '(^|/)(node_modules|vendor|third_party|third-party|bower_components|__pycache__|venv|site-packages)/') THEN 'vendored' END AS bucket FROM p")
def f9(spark, sf):
    """Hidden and vendored folders by the library's own rule."""
    return table(spark, sf, "part").select("p_partkey", files.folder_bucket(_nth(PLACES)).alias("bucket"))


@query("f7_generated_names", sql=f"SELECT p_partkey, name, NOT (name IN ('cargo.lock', 'k.map', 'main.c', 'min.js')) AS generated FROM (SELECT p_partkey, {_sql(NAMES)} AS name FROM part)")
def f7(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _nth(NAMES).alias("name")).select("p_partkey", "name", files.is_generated_name(F.col("name")).alias("generated"))


@query("s20_media_types_of_names", sql=f"SELECT p_partkey, ['text/x-makefile', 'text/x-makefile', 'text/x-dockerfile', 'text/x-cmake', 'text/plain', 'text/plain', 'text/plain', 'text/markdown', 'text/plain', 'text/html', 'text/x-python', 'text/plain', 'text/plain'][p_partkey % {len(FILES)} + 1] AS mime FROM part")
def s20(spark, sf):
    return table(spark, sf, "part").select("p_partkey", files.mime_of(_nth(FILES), F.col("p_name")).alias("mime"))
