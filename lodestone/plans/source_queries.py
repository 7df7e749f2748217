"""Registered queries of splitters, symbols, snippets, regions, sessions, display HTML and index state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import lines as Ln
from lodestone.functions.chunks import OVERLAP, TARGET, chunks, symbol_chunks
from lodestone.functions.display import display_html, safe_href
from lodestone.functions.snippet import snippets
from lodestone.operators import history as H
from lodestone.operators import retrieval as R
from lodestone.operators import sessions as Se
from lodestone.operators.store import running_base
from lodestone.plans import sqltext as S
from lodestone.plans.log_queries import EDITS, commits
from lodestone.plans.registry import ORACLES, query, table
from lodestone.plans.retrieval_queries import VEC, asked, keyword_list, vector_list


def part(spark, sf):
    return table(spark, sf, "part")


# splitters: sources are written out of the table, so that SQL can say where each chunk lies
LONG_MD = "repeat('word ', 60)"
MD = f"'# A' || p_partkey || chr(10) || {LONG_MD} || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10)"


@query("t3_markdown_sections", sql=f"WITH p AS (SELECT p_partkey, 'A' || p_partkey AS a, strlen({MD}) AS cut, strlen({MD} || '## B ##' || chr(10) || {LONG_MD}) AS size FROM part) SELECT p_partkey, 0 AS ordinal, 0 AS start, cut AS \"end\", a AS heading, NULL AS context FROM p UNION ALL SELECT p_partkey, 1, cut, size, 'B', a FROM p")
def t3(spark, sf):
    """Headings outside fences, their trail, trailing marks."""
    body = F.repeat(F.lit("word "), F.lit(60))
    text = F.concat(F.lit("# A"), F.col("p_partkey").cast("string"), F.lit("\n"), body, F.lit("\n```\n# no heading\n```\n## B ##\n"), body)
    return chunks(part(spark, sf).select("p_partkey", text.alias("text")), "p_partkey", "text", "markdown").drop("tokens")


CODE = "'// of part ' || p_partkey || chr(10) || 'int f' || p_partkey || '(void) {' || chr(10) || '    return ' || p_size || ';' || chr(10) || '}' || chr(10)"


def _code(spark, sf):
    text = F.concat(F.lit("// of part "), F.col("p_partkey").cast("string"), F.lit("\nint f"), F.col("p_partkey").cast("string"), F.lit("(void) {\n    return "), F.col("p_size").cast("string"), F.lit(";\n}\nstruct s"), F.col("p_partkey").cast("string"), F.lit(" {\n    int a;\n};\n"))
    return part(spark, sf).select("p_partkey", text.alias("text"))


@query("t5_code_sections", sql=f"WITH p AS (SELECT p_partkey, strlen({CODE}) AS cut, strlen({CODE} || 'struct s' || p_partkey || ' {{' || chr(10) || '    int a;' || chr(10) || '}};' || chr(10)) AS size FROM part) SELECT p_partkey, 0 AS ordinal, 0 AS start, cut AS \"end\", 'int f' || p_partkey || '(void)' AS heading FROM p UNION ALL SELECT p_partkey, 1, cut, size, 'struct s' || p_partkey FROM p")
def t5(spark, sf):
    """Declarations outside braces; the comment above belongs to its declaration."""
    return chunks(_code(spark, sf), "p_partkey", "text", "code").drop("tokens", "context")


@query("t6_windows", sql=f"SELECT p_partkey, i::INT AS ordinal, i * {TARGET - OVERLAP} AS start, least(i * {TARGET - OVERLAP} + {TARGET}, p_size * 200) AS \"end\" FROM part, unnest(range(0, 20)) t(i) WHERE p_size > 0 AND (i = 0 OR p_size * 200 - (i - 1) * {TARGET - OVERLAP} > {TARGET})")
def t6(spark, sf):
    """Windows over texts without a line or a space to snap to."""
    text = F.repeat(F.lit("x"), F.col("p_size").cast("int") * 200)
    return chunks(part(spark, sf).select("p_partkey", text.alias("text")), "p_partkey", "text", "text").select("p_partkey", "ordinal", "start", "end")


@query("t7_small_siblings", sql="WITH p AS (SELECT p_partkey, strlen('## a' || chr(10) || p_name || chr(10) || '## b' || chr(10) || 'y' || chr(10)) AS cut, strlen('## a' || chr(10) || p_name || chr(10) || '## b' || chr(10) || 'y' || chr(10) || '## c' || chr(10) || repeat('z', 300)) AS size FROM part WHERE strlen(p_name) < 190) SELECT p_partkey, 'a' AS heading, 0 AS start, cut AS \"end\" FROM p UNION ALL SELECT p_partkey, 'c', cut, size FROM p")
def t7(spark, sf):
    """Two small siblings go together, a large one stays for itself."""
    text = F.concat(F.lit("## a\n"), "p_name", F.lit("\n## b\ny\n## c\n"), F.repeat(F.lit("z"), F.lit(300)))
    docs = part(spark, sf).where(F.octet_length("p_name") < 190).select("p_partkey", text.alias("text"))
    return chunks(docs, "p_partkey", "text", "markdown").select("p_partkey", "heading", "start", "end")


@query("n4_symbols_in_chunks", sql=f"SELECT p_partkey, 'f' || p_partkey AS name, strlen('// of part ' || p_partkey || chr(10)) AS at, 0 AS ordinal FROM part UNION ALL SELECT p_partkey, 's' || p_partkey, strlen({CODE}), 1 FROM part")
def n4s(spark, sf):
    return symbol_chunks(_code(spark, sf), "p_partkey", "text", "c").select("p_partkey", "name", "at", "ordinal")


SNIP = "SELECT p_partkey, p_size AS n, repeat('lorem ', p_size) || 'needle' || repeat(' ipsum', 60 - p_size) AS text, CASE WHEN 6 * p_size < 64 THEN 0 ELSE 6 * p_size - 42 END AS b FROM part WHERE p_size BETWEEN 1 AND 59"


@query("t12_snippets", sql=f"SELECT p_partkey, CASE WHEN b > 0 THEN '…' ELSE '' END || trim(substr(text, b + 1, 240)) || CASE WHEN b + 240 < strlen(text) THEN '…' ELSE '' END AS snippet FROM ({SNIP})")
def t12(spark, sf):
    """A window of 240 bytes that begins at a word in front of the term."""
    n = F.col("p_size").cast("int")
    text = F.concat(F.repeat(F.lit("lorem "), n), F.lit("needle"), F.repeat(F.lit(" ipsum"), 60 - n))
    rows = part(spark, sf).where("p_size between 1 and 59").select("p_partkey", text.alias("text"), F.array(F.lit("needle")).alias("terms"))
    return rows.select("p_partkey", snippets("text", "terms").alias("snippet"))


@query("h7_replace_lines", sql="SELECT p_partkey, array_to_string(CASE WHEN p_size % 7 >= 1 AND p_size % 7 - 1 + p_size % 3 <= 4 THEN list_concat(list_concat(l[1:p_size % 7 - 1], [p_name]), l[p_size % 7 + p_size % 3:]) ELSE l END, '|') AS lines FROM (SELECT *, ['a', 'b', 'c', 'd'] AS l FROM part)")
def h7(spark, sf):
    four, i = F.array(*map(F.lit, "abcd")), F.col("p_size").cast("int")
    return part(spark, sf).select("p_partkey", F.concat_ws("|", Ln.replaced(four, i % 7, i % 3, F.array("p_name"))).alias("lines"))


@query("h8_picked_regions", sql="SELECT p_partkey, CASE WHEN s = 4 AND e = 6 THEN 'ok' WHEN s = 1 AND e = 1 THEN 'ok' WHEN e >= 1 AND s <= 1 THEN 'replacement' WHEN e >= 4 AND s <= 6 THEN CASE WHEN s < 4 OR e > 6 THEN 'crosses' ELSE 'ok' END ELSE 'none' END AS answer, CASE WHEN s = 1 AND e = 1 THEN 1 WHEN s >= 4 AND e <= 6 AND e >= s THEN s END AS new_start FROM (SELECT p_partkey, (p_size % 8)::INT AS s, (p_size % 8 + p_size % 3)::INT AS e FROM part)")
def h8(spark, sf):
    """Line 1 was replaced, lines 4 to 6 were put in."""
    regions = F.expr("array(named_struct('old_start', 1, 'old_lines', 1, 'new_start', 1, 'new_lines', 1), named_struct('old_start', 4, 'old_lines', 0, 'new_start', 4, 'new_lines', 3))")
    i = F.col("p_size").cast("int")
    return part(spark, sf).select("p_partkey", Ln.picked(regions, i % 8, i % 8 + i % 3).alias("p")).select("p_partkey", "p.answer", "p.new_start")


@query("w12_commit_records", sql="SELECT p_partkey AS file, CASE p_size % 4 WHEN 0 THEN 'nothing_to_commit' WHEN 3 THEN 'several_regions' ELSE 'ok' END AS answer, CASE p_size % 4 WHEN 1 THEN 'edit' WHEN 2 THEN 'create' END AS op, CASE p_size % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS new_start, CASE p_size % 4 WHEN 1 THEN 'b' WHEN 2 THEN '' END AS old_text, CASE p_size % 4 WHEN 1 THEN p_name WHEN 2 THEN p_name END AS new_text FROM part")
def w12(spark, sf):
    i, name = F.col("p_size") % 4, F.col("p_name")
    old = F.when(i == 2, "").otherwise("a\nb\nc\nd\n")
    new = F.when(i == 0, "a\nb\nc\nd\n").when(i == 1, F.concat(F.lit("a\n"), name, F.lit("\nc\nd\n"))).when(i == 2, F.concat(name, F.lit("\n"))).otherwise(F.concat(name, F.lit("\nb\nc\n"), name, F.lit("\n")))
    done = Se.commit_records(part(spark, sf).select(F.col("p_partkey").alias("file"), old.alias("old"), new.alias("new")))
    joined = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("|", c)).alias(c)
    return done.select("file", "answer", "op", "new_start", joined("old_text"), joined("new_text"))


REQUESTS = "rq AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'start' ELSE 'end' END AS op, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS msg FROM events WHERE event_type IN ('signup', 'purchase')), rc AS (SELECT *, CASE WHEN op = 'start' AND trim(msg) = '' THEN NULL ELSE op END AS counts FROM rq), rb AS (SELECT *, last_value(counts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rc), ra AS (SELECT *, CASE WHEN counts IS NULL THEN 'message_required' WHEN op = 'start' AND coalesce(before = 'start', false) THEN 'session_active' WHEN op = 'end' AND NOT coalesce(before = 'start', false) THEN 'no_active_session' ELSE 'ok' END AS answer FROM rb)"


@query("w13_session_requests", sql=f"WITH {REQUESTS} SELECT event_id, answer, CASE WHEN answer = 'ok' THEN (count(*) FILTER (answer = 'ok' AND op = 'start') OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT END AS session FROM ra")
def w13(spark, sf):
    op, msg = F.when(F.col("event_type") == "signup", "start").otherwise("end"), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type"))
    rows = table(spark, sf, "events").where("event_type in ('signup', 'purchase')").select("event_id", "user_id", op.alias("op"), msg.alias("msg"))
    return Se.session_requests(rows, "user_id", "event_id").select("event_id", "answer", "session")


@query("s6_history_fold", sql="WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS of FROM events), a AS (SELECT of, count(*) AS n, arg_max(event_id, event_id) AS last FROM e WHERE event_type = 'click' AND of IS NOT NULL GROUP BY of), s AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.event_id AS pos, 'S' || e.user_id AS session, coalesce(s.first > e.event_id, true) AS orphan, coalesce(a.last, e.event_id)::VARCHAR AS intent, coalesce(a.n, 0) AS amendments FROM e LEFT JOIN a ON a.of = e.event_id LEFT JOIN s ON s.user_id = e.user_id WHERE event_type = 'purchase'")
def s6(spark, sf):
    """Users are sessions that signups start; clicks amend the user's last purchase before them."""
    e = table(spark, sf, "events")
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id"))
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "click", "amend")
    name, no = F.concat(F.lit("S"), F.col("user_id").cast("string")), F.col("event_id").cast("string")
    rows = e.select(F.col("event_id").alias("pos"), kind.alias("type"), name.alias("id"), name.alias("session"), F.sha2(no, 256).alias("hash"), F.sha2(last.cast("string"), 256).alias("of"), name.alias("user"), no.alias("intent"), no.alias("behavior"))
    return Se.commit_sessions(rows).select("pos", "session", "orphan", "intent", "amendments")


H4 = ORACLES["h4_blame"]


@query("h5_blame_of_current_lines", sql=f"SELECT file, (line + 1)::INT AS line, false AS pending, pos FROM ({H4}) UNION ALL SELECT DISTINCT file, 1, true, NULL FROM ({H4})")
def h5(spark, sf):
    """Every file with a line put in on top that no commit has."""
    c = commits(spark, sf)
    done = H.replay(c).where("size(lines) > 0")
    files = done.select("file", F.concat_ws("\n", "lines").alias("committed"), F.concat_ws("\n", F.array(F.lit("not committed")), "lines").alias("current"))
    lines = done.select("file", F.explode(F.sequence(F.lit(1), F.size("lines") + 1)).alias("line"))
    return Se.blame_current(c, files, lines)


@query("h21_session_files", sql="WITH c AS (SELECT user_id % 20 AS session, (props->>'$.k')::INT AS file, event_id AS pos, event_type AS t FROM events), f AS (SELECT session, file, min(pos) AS first, arg_max(t, pos) AS t FROM c GROUP BY ALL) SELECT session, file, (row_number() OVER (PARTITION BY session ORDER BY first))::INT AS place FROM f WHERE t <> 'error'")
def h21(spark, sf):
    op = F.when(F.col("event_type") == "error", "untrack").otherwise("edit")
    return Se.files_of_session(table(spark, sf, "events").select((F.col("user_id") % 20).alias("session"), F.from_json("props", "k int")["k"].alias("file"), F.col("event_id").alias("pos"), op.alias("op")))


TARGETS = ("https://a.b/c", "HTTP://x", "mailto:a@b", "javascript:alert(1)", "  JaVaScRiPt:x", "data:text/html,x", "rel/path", "#part", "", "   ", "//host/x", "vbscript:x")


@query("x12_safe_targets", sql=f"SELECT p_partkey, CASE WHEN h IN ('javascript:alert(1)', 'JaVaScRiPt:x', 'data:text/html,x', 'vbscript:x', '') THEN NULL ELSE h END AS href FROM (SELECT p_partkey, trim([{', '.join(repr(t) for t in TARGETS)}][p_partkey % {len(TARGETS)} + 1]) AS h FROM part)")
def x12(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("p_partkey") % len(TARGETS) + 1).cast("int"))
    return part(spark, sf).select("p_partkey", safe_href(raw).alias("href"))


@query("x12_display_html", sql="SELECT p_partkey, '<h1>' || p_name || '</h1><p>' || p_size || ' &amp; <b>' || p_brand || '</b> <a href=\"https://x/' || p_partkey || '\">in</a> out</p><br>' AS shown FROM part")
def x12h(spark, sf):
    raw = F.concat(F.lit("<div class='x'><h1 id=a>"), "p_name", F.lit("</h1><script>var a = '<p>';</script><p onclick='x()'>"), F.col("p_size").cast("string"), F.lit(" &amp; <b>"), "p_brand", F.lit("</b> <a href='https://x/"), F.col("p_partkey").cast("string"), F.lit("'>in</a> <a href='javascript:x'>out</a></p><br><img src=x><!-- gone --></div>"))
    return part(spark, sf).select("p_partkey", display_html(raw).alias("shown"))


def model_state(available, recorded, of_vectors, missing):
    """Whether a semantic search may run: the model there is, the one recorded, the one the vectors are of, chunks without a vector."""
    return F.when(available.isNull(), "model_missing").when(recorded.isNotNull() & (recorded != available), "model_mismatch").when(recorded.isNull() | ~of_vectors.eqNullSafe(available), "index_stale").when(missing > 0, "partial").otherwise("ok")


@query("g10_model_state", sql="SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'model_missing' WHEN n_nationkey % 5 = 1 THEN 'model_mismatch' WHEN n_nationkey % 5 = 2 THEN 'index_stale' WHEN n_nationkey % 5 = 3 THEN 'partial' ELSE 'ok' END AS state FROM nation")
def g10(spark, sf):
    i = F.col("n_nationkey") % 5
    available, recorded, of_vectors = F.when(i != 0, "dim=64"), F.when(i == 1, "dim=32").when(i != 2, "dim=64"), F.lit("dim=64")
    return table(spark, sf, "nation").select("n_nationkey", model_state(available, recorded, of_vectors, F.when(i == 3, 7).otherwise(0)).alias("state"))


BUDGET = 100_000


@query("z4_embedding_budget", sql=f"SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars >= {BUDGET} AS pending FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.vec_id % 2 = 0)")
def z4(spark, sf):
    """Chunks without a vector, in order, until the budget is spent; the rest stay pending for a later run."""
    have = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    missing = table(spark, sf, "documents").select("doc_id", "n_chars").join(have, "doc_id", "left_anti")
    return running_base(missing, "n_chars", ["doc_id"]).select("doc_id", (F.col("base") >= BUDGET).alias("pending"))


def label_problems(rows):
    """item_id, problem of benchmark rows (id, tag, q, rel) that do not fit: one row for each row at fault, its first problem."""
    same = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    problem = F.when(F.col("_n") > 1, "duplicate_id").when(~F.col("tag").isin("paraphrase", "identifier", "purpose"), "tag").when(F.coalesce(F.trim("q"), F.lit("")) == "", "empty_query").when(~F.size("rel").between(1, 3), "rel")
    return rows.join(same, "id").select("item_id", problem.alias("problem")).where("problem is not null")


@query("s18_label_checks", sql="SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 'duplicate_id' WHEN item_id % 4 = 2 THEN 'tag' WHEN item_id % 4 = 3 THEN 'empty_query' END AS problem FROM benchmark")
def s18(spark, sf):
    i = F.col("item_id") % 4
    rows = table(spark, sf, "benchmark").select("item_id", F.when(i == 1, "same").otherwise(F.col("item_id").cast("string")).alias("id"), F.when(i == 2, "other").otherwise("purpose").alias("tag"), F.when(i == 3, " ").otherwise(F.col("text")).alias("q"), F.array(F.lit("a.md")).alias("rel"))
    return rows.join(label_problems(rows), "item_id", "left").select("item_id", "problem")


@query("q1_bm25_topk", sql=f"WITH {S.bm25()} SELECT query, doc_id, rank::INT AS rank FROM ({S.ranked('bm', 3)})")
def q1(spark, sf):
    return keyword_list(spark, sf, 3).select("query", "doc_id", "rank")


@query("n7_terms_in_postings", sql=f"WITH {S.bm25()} SELECT q.query, count(*) AS terms, count(dfs.df) AS found, coalesce(sum(dfs.df), 0)::BIGINT AS postings FROM q LEFT JOIN dfs USING (term) GROUP BY q.query")
def n7(spark, sf):
    wanted = R.asked_terms(asked(spark, sf))
    rows = R.counted(R.terms_of(table(spark, sf, "documents"), "doc_id", {"text": 1}), "doc_id").where("term is not null")
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(df, "term", "left").groupBy("query").agg(F.count(F.lit(1)).alias("terms"), F.count("df").alias("found"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))


@query("n6_flat_scan", sql=f"WITH {VEC} SELECT query, arg_max(doc_id, score) AS doc_id, round(max(score), 6) AS score FROM vs GROUP BY query")
def n6(spark, sf):
    return vector_list(spark, sf, 1).select("query", "doc_id", R.rounded("score").alias("score"))


@query("o4_tie_chain", sql="WITH l AS (SELECT conv_id AS query, turn % 2 AS list_no, turn // 2 + 1 AS rank, turn AS key FROM conversations), f AS (SELECT query, key, min({'l': list_no, 'r': rank}) AS first FROM l GROUP BY ALL) SELECT query, key, (row_number() OVER (PARTITION BY query ORDER BY first.l, first.r, key))::INT AS rank FROM f")
def o4(spark, sf):
    """Equal scores: the list given first, then the rank in it, then the key."""
    c = table(spark, sf, "conversations")
    lists = c.select(F.col("conv_id").alias("query"), (F.col("turn") % 2).alias("list_no"), (F.floor(F.col("turn") / 2) + 1).alias("rank"), F.col("turn").alias("key"), F.lit(1.0).alias("score"))
    fused = lists.groupBy("query", "key").agg(F.max("score").alias("score"), F.min(F.struct("list_no", "rank")).alias("_f")).select("query", "key", "score", F.col("_f.list_no").alias("first_list"), F.col("_f.rank").alias("best_rank"))
    return R.fused_order(fused, "key", 1_000_000_000).select("query", "key", "rank")


@query("o16_allocated_ids", sql="SELECT doc_id, (1 + sum(ceil(n_chars / 1000)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - ceil(n_chars / 1000))::BIGINT AS first_id FROM documents")
def o16(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.ceil(F.col("n_chars") / 1000).alias("n"))
    return running_base(d, "n", ["doc_id"]).select("doc_id", (F.col("base") + 1).cast("long").alias("first_id"))
