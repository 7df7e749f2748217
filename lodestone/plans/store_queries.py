"""Registered queries of documents, sources, links and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import store as D
from lodestone.plans.registry import query, table

AS_OF = "2024-06-30 00:00:00"
#: A fetch time for each document, from its id: some cannot be read.
FETCH_SQL = "CASE WHEN doc_id % 17 = 0 THEN 'unknown' ELSE strftime(TIMESTAMP '2024-01-01' + to_hours((doc_id * 37 % 5000)::INT), '%Y-%m-%d %H:%M:%S') END"
DOCS_SQL = f"""dd AS (SELECT doc_id AS pos, 'D-' || (doc_id + 1) AS id, lang AS collection, source, 'text/plain' AS mime, substr(text, 1, 20) AS title, source || '/' || doc_id AS locator, sha256(text) AS content_hash, strlen(text) AS bytes,
  {FETCH_SQL} AS fetched_at, 'W-' || doc_id AS etag, '{{"n": ' || (doc_id % 3) || ', "tags": ["a", "' || lang || '"]}}' AS meta, text FROM documents)"""


def documents(spark, sf):
    """The documents table as filed documents: pos, id, collection, source, mime, title, locator, hash, bytes, fetched_at, etag, meta."""
    i = F.col("doc_id")
    at = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(i * 37 % 5000).cast("int")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "documents").select(
        i.alias("pos"), X.make_id("D", i + 1).alias("id"), F.col("lang").alias("collection"), "source", F.lit("text/plain").alias("mime"), F.substring("text", 1, 20).alias("title"),
        F.concat("source", F.lit("/"), i.cast("string")).alias("locator"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("bytes"),
        F.when(i % 17 == 0, "unknown").otherwise(at).alias("fetched_at"), F.concat(F.lit("W-"), i.cast("string")).alias("etag"),
        F.concat(F.lit('{"n": '), (i % 3).cast("string"), F.lit(', "tags": ["a", "'), "lang", F.lit('"]}')).alias("meta"), "text",
    )


STALE = f"coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(try_cast(fetched_at AS TIMESTAMP)) > 7776000, true)"


@query("f1_document_filter", sql=f"WITH {DOCS_SQL} SELECT id FROM dd WHERE collection IN ('en', 'de') AND try_cast(fetched_at AS TIMESTAMP) >= TIMESTAMP '2024-03-01' AND contains(lower(locator), 'src1')")
def f1(spark, sf):
    return documents(spark, sf).where(D.document_filter(collection="en, de", since="2024-03-01", q="SRC1")).select("id")


@query("f2_meta_containment", sql=f"WITH {DOCS_SQL} SELECT id FROM dd WHERE pos % 3 = 2 AND collection = 'fr'")
def f2(spark, sf):
    return documents(spark, sf).where(D.document_filter(meta={"n": 2, "tags": "fr"})).select("id")


@query("f3_source_filter", sql="SELECT source, count(*) AS documents FROM documents WHERE contains(source, 'rc1') AND lang = 'en' GROUP BY source")
def f3(spark, sf):
    return table(spark, sf, "documents").where(X.contains_folded(F.col("source"), F.lit("RC1")) & (F.col("lang") == "en")).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


@query("f4_stale", sql=f"WITH {DOCS_SQL} SELECT id FROM dd WHERE {STALE}")
def f4(spark, sf):
    return documents(spark, sf).where(D.stale(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp"), X.duration_seconds(F.lit("90d")))).select("id")


@query("j1_document_rows", sql=f"WITH {DOCS_SQL} SELECT id, collection, locator, {STALE} AS stale, coalesce(meta, '{{}}') AS meta FROM dd")
def j1(spark, sf):
    return documents(spark, sf).select("id", "collection", "locator", D.stale(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp"), 7776000).alias("stale"), F.coalesce("meta", F.lit("{}")).alias("meta"))


@query("j2_source_facts", sql=f"WITH {DOCS_SQL} SELECT source, count(*) AS documents, sum(bytes)::BIGINT AS bytes, max(fetched_at) AS fetched_at, arg_max(etag, (fetched_at, pos)) AS etag, CASE WHEN count(*) = 1 THEN any_value(content_hash) ELSE sha256(string_agg(content_hash, '' ORDER BY pos)) END AS content_hash FROM dd GROUP BY source")
def j2(spark, sf):
    return D.source_facts(documents(spark, sf), "source")


@query("a1_collections", sql=f"WITH {DOCS_SQL} SELECT collection, count(*) AS documents, sum(bytes)::BIGINT AS bytes, min(fetched_at) AS oldest FROM dd GROUP BY collection ORDER BY collection")
def a1(spark, sf):
    return documents(spark, sf).groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"), F.min("fetched_at").alias("oldest")).orderBy("collection")


@query("a2_stats_with_totals", sql=f"WITH {DOCS_SQL} SELECT collection, count(*) AS documents, sum(ceil(bytes / 1600.0))::BIGINT AS chunks, sum(bytes)::BIGINT AS bytes FROM dd GROUP BY ROLLUP (collection)")
def a2(spark, sf):
    return documents(spark, sf).rollup("collection").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.ceil(F.col("bytes") / 1600)).alias("chunks"), F.sum("bytes").alias("bytes"))


@query("a3_status", sql=f"WITH {DOCS_SQL} SELECT count(*) AS documents, count(DISTINCT source) AS sources, sum(bytes)::BIGINT AS bytes, sum(({STALE})::INT)::BIGINT AS stale, max(pos) + 2 AS next_id, (SELECT count(*) FROM embeddings) AS vectors FROM dd")
def a3(spark, sf):
    d = documents(spark, sf).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), F.sum("bytes").alias("bytes"), F.sum(D.stale(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp"), 7776000).cast("long")).alias("stale"), (F.max("pos") + 2).alias("next_id"))
    return d.crossJoin(table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("vectors")))  # one row each


@query("a13_oldest_fetch", sql=f"WITH {DOCS_SQL} SELECT collection, min(try_cast(fetched_at AS TIMESTAMP)) AS oldest FROM dd GROUP BY collection")
def a13(spark, sf):
    return documents(spark, sf).groupBy("collection").agg(F.min(F.try_to_timestamp("fetched_at")).cast("timestamp_ntz").alias("oldest"))


@query("a14_refresh_report", sql=f"WITH {DOCS_SQL} SELECT source, count(*) AS stale, CASE WHEN source LIKE 'src1%' THEN 'fetch' ELSE 'read' END AS route FROM dd WHERE {STALE} GROUP BY source")
def a14(spark, sf):
    stale = D.stale(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp"), 7776000)
    return documents(spark, sf).where(stale).groupBy("source").agg(F.count(F.lit(1)).alias("stale")).withColumn("route", F.when(F.col("source").like("src1%"), "fetch").otherwise("read"))


@query("o13_stale_order", sql=f"WITH {DOCS_SQL}, s AS (SELECT *, max(fetched_at) OVER (PARTITION BY source) AS newest FROM dd) SELECT id, newest, (row_number() OVER (ORDER BY newest DESC, source, fetched_at DESC, pos))::BIGINT AS place FROM s WHERE {STALE}")
def o13(spark, sf):
    d = documents(spark, sf).select("id", "pos", "source", "fetched_at")
    newest = d.groupBy("source").agg(F.max("fetched_at").alias("newest"))
    rows = d.where(D.stale(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp"), 7776000)).join(newest, "source")
    order = [F.desc("newest"), F.col("source"), F.desc("fetched_at"), F.col("pos")]
    return D.running_base(rows.withColumn("one", F.lit(1)), "one", order).select("id", "newest", (F.col("base") + 1).cast("long").alias("place"))


@query("q4_keyset_page", sql=f"WITH {DOCS_SQL} SELECT id FROM dd WHERE pos + 1 > 40 AND collection = 'en' ORDER BY pos LIMIT 20")
def q4(spark, sf):
    return D.page_after(documents(spark, sf).where("collection = 'en'"), X.id_number("id"), 40, 20).select("id")


@query("q6_newest_first", sql=f"WITH {DOCS_SQL} SELECT id, try_cast(fetched_at AS TIMESTAMP) AS at FROM dd ORDER BY 2 DESC NULLS LAST, pos LIMIT 30".replace(" AS at ", " AS fetched "))
def q6(spark, sf):
    return documents(spark, sf).select("id", "pos", F.try_to_timestamp("fetched_at").cast("timestamp_ntz").alias("fetched")).orderBy(F.col("fetched").desc_nulls_last(), "pos").limit(30).select("id", "fetched")


@query("w2_blobs_to_write", sql=f"WITH {DOCS_SQL} SELECT DISTINCT content_hash FROM dd a WHERE collection <> 'en' AND NOT EXISTS (SELECT 1 FROM dd b WHERE b.collection = 'en' AND b.content_hash = a.content_hash)")
def w2(spark, sf):
    d = documents(spark, sf)
    return d.where("collection <> 'en'").select("content_hash").distinct().join(d.where("collection = 'en'").select("content_hash"), "content_hash", "left_anti")


CURRENT = "cur AS (SELECT source, locator, CASE WHEN pos % 5 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN pos % 7 = 0 THEN 'other' ELSE title END AS title FROM dd WHERE pos % 11 <> 0), inc AS (SELECT * FROM dd WHERE pos % 13 <> 0)"


@query("w3_ingest_plan", sql=f"WITH {DOCS_SQL}, {CURRENT} SELECT coalesce(i.source, c.source) AS source, coalesce(i.locator, c.locator) AS locator, CASE WHEN c.locator IS NULL THEN 'created' WHEN i.locator IS NULL THEN 'gone' WHEN i.content_hash <> c.content_hash THEN 'revised' WHEN i.title <> c.title THEN 'refiled' ELSE 'touched' END AS action FROM inc i FULL JOIN cur c ON i.source = c.source AND i.locator = c.locator")
def w3(spark, sf):
    """The documents against an older state of the same store, made by changing some of them."""
    d = documents(spark, sf)
    p = F.col("pos")
    old = d.where(p % 11 != 0).withColumn("content_hash", F.when(p % 5 == 0, "old").otherwise(F.col("content_hash"))).withColumn("title", F.when(p % 7 == 0, "other").otherwise(F.col("title")))
    return D.ingest_plan(d.where(p % 13 != 0), old, ["source", "locator"], ["title"])


@query("w4_chunk_ranges", sql=f"WITH {DOCS_SQL}, c AS (SELECT id, pos, ceil(bytes / 1600.0)::BIGINT AS n FROM dd) SELECT id, n AS chunk_count, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM c")
def w4(spark, sf):
    d = documents(spark, sf).select("id", "pos", F.ceil(F.col("bytes") / 1600).alias("chunk_count"))
    return D.running_base(d, "chunk_count", ["pos"]).select("id", "chunk_count", "base")


@query("n3_chunk_to_document", sql=f"WITH {DOCS_SQL}, c AS (SELECT id, pos, ceil(bytes / 1600.0)::BIGINT AS n FROM dd), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM c) SELECT e.vec_id AS chunk, r.id FROM embeddings e JOIN r ON e.vec_id >= r.base AND e.vec_id < r.base + r.n")
def n3(spark, sf):
    """The range join as an equality join: each document lists its chunk numbers."""
    d = documents(spark, sf).select("id", "pos", F.ceil(F.col("bytes") / 1600).alias("n"))
    ranges = D.running_base(d, "n", ["pos"]).where("n > 0").select("id", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("chunk"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk")).join(ranges, "chunk")


@query("w6_index_digest", sql=f"WITH {DOCS_SQL} SELECT collection, sha256(string_agg(id || ':' || content_hash, chr(10) ORDER BY pos)) AS digest FROM dd GROUP BY collection")
def w6(spark, sf):
    """Folded per collection: each document's line is 80 bytes."""
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat("id", F.lit(":"), "content_hash").alias("l"))))
    return documents(spark, sf).groupBy("collection").agg(F.sha2(F.concat_ws("\n", F.transform(lines, lambda x: x["l"])), 256).alias("digest"))


@query("w7_vector_sync", sql="SELECT CASE WHEN e.vec_id IS NULL THEN 'pending' WHEN d.doc_id IS NULL THEN 'dropped' ELSE 'kept' END AS state, count(*) AS n FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def w7(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "full_outer")
    return both.groupBy(F.when(F.col("vec_id").isNull(), "pending").when(F.col("doc_id").isNull(), "dropped").otherwise("kept").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("w8_compact", sql=f"WITH {DOCS_SQL} SELECT count(DISTINCT content_hash) AS unreferenced FROM dd WHERE {STALE} AND content_hash NOT IN (SELECT content_hash FROM dd WHERE NOT ({STALE}))")
def w8(spark, sf):
    d = documents(spark, sf).withColumn("stale", D.stale(F.col("fetched_at"), F.lit(AS_OF).cast("timestamp"), 7776000))
    return d.where("stale").select("content_hash").distinct().join(d.where("not stale").select("content_hash"), "content_hash", "left_anti").agg(F.count(F.lit(1)).alias("unreferenced"))


@query("w9_forget_source", sql=f"WITH {DOCS_SQL} SELECT 'forget' AS type, id, 0 AS step FROM dd WHERE source = 'src3' UNION ALL SELECT 'forget', 'src3', 1")
def w9(spark, sf):
    d = documents(spark, sf).where("source = 'src3'").select(F.lit("forget").alias("type"), "id", F.lit(0).alias("step"))
    return d.union(spark.range(1).select(F.lit("forget"), F.lit("src3"), F.lit(1)))


@query("w10_rename_collection", sql="SELECT source, CASE WHEN bool_or(lang = 'fr') THEN 'de' END AS renamed_to, bool_or(lang = 'de') AS merges FROM documents GROUP BY source HAVING bool_or(lang = 'fr')")
def w10(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.bool_or(F.col("lang") == "fr").alias("has"), F.bool_or(F.col("lang") == "de").alias("merges"))
    return g.where("has").select("source", F.lit("de").alias("renamed_to"), "merges")


EDGES = "ed AS (SELECT DISTINCT l_partkey AS \"from\", l_suppkey AS \"to\", CASE l_returnflag WHEN 'A' THEN 'cites' WHEN 'R' THEN 'imports' ELSE 'see_also' END AS rel FROM lineitem)"


def edges(spark, sf):
    rel = F.expr("CASE l_returnflag WHEN 'A' THEN 'cites' WHEN 'R' THEN 'imports' ELSE 'see_also' END")
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"), rel.alias("rel")).distinct()


def documents_ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"))


@query("n2_resolved_links", sql=f"WITH {EDGES} SELECT \"from\", \"to\", rel, (EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = \"from\")) AS from_resolved, (EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = \"to\")) AS to_resolved FROM ed")
def n2(spark, sf):
    return D.resolved_links(edges(spark, sf), documents_ids(spark, sf))


@query("w11_link_validation", sql=f"WITH {EDGES} SELECT CASE WHEN \"from\" = \"to\" THEN 'self' WHEN rel = 'imports' THEN 'imports' WHEN \"from\" NOT IN (SELECT doc_id FROM documents) THEN 'missing_from' WHEN \"to\" NOT IN (SELECT doc_id FROM documents) THEN 'missing_to' END AS problem, count(*) AS n FROM ed GROUP BY 1")
def w11(spark, sf):
    return D.link_problems(edges(spark, sf), documents_ids(spark, sf)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("n9_edge_diff", sql=f"WITH {EDGES}, w AS (SELECT \"from\", \"to\" FROM ed WHERE rel = 'cites'), e AS (SELECT \"from\", \"to\" FROM ed WHERE rel = 'see_also') SELECT CASE WHEN e.\"from\" IS NULL THEN 'link' WHEN w.\"from\" IS NULL THEN 'unlink' ELSE 'keep' END AS action, count(*) AS n FROM w FULL JOIN e ON w.\"from\" = e.\"from\" AND w.\"to\" = e.\"to\" GROUP BY 1")
def n9(spark, sf):
    e = edges(spark, sf)
    return D.edge_diff(e.where("rel = 'cites'"), e.where("rel = 'see_also'"), ["from", "to"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("e3_set_difference", sql="SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def e3(spark, sf):
    l = table(spark, sf, "lineitem")
    of = lambda f: l.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("part"))
    return of("A").distinct().join(of("R"), "part", "left_anti")


@query("a16_degrees", sql=f"WITH {EDGES}, u AS (SELECT DISTINCT least(\"from\", \"to\") AS a, greatest(\"from\", \"to\") AS b FROM ed WHERE \"from\" <> \"to\") SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node")
def a16(spark, sf):
    return D.degrees(edges(spark, sf))


@query("r1_graph_in_scope", sql=f"WITH {EDGES}, k AS (SELECT d.doc_id FROM documents d WHERE lang = 'fr') SELECT DISTINCT \"from\", \"to\" FROM ed WHERE \"from\" <> \"to\" AND \"from\" IN (SELECT doc_id FROM documents) AND \"to\" IN (SELECT doc_id FROM documents) AND (\"from\" IN (SELECT doc_id FROM k) OR \"to\" IN (SELECT doc_id FROM k))")
def r1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("lang") == "fr").alias("scope"))
    a, b = d.select(F.col("doc_id").alias("from"), F.col("scope").alias("sa")), d.select(F.col("doc_id").alias("to"), F.col("scope").alias("sb"))
    return edges(spark, sf).select("from", "to").distinct().where("`from` <> `to`").join(a, "from").join(b, "to").where("sa or sb").select("from", "to")


@query("r4_adjacency", sql=f"WITH {EDGES} SELECT node, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT \"from\" AS node, 1 AS o, 0 AS i FROM ed UNION ALL SELECT \"to\", 0, 1 FROM ed) GROUP BY node")
def r4(spark, sf):
    ends = F.array(F.struct(F.col("from").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges(spark, sf).select(F.inline(ends)).groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


ADDRESS = r"regexp_replace(regexp_replace(regexp_extract(split_part(url, '#', 1), '^([^?]*)(.*)$', 1), '/index\.html$', '/'), '/+$', '') || regexp_extract(split_part(url, '#', 1), '^([^?]*)(.*)$', 2)"


@query("j8_address_key", sql=f"SELECT page_id, {ADDRESS} AS key FROM pages")
def j8(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.address_key("url").alias("key"))


@query("n20_first_of_address", sql=f"SELECT {ADDRESS} AS key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def n20(spark, sf):
    return table(spark, sf, "pages").groupBy(X.address_key("url").alias("key")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("n21_folder_tree", sql="WITH f AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages), x AS (SELECT array_to_string(p[1:i], '/') AS prefix FROM f, unnest(range(1, len(p))) t(i)) SELECT prefix, count(*) AS n FROM x GROUP BY prefix")
def n21(spark, sf):
    p = table(spark, sf, "pages").select(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/").alias("p")).where("size(p) > 1")
    return p.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i")).groupBy(F.concat_ws("/", F.slice("p", F.lit(1), F.col("i"))).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("j3_chunk_header", sql="SELECT doc_id, CASE WHEN lang = source THEN lang WHEN source = substr(text, 1, 5) THEN lang || ' > ' || source ELSE lang || ' > ' || source || ' > ' || substr(text, 1, 5) END AS header FROM documents")
def j3(spark, sf):
    context = F.concat("lang", F.lit(" > "), "source")
    return table(spark, sf, "documents").select("doc_id", X.chunk_header(F.col("lang"), context, F.substring("text", 1, 5)).alias("header"))


@query("x1_ascii_fold", sql="SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS folded FROM documents")
def x1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.fold("text")).alias("folded"))


@query("x3_ids", sql=f"WITH {DOCS_SQL} SELECT id, pos + 1 AS number FROM dd")
def x3(spark, sf):
    return documents(spark, sf).select("id", X.id_number("id").alias("number"))


@query("x4_durations", sql="SELECT * FROM (VALUES ('1s', 1), ('1m', 60), ('1h', 3600), ('1d', 86400), ('1w', 604800), ('90d', 7776000), ('36h', 129600), ('0d', 0), ('90', NULL), ('1y', NULL), ('1M', NULL), ('', NULL)) t(spec, seconds)")
def x4(spark, sf):
    specs = ["1s", "1m", "1h", "1d", "1w", "90d", "36h", "0d", "90", "1y", "1M", ""]
    return spark.range(1).select(F.explode(F.array(*map(F.lit, specs))).alias("spec")).select("spec", X.duration_seconds("spec").cast("int").alias("seconds"))


@query("x9_utf8_clip", sql="SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE (SELECT max(substr(text, 1, n)) FROM unnest(range(25, 101)) t(n) WHERE strlen(substr(text, 1, n)) <= 100) END AS clipped FROM documents")
def x9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.utf8_clip("text", 100).alias("clipped"))


@query("x10_one_line", sql=r"SELECT doc_id, md5(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, trim(split_part(text, chr(10), 1)) AS first FROM documents")
def x10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.one_line("text")).alias("line"), X.first_line("text").alias("first"))


@query("x11_entities", sql="SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS decoded FROM pages")
def x11(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.decode_entities("html")).alias("decoded"))


@query("x17_token_estimate", sql="SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents")
def x17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query("f6_embeddable", sql=r"WITH c AS (SELECT doc_id, strlen(text) AS bytes, strlen(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS visible, strlen(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters FROM documents) SELECT doc_id, visible > 0 AND letters * 100 >= visible * 40 AND (bytes < 400 OR (bytes - visible) * 100 >= bytes * 2) AS embeddable FROM c")
def f6(spark, sf):
    n = lambda p: F.octet_length(F.regexp_replace("text", p, ""))
    size, visible, letters = F.octet_length("text"), n(r"[\x20\x09-\x0D]"), n(r"[^A-Za-z\x{80}-\x{10FFFF}]")
    return table(spark, sf, "documents").select("doc_id", ((visible > 0) & (letters * 100 >= visible * 40) & ((size < 400) | ((size - visible) * 100 >= size * 2))).alias("embeddable"))


@query("f7_generated_marker", sql="SELECT doc_id FROM documents WHERE regexp_matches(lower(array_to_string(string_split(text, chr(10))[1:5], chr(10))), 'the of|der die')")
def f7(spark, sf):
    head = F.lower(F.concat_ws("\n", F.slice(F.split("text", "\n"), 1, 5)))
    return table(spark, sf, "documents").where(head.rlike("the of|der die")).select("doc_id")


@query("f8_is_text", sql="SELECT doc_id, NOT contains(text, chr(1)) AS ok FROM documents")
def f8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.is_valid_utf8("text") & ~F.contains("text", F.lit("\x01"))).alias("ok"))


@query("s9_blob_by_hash", sql=f"WITH {DOCS_SQL} SELECT b.content_hash, count(*) AS referenced, any_value(b.bytes) AS bytes FROM (SELECT content_hash, any_value(bytes) AS bytes FROM dd GROUP BY content_hash) b JOIN dd ON dd.content_hash = b.content_hash WHERE regexp_matches(b.content_hash, '^[0-9a-f]{{64}}$') GROUP BY b.content_hash")
def s9(spark, sf):
    d = documents(spark, sf).select("content_hash", "bytes").where(F.col("content_hash").rlike("^[0-9a-f]{64}$"))
    return d.groupBy("content_hash").agg(F.count(F.lit(1)).alias("referenced"), F.first("bytes").alias("bytes"))


@query("s20_media_types", sql=r"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)^\s*(<!doctype html|<html)') THEN 'text/html' WHEN regexp_matches(html, '^\s*# ') THEN 'text/markdown' ELSE 'text/plain' END AS mime FROM pages")
def s20(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.when(h.rlike(r"(?i)^\s*(<!doctype html|<html)"), "text/html").when(h.rlike(r"^\s*# "), "text/markdown").otherwise("text/plain").alias("mime"))


@query("t4_html_headings", sql=r"SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6][\s>/]'))::INT AS headings, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS first FROM pages")
def t4(spark, sf):
    first = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1", 1)
    return table(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit(r"(?i)<h[1-6][\s>/]")).alias("headings"), F.trim(F.regexp_replace(F.regexp_replace(first, "<[^>]*>", ""), r"\s+", " ")).alias("first"))


@query("j16_relative_dates", sql="WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_id, ts, floor(epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)))::BIGINT AS s FROM events CROSS JOIN n) SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' WHEN s < 172800 THEN 'yesterday' WHEN s < 604800 THEN (s // 86400) || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM e")
def j16(spark, sf):
    e = table(spark, sf, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", X.relative_age(F.col("ts").cast("timestamp"), F.col("now").cast("timestamp")).alias("age"))
