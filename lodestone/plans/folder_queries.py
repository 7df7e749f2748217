"""Registered queries of folders, page folders, ranges and closing tickets: files are written from the given tables and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import branches as Br
from lodestone.operators import history as H
from lodestone.operators import sessions as Se
from lodestone.plans.registry import query, table
from lodestone.plans.stream_queries import _place
from lodestone.sources import files, walk
from lodestone.sources import log_source as L


def put_files(rows: DataFrame, folder: str) -> None:
    """A file for each of ``rows`` (path, text)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = L._place(folder)
        n, made = 0, set()
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                parent = f"{top}/{path}".rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(text.encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    rows.select("path", "text").mapInPandas(task, "n long").agg(F.sum("n")).collect()  # one number


DIRS = ("src", "docs", "build", "a/node_modules/x", ".cfg", "docs/deep/er", "lib/x", "src/_gen")
ENDINGS = ("html", "txt", "bin", "md", "json")
#: path, text, and the same rules once more as patterns of whole paths for the SQL: (pattern, ignored) in order.
IGNORE = ((".gitignore", "# of all\n*.txt\n!p*[0-4].txt  \n/build/\nlib/**/p?1.*\n"), ("docs/.gitignore", "/deep/\r\np?.md\n!p[4-6].md\n"))
IGNORED = "CASE WHEN dir = 'docs' AND regexp_matches(name, '^p[4-6]\\.md$') THEN false WHEN dir = 'docs' AND regexp_matches(name, '^p[^/]\\.md$') THEN true WHEN dir LIKE 'lib/%' AND regexp_matches(name, '^p[^/]1\\.') THEN true WHEN regexp_matches(name, '^p.*[0-4]\\.txt$') THEN false ELSE name LIKE '%.txt' END"
PAGE_FILES = f"""f AS (SELECT page_id, {list(DIRS)}[page_id % 8 + 1] AS dir, 'p' || page_id || '.' || {list(ENDINGS)}[(page_id // 8) % 5 + 1] AS name,
  CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN '<!-- @generated -->' || chr(10) ELSE '' END || CASE WHEN page_id % 11 = 0 THEN '' ELSE coalesce(html, '') END AS text FROM pages WHERE page_id IS NOT NULL),
b AS (SELECT *, dir || '/' || name AS path, octet_length(encode(text)) AS size, {IGNORED} AS ignored FROM f WHERE dir NOT IN ('build', 'a/node_modules/x', '.cfg', 'docs/deep/er')),
w AS (SELECT *, CASE WHEN ignored THEN 'ignored' WHEN name LIKE '%.bin' THEN 'other_type' WHEN size > CASE WHEN name LIKE '%.json' THEN 65536 ELSE 1048576 END THEN 'large' WHEN size = 0 OR contains(text, chr(0)) THEN 'binary_or_empty'
  WHEN regexp_matches(array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)), '(?i)generated by|do not edit|@generated') THEN 'generated_text' END AS bucket FROM b),
folders AS (SELECT DISTINCT CASE dir WHEN 'a/node_modules/x' THEN 'a/node_modules' WHEN 'docs/deep/er' THEN 'docs/deep' ELSE dir END AS path, CASE dir WHEN 'a/node_modules/x' THEN 'vendored' WHEN '.cfg' THEN 'hidden' ELSE 'ignored' END AS bucket FROM f WHERE dir IN ('build', 'a/node_modules/x', '.cfg', 'docs/deep/er'))"""


def _page_files(spark, sf) -> DataFrame:
    rows = table(spark, sf, "pages").where("page_id is not null").groupBy("page_id").agg(F.first("html").alias("html"))
    nth = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    n = F.col("page_id")
    name = F.concat(F.lit("p"), n.cast("string"), F.lit("."), nth(ENDINGS, F.expr("page_id div 8")))
    body = F.concat(F.when(n % 13 == 0, "<!-- @generated -->\n").otherwise(""), F.coalesce("html", F.lit("")))
    return rows.select(F.concat_ws("/", nth(DIRS, n), name).alias("path"), F.when(n % 11 == 0, "").otherwise(body).alias("text"))


@query("s10_walked_folder", sql=f"WITH {PAGE_FILES} SELECT path, bucket, size, CASE WHEN bucket IS NULL THEN md5(text) END AS digest FROM w UNION ALL SELECT path, bucket, NULL, NULL FROM folders UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{p}', 'hidden', {len(t)}::BIGINT, NULL)" for p, t in IGNORE) + ")")
def s10_walk(spark, sf):
    """A folder of all pages, with ignore files at two levels, as version control would see it."""
    folder = _place(spark, "walk")
    put_files(_page_files(spark, sf).unionByName(spark.createDataFrame(IGNORE, "path string, text string")), folder)
    return walk.walked(spark, folder).select("path", "bucket", "size", F.md5("text").alias("digest"))


@query("s8_page_folders", sql="""WITH p AS (SELECT page_id, any_value(url) AS url, any_value(html) AS html FROM pages WHERE page_id IS NOT NULL GROUP BY page_id)
SELECT 'P-' || page_id AS id, CASE page_id % 7 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'other_id' WHEN 3 THEN 'no_title' WHEN 4 THEN 'no_page' END AS problem,
  CASE WHEN page_id % 7 IN (1, 3) THEN '' ELSE coalesce(url, '') END AS title, CASE WHEN page_id % 7 = 1 THEN '' ELSE CASE WHEN page_id % 2 = 0 THEN 'u' ELSE 'c' END || page_id END AS updated,
  CASE WHEN page_id % 7 = 1 THEN '' WHEN page_id % 2 = 0 THEN 'a,b' ELSE '' END AS keywords, CASE WHEN page_id % 7 <> 4 THEN octet_length(encode(coalesce(html, ''))) END AS bytes FROM p""")
def s8_pages(spark, sf):
    """A folder for each page; of seven, one has torn metadata, one another's id, one no title of text, one no page."""
    folder = _place(spark, "pages")
    p = table(spark, sf, "pages").where("page_id is not null").groupBy("page_id").agg(F.first("url").alias("url"), F.first("html").alias("html"))
    no, n, rest = F.col("page_id").cast("string"), F.col("page_id") % 7, F.col("page_id") % 2
    own = F.concat(F.lit("P-"), no)
    title = F.to_json(F.struct(F.coalesce("url", F.lit("")).alias("title")))
    made = F.to_json(F.struct(F.when(n == 2, "P-x").otherwise(own).alias("id"), F.concat(F.lit("c"), no).alias("createdAt"), F.when(rest == 0, F.concat(F.lit("u"), no)).alias("updatedAt")))
    words = F.when(rest == 0, '"keywords":["a",1,null,"b"]').otherwise('"keywords":"a"')
    whole = F.concat(F.regexp_replace(made, r"\}\z", ","), F.when(n == 3, '"title":5').otherwise(F.regexp_extract(title, r"(?s)\A\{(.*)\}\z", 1)), F.lit(","), words, F.lit("}"))
    meta = p.select(F.concat(own, F.lit("/meta.json")).alias("path"), F.when(n == 1, F.substring(whole, 1, 20)).otherwise(whole).alias("text"))
    put_files(meta.unionByName(p.where(n != 4).select(F.concat(own, F.lit("/page.html")).alias("path"), F.coalesce("html", F.lit("")).alias("text"))), folder)
    return files.page_list(spark, folder).select("id", "problem", "title", F.col("updatedAt").alias("updated"), F.concat_ws(",", "keywords").alias("keywords"), "bytes")


ENDS = "e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events), r AS (SELECT user_id AS request, min(event_id) FILTER (event_type = 'purchase') AS a, CASE WHEN user_id % 10 <> 0 THEN max(event_id) FILTER (event_type = 'click') END AS b FROM events GROUP BY user_id)"


@query("h11_ref_ranges", sql=f"WITH {ENDS}, x AS (SELECT r.request, ea.event_id AS a, eb.event_id AS b, ea.n AS na, eb.n AS nb FROM r LEFT JOIN e ea ON ea.event_id = r.a LEFT JOIN e eb ON eb.event_id = r.b) SELECT request, CASE WHEN a IS NULL OR b IS NULL THEN 'not_found' WHEN a > b THEN 'empty_range' ELSE 'ok' END AS state, CASE WHEN a <= b THEN a END AS first, CASE WHEN a <= b THEN b END AS last, CASE WHEN a <= b THEN nb - na + 1 END AS inside FROM x")
def h11_refs(spark, sf):
    """From each user's first purchase to the last click, named by their hashes; other users' commits between belong to the range."""
    e = table(spark, sf, "events")
    named = lambda c: F.sha2(c.cast("string"), 256)
    at = lambda f, kind: f(F.when(F.col("event_type") == kind, F.col("event_id")))
    wanted = e.groupBy(F.col("user_id").alias("request")).agg(at(F.min, "purchase").alias("a"), at(F.max, "click").alias("b"))
    wanted = wanted.select("request", F.coalesce(named(F.col("a")), F.lit("?")).alias("from"), F.when(F.col("request") % 10 == 0, "nothing").otherwise(F.coalesce(named(F.col("b")), F.lit("?"))).alias("to"))
    return Br.ref_ranges(e.select(F.col("event_id").alias("pos"), named(F.col("event_id")).alias("ref")), wanted)


RAW = "WITH m AS (SELECT * FROM events WHERE event_type <> 'error' AND contains(props, '1'))"


@query("h20_history_raw_page", sql=f"{RAW} SELECT event_id, user_id, 3 AS page, greatest(1, ceil((SELECT count(*) FROM m) / 50))::INT AS pages, (SELECT count(*) FROM m)::INT AS total FROM m ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def h20_raw(spark, sf):
    """Commits that match, each for itself, newest first: the third page."""
    m = table(spark, sf, "events").where((F.col("event_type") != "error") & F.contains("props", F.lit("1")))
    return H.page_of(m, 50, 3, F.desc("event_id")).select("event_id", "user_id", "page", "pages", "total")


FINISH = r"""WITH c AS (SELECT user_id % 20 AS s, 'f' || CASE WHEN (props->>'$.k')::INT % 7 = 0 THEN ' ' WHEN (props->>'$.k')::INT % 5 = 0 THEN '''' ELSE '-' END || (props->>'$.k') AS file, event_id AS pos, event_type AS t FROM events),
f AS (SELECT s, file, min(pos) AS first, arg_max(t, pos) AS t FROM c GROUP BY ALL),
p AS (SELECT s, string_agg(CASE WHEN regexp_matches(file, '^[A-Za-z0-9_./@%+=:,-]+$') THEN file ELSE '''' || replace(file, '''', '''\''''') || '''' END || ' ', '' ORDER BY first) FILTER (t <> 'error') AS files, bool_or(file = 'f-1') AS open FROM f GROUP BY s),
t AS (SELECT n_nationkey AS k, 'T-' || n_nationkey AS ticket, 'S' || n_nationkey AS session, trim(n_name) || ' is done' || CASE WHEN n_nationkey % 4 = 0 THEN ' (T-' || n_nationkey || ')' ELSE '' END AS line, n_name FROM nation),
m AS (SELECT *, CASE WHEN k % 4 = 0 THEN line ELSE line || ' (' || ticket || ')' END AS message FROM t)
SELECT ticket, CASE WHEN k % 6 = 5 OR k >= 20 THEN 'no_session' WHEN open THEN 'pending_edits' END AS code,
  CASE WHEN NOT (k % 6 = 5 OR k >= 20) AND NOT open THEN 'git add -- ' || coalesce(files, '') || 'log.jsonl && git commit -m ''' || message || '''' END AS command,
  CASE WHEN NOT (k % 6 = 5 OR k >= 20) AND NOT open THEN 'Done in ' || session || '; git: "' || message || '" (`git log --grep ' || ticket || '`).' || chr(10) || chr(10) || '**Done.** ' || trim(n_name) || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || '**Not verified.** ' || k ELSE '' END END AS comment
FROM m LEFT JOIN p ON p.s = m.k"""


@query("h21_ticket_finish", sql=FINISH)
def h21_finish(spark, sf):
    """A ticket for each nation: those without a session or with open edits are refused, the others get command and comment."""
    k = F.from_json("props", "k int")["k"]
    name = F.concat(F.lit("f"), F.when(k % 7 == 0, " ").when(k % 5 == 0, "'").otherwise("-"), k.cast("string"))
    c = table(spark, sf, "events").select((F.col("user_id") % 20).alias("session"), name.alias("file"), F.col("event_id").alias("pos"), "event_type")
    touched = c.groupBy("session", "file").agg(F.min("pos").alias("place"), (F.max_by("event_type", "pos") != "error").alias("kept"))
    nation = table(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    active = nation.select(F.col("k").alias("ticket"), F.when((F.col("k") % 6 != 5) & (F.col("k") < 20), F.col("k")).alias("session"))
    done = Se.finished(touched, active, spark.createDataFrame([("f-1",), ("none",)], "file string")).join(nation, F.col("ticket") == F.col("k"))
    ticket, no = F.concat(F.lit("T-"), F.col("k").cast("string")), F.col("k").cast("string")
    subject = F.concat(F.lit("  "), F.trim("n_name"), F.lit(" is \n done"), F.when(F.col("k") % 4 == 0, F.concat(F.lit(" ("), ticket, F.lit(")"))).otherwise(""))
    message = Se.finish_message(subject, ticket)
    comment = Se.finish_comment(F.concat(F.lit("S"), no), message, ticket, F.col("n_name"), not_verified=F.when(F.col("k") % 2 == 0, no), left=F.lit(" "))
    ok = lambda x: F.when(F.col("code").isNull(), x)
    return done.select(ticket.alias("ticket"), "code", ok(Se.finish_command(F.col("files"), message, "log.jsonl")).alias("command"), ok(comment).alias("comment"))
