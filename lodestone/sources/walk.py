"""A folder walked as version control sees it: ignore files carried down, each reject under one reason.

The walk goes level by level; folders that are hidden, ignored or vendored are listed once and not entered.
Folders of a level are listed side by side by tasks, and the rules that hold in a folder are those of its parents
followed by its own ignore file's, carried as a column. Rules are matched by expressions. Files are read last,
and only those that names and sizes let through.

Unlike Spark's own file listing, names that begin with an underscore and empty files are seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.common import bounded, cut, spread
from lodestone.sources.files import VENDORED, bucket_of, mime_of
from lodestone.sources.log_source import _place

IGNORE_FILE = ".gitignore"
RULES = "array<struct<base:string,negate:boolean,dir_only:boolean,anchored:boolean,regex:string>>"
#: An escaped character or a class: what is not translated letter by letter.
TOKEN = r"\\.|\[[!^]?\]?[^\]/]*\]"
ENTRIES_A_BATCH, BYTES_A_BATCH = 10_000, 8 << 20


def glob_regex(pattern: Column) -> Column:
    """A regular expression for a whole path: ``*`` and ``?`` stay inside a segment, ``**`` as a segment is any number of them."""
    marked = F.regexp_replace(F.regexp_replace(pattern, r"(?<=^|/)\*\*/", "\x01"), r"(?<=^|/)\*\*$", "\x02")

    def plain(s: Column) -> Column:
        s = F.regexp_replace(s, r"[.+^$(){}|\[\]&\\]", r"\\$0")
        s = F.regexp_replace(F.regexp_replace(s, r"\*+", "[^/]*"), r"\?", "[^/]")
        return F.replace(F.replace(s, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))

    def token(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"^\[[!^]?(.*)\]$", 1), r"\\(.)", "$1"), r"[\\\[\]&^]", r"\\$0")
        turned = F.exists(F.regexp_extract_all(body, F.lit(r"[^\\]-[^\\]"), F.lit(0)), lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
        kind = F.when(t.rlike(r"^\[[!^]"), "(?!/)[^").otherwise("[")
        return F.when(t.startswith("\\"), F.concat(F.lit("\\Q"), F.substring(t, 2, 1), F.lit("\\E"))).when(turned, "(?!)").otherwise(F.concat(kind, body, F.lit("]")))

    between, tokens = F.split(marked, TOKEN), F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))
    parts = F.zip_with(between, tokens, lambda s, t: F.concat(plain(s), F.coalesce(token(t), F.lit(""))))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(parts, ""), F.lit(r"\z"))


def rules_of(base: Column, text: Column) -> Column:
    """Rules of an ignore file in the folder ``base``, in order."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(F.regexp_replace(s, r"\r\z", ""), r"(?<!\\) +\z", ""))
    lines = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))

    def rule(s: Column) -> Column:
        bare = F.regexp_replace(s, r"\A!", "")
        inner = F.regexp_replace(bare, r"/\z", "")
        pattern = F.regexp_replace(inner, r"\A/", "")
        return F.struct(base.alias("base"), s.startswith("!").alias("negate"), bare.endswith("/").alias("dir_only"), F.contains(inner, F.lit("/")).alias("anchored"), F.when(pattern != "", glob_regex(pattern)).alias("regex"))

    return F.filter(F.transform(lines, rule), lambda r: r["regex"].isNotNull()).cast(RULES)


def is_ignored(path: Column, is_dir: Column, rules: Column) -> Column:
    """The last rule that matches decides."""
    name = F.regexp_extract(path, r"[^/]*\z", 0)

    def step(ignored: Column, r: Column) -> Column:
        relative = F.when(r["base"] == "", path).when(F.startswith(path, F.concat(r["base"], F.lit("/"))), F.substr(path, F.length(r["base"]) + 2))
        hit = (is_dir | ~r["dir_only"]) & relative.isNotNull() & F.regexp_like(F.when(r["anchored"], relative).otherwise(name), r["regex"])
        return F.when(F.coalesce(hit, F.lit(False)), ~r["negate"]).otherwise(ignored)

    return F.aggregate(rules, F.lit(False), step)


def _listed(root: str):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, top = _place(root)
        for batch in batches:
            for folder in batch["dir"]:
                place = f"{top}/{folder}".rstrip("/")
                found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
                for i in range(0, len(found), ENTRIES_A_BATCH):
                    rows = []
                    for f in found[i : i + ENTRIES_A_BATCH]:
                        own = None
                        if f.base_name == IGNORE_FILE and f.is_file:
                            with system.open_input_stream(f.path) as s:
                                own = s.read().decode("utf-8", "replace")
                        rows.append((folder, f.base_name, f.type == fs.FileType.Directory, f.size or 0, own))
                    yield pd.DataFrame(rows, columns=["dir", "name", "is_dir", "size", "own"])

    return task


def _contents(root: str):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _place(root)
        rows, held = [], 0
        for batch in batches:
            for path, size in zip(batch["path"], batch["size"], strict=True):
                try:
                    with system.open_input_stream(f"{top}/{path}") as s:
                        content = s.read()
                except OSError:
                    content = None
                rows.append((path, size, content))
                held += len(content or b"")
                if held > BYTES_A_BATCH:
                    yield pd.DataFrame(rows, columns=["path", "size", "content"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "size", "content"])

    return task


def entries(spark: SparkSession, root: str) -> DataFrame:
    """path, is_dir, size, bucket of all files met and of the folders that were not entered; bucket is hidden, ignored, vendored or null."""
    level = spark.createDataFrame([("",)], "dir string").withColumn("rules", F.array().cast(RULES))
    out = None
    while True:
        listed = cut(spread(level.select("dir")).mapInPandas(_listed(root), "dir string, name string, is_dir boolean, size long, own string"))
        own = listed.where(F.col("own").isNotNull()).select("dir", rules_of(F.col("dir"), F.col("own")).alias("_own"))
        known = level.join(own, "dir", "left").select("dir", F.when(F.col("_own").isNull(), F.col("rules")).otherwise(F.concat("rules", "_own")).alias("rules"))
        met = listed.join(bounded(known), "dir").withColumn("path", F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name")))
        bucket = F.when(F.startswith("name", F.lit(".")), "hidden").when(is_ignored(F.col("path"), F.col("is_dir"), F.col("rules")), "ignored").when(F.col("is_dir") & F.col("name").isin(*VENDORED), "vendored")
        met = cut(met.withColumn("bucket", bucket).select("path", "is_dir", "size", "bucket", F.when(F.col("is_dir"), F.col("rules")).alias("rules")))
        done = met.where("not is_dir or bucket is not null").drop("rules")
        out = done if out is None else out.unionByName(done)
        level = met.where("is_dir and bucket is null").select(F.col("path").alias("dir"), "rules")
        if level.isEmpty():
            return out


def walked(spark: SparkSession, root: str) -> DataFrame:
    """path, size, bucket, mime, text: files below ``root`` that are taken (bucket null, with text), and each reject with its reason."""
    found = entries(spark, root)
    first = F.coalesce("bucket", bucket_of(F.col("path"), F.col("size"), F.lit(b"x")))
    found = found.withColumn("bucket", first)
    read = spread(found.where("bucket is null").select("path", "size")).mapInPandas(_contents(root), "path string, size long, content binary")
    text, why = F.col("content").cast("string"), bucket_of(F.col("path"), F.col("size"), F.col("content"))
    judged = read.select("path", "size", why.alias("bucket"), F.when(why.isNull(), mime_of(F.col("path"), text)).alias("mime"), F.when(why.isNull(), text).alias("text"))
    none = F.lit(None).cast("string")
    return judged.unionByName(found.where("bucket is not null").select("path", F.when(~F.col("is_dir"), F.col("size")).alias("size"), "bucket", none.alias("mime"), none.alias("text")))
