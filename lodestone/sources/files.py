"""Files: folder scans with reject buckets, pages with their metadata, PDF runs, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES, MOST_JSON_BYTES = 1 << 20, 1 << 16
# fixed values: folders of code that is not one's own, names and name endings of generated files, media types of whole names
VENDORED = ("node_modules", "vendor", "third_party", "third-party", "bower_components", "__pycache__", "venv", "site-packages")
GENERATED_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "go.sum", "poetry.lock", "composer.lock", "Gemfile.lock", "Pipfile.lock")
GENERATED_SUFFIXES = (".min.js", ".min.mjs", ".min.css", ".bundle.js", ".pb.go", "_pb2.py", ".pb.h", ".pb.cc", ".g.dart", ".designer.cs")
WHOLE_NAMES = {"Makefile": "text/x-makefile", "makefile": "text/x-makefile", "GNUmakefile": "text/x-makefile", "Dockerfile": "text/x-dockerfile", "CMakeLists.txt": "text/x-cmake", "README": "text/plain", "CHANGELOG": "text/plain", "CONTRIBUTING": "text/plain"}
GENERATED_TEXT = r"(?i)generated by|do not edit|@generated"
EXTENSIONS = {"md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "txt": "text/plain", "py": "text/x-python", "c": "text/x-c", "h": "text/x-c", "go": "text/x-go", "rs": "text/x-rust", "ts": "text/typescript", "tsx": "text/typescript", "js": "text/javascript", "json": "application/json"}
BATCH = "id string, path string, title string, text string, mime string, collection string, meta string"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_bucket(path: Column) -> Column:
    """``hidden`` or ``vendored`` if a folder of the path (or, hidden, the file) is; else null."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.when(F.exists(F.split(path, "/"), lambda s: s.startswith(".")), "hidden").when(F.exists(folders, lambda s: s.isin(*VENDORED)), "vendored")


def is_generated_name(path: Column) -> Column:
    name = name_of(path)
    ends = F.lit(False)
    for s in GENERATED_SUFFIXES:
        ends = ends | name.endswith(s)
    return name.isin(*GENERATED_NAMES) | ends


def mime_of(path: Column, text: Column) -> Column:
    """By the whole name or the extension, as written; else by how the text begins."""
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    whole, known = of(WHOLE_NAMES)[name_of(path)], of(EXTENSIONS)
    headings = F.regexp_count(text, F.lit(r"(?m)^#{2,6} "))
    sniffed = F.when(text.rlike(r"(?i)^\s*(<!doctype html|<html)"), "text/html").when(text.rlike(r"^\s*#{1,6} ") | (headings >= 2), "text/markdown").otherwise("text/plain")
    return F.coalesce(whole, known[F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)], sniffed)


def bucket_of(path: Column, size: Column, content: Column) -> Column:
    """Why a file is not taken, tested in this order; null if it is taken."""
    text = content.cast("string")
    head = F.concat_ws("\n", F.slice(F.split(text, "\n"), 1, 5))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return (
        F.when(folder_bucket(path).isNotNull(), folder_bucket(path))
        .when(~extension.isin(*EXTENSIONS) & ~name_of(path).isin(*WHOLE_NAMES) & ~is_generated_name(path), "other_type")
        .when(is_generated_name(path), "generated_name")
        .when(content.isNull(), "unreadable")
        .when(size > F.when(extension == "json", MOST_JSON_BYTES).otherwise(MOST_BYTES), "large")
        .when((size == 0) | ~F.is_valid_utf8(text) | F.contains(text, F.lit("\x00")), "binary_or_empty")
        .when(head.rlike(GENERATED_TEXT), "generated_text")
    )


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mime, bucket, text of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.substr(F.col("path"), F.instr("path", base) + F.length(base))
    rows = files.select(path.alias("path"), F.col("length").alias("size"), "content")
    text = F.col("content").cast("string")
    return rows.select("path", "size", mime_of(F.col("path"), text).alias("mime"), bucket_of(F.col("path"), F.col("size"), F.col("content")).alias("bucket"), text.alias("text"))


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Documents to file, one JSON object a line, all or none: fails if any line is no document."""
    rows = spark.read.schema(BATCH + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    problem = F.when(F.col("_bad").isNotNull(), "bad_json").when(F.coalesce(F.col("path"), F.lit("")) == "", "no_path").when(F.col("text").isNull(), "no_text")
    return rows.withColumn("_ok", F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("batch_refused: "), problem))).otherwise(F.lit(True))).where("_ok").drop("_ok", "_bad")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """id, title, description, keywords, createdAt, updatedAt, bytes, newest first; unreadable metadata is left out."""
    schema = "id string, title string, description string, keywords array<string>, createdAt string, updatedAt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/meta.json").withColumn("bytes", F.col("_metadata.file_size"))
    return rows.where("id is not null").orderBy(F.desc("updatedAt"), F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long").desc())


def page_list(spark: SparkSession, root: str) -> DataFrame:
    """id, title, description, keywords, createdAt, updatedAt, bytes, problem of every page folder; ``bytes`` is the page's own size.

    A folder is listed where its metadata can be read, names the folder and has a title of text, and the page is
    there; else ``problem`` says why it is not, in this order: unreadable, other_id, no_title, no_page. Fields of
    another type than text are empty; a page never updated has the time it was made. One bad folder hides no other.
    """
    of = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder")
    meta = spark.read.option("wholetext", True).text(f"{root}/*/meta.json").select(of, F.try_parse_json("value").alias("_m"))
    sizes = spark.read.format("binaryFile").load(f"{root}/*/page.html").select(of, F.col("length").alias("bytes"))  # names and sizes alone, not contents
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("_m", f"$.{k}", "variant")), F.lit(""))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("_m", f"$.{k}", "string")).otherwise("")
    words = F.filter(F.coalesce(F.try_variant_get("_m", "$.keywords", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    rows = meta.join(sizes, "folder", "left").select("folder", "bytes", text("id").alias("id"), text("title").alias("title"), text("description").alias("description"), F.transform(words, lambda x: F.try_variant_get(x, "$", "string")).alias("keywords"), text("createdAt").alias("createdAt"), text("updatedAt").alias("updatedAt"), (F.coalesce(F.schema_of_variant("_m"), F.lit("")).startswith("OBJECT")).alias("_ok"), (kind("title") == "STRING").alias("_titled"))
    problem = F.when(~F.col("_ok"), "unreadable").when(F.col("id") != F.col("folder"), "other_id").when(~F.col("_titled"), "no_title").when(F.col("bytes").isNull(), "no_page")
    return rows.select("folder", "title", "description", "keywords", "createdAt", F.when(F.col("updatedAt") == "", F.col("createdAt")).otherwise(F.col("updatedAt")).alias("updatedAt"), "bytes", problem.alias("problem")).withColumnRenamed("folder", "id")


def pdf_paragraphs(runs: DataFrame, by: list[str], pos: str) -> DataFrame:
    """by, text: text runs (x, y, h, text) to lines and paragraphs.

    A run begins a line where the baseline moves by more than max(1, h / 2), and a paragraph where a
    line's gap is over 1.3 times the page's lower median gap.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    dy = F.abs(F.lag("y").over(w) - F.col("y"))
    rows = runs.withColumn("_dy", dy).withColumn("_new", F.coalesce((F.col("_dy") > F.greatest(F.lit(1.0), F.col("h") / 2)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_line", F.sum("_new").over(w))
    lines = rows.groupBy(*by, "_line").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda r: r["text"])).alias("line"), F.first("y").alias("y"))
    wl = Window.partitionBy(*by).orderBy("_line")
    lines = lines.withColumn("_gap", F.abs(F.lag("y").over(wl) - F.col("y")))
    typical = lines.where("_gap is not null").groupBy(*by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _gap)").alias("_typical"))
    lines = lines.join(typical, by, "left").withColumn("_sep", F.when(F.col("_gap").isNull(), "").when(F.col("_gap") > 1.3 * F.col("_typical"), "\n\n").otherwise("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("_line", F.concat("_sep", F.trim("line")).alias("t"))))
    return lines.groupBy(*by).agg(F.concat_ws("", F.transform(ordered, lambda r: r["t"])).alias("text"))
