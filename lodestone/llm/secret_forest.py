"""Secret scan with a random forest that removes false findings.

Candidates are runs of 16 and more key characters that mix digits or capitals into their letters.
For each the scan takes length, changes of character class, share of digits, variety of characters,
coverage by a dictionary (the four-letter beginnings of words that occur in the corpus, counted over
all rows), the path it stands in, and the words around it. A forest fitted to labelled findings then
says how likely the candidate is a secret.

The forest is fitted on the driver from at most ``MOST_FINDINGS`` labelled findings and becomes one
expression of comparisons; scanning, features, dictionary and scores are built-in expressions only.
:func:`labelled_findings` makes findings by seeded rules (key formats in contexts that hand out
keys; identifiers, paths, digests, placeholders in contexts that do not); own findings can be given
instead, as rows of value, path, before, after, label.

Candidates are rare, so only they are exploded from their texts. The dictionary is bounded by the
number of four-letter strings that words begin with, pre-aggregated before its shuffle.

Defined cases: null and empty texts have no candidates; a null path counts as an ordinary one; a
null ``doc_id`` is kept; a candidate may have any length, and costs time in proportion to it; repeated rows and repeated values each give their row; ties of the
forest's mean at the threshold count as secret. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, small_or_shuffled

#: 16 key characters and all that follow them; a hyphen counts unless another follows. The run is taken without going back,
#: so that a match needs no stack, whatever its length.
CANDIDATE = r"(?=(?:[A-Za-z0-9+/_]|-(?!-)){16})[A-Za-z0-9+/_]*+(?:-(?!-)[A-Za-z0-9+/_]*+)*+={0,2}"
MIXED = r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"
#: Fixed word lists of the context features.
GIVES_KEYS = r"(?i)(token|secret|passw|pwd|api.?key|auth|credential|bearer|private|access.?key)"
GIVES_OTHERS = r"(?i)(sha|commit|hash|uuid|guid|checksum|digest|example|version|image|http|www|file|path|build|etag)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|vendor|docs?/|\.md$|lock$)"
PLACEHOLDER = r"(?i)(x{4}|example|sample|changeme|placeholder|your|dummy|1234567|abcdef|0{6})"
FEATURES = ("length", "changes", "digits", "variety", "coverage", "capitals", "hex", "placeholder", "test_path", "keyword", "other_word", "slashes")
KEY_CHARACTERS = string.ascii_letters + string.digits + "+/_-="
#: Bytes of a value whose pieces are looked up as one row.
BLOCK = 4_096
#: A beginning counts if it occurs so often, and so often in this many words, however large the corpus.
LEAST_COUNT, IN_WORDS, PIECE = 3, 1 << 20, 4
TREES, DEPTH, LEAST_LEAF, MOST_FINDINGS = 15, 5, 5, 4_000
THRESHOLD = 0.5

_FINDING = "array<struct<value:string,path:string,before:string,after:string,label:int>>"


def labelled_findings(spark: SparkSession, n: int = 3_000, seed: int = 9) -> DataFrame:
    """value, path, before, after, label: findings made by rules, half of them secrets."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    word = lambda: "".join(rng.choice(["ta", "re", "on", "mi", "ver", "sion", "con", "fig", "data", "user", "list", "sta", "tus", "ing", "er", "al"]) for _ in range(rng.randint(1, 4)))
    hexes, mixed = string.hexdigits[:16], string.ascii_letters + string.digits
    out = []
    for _ in range(n):
        secret = rng.random() < 0.5
        if secret:
            value = rng.choice([
                lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16),
                lambda: pick(hexes, rng.choice([18, 24, 32, 40, 64])),
                lambda: "ghp_" + pick(mixed, 36),
                lambda: "sk_live_" + pick(mixed, 24),
                lambda: pick(mixed + "+/", rng.choice([20, 32, 40, 44])),
                lambda: pick(string.ascii_uppercase + string.digits, rng.choice([20, 24, 32])),
            ])()
            before = rng.choice(["token =", "password=", "secret:", "api_key", "Authorization: Bearer", "", word(), f"{word()} {word()}"])
            path = rng.choice(["src/app.py", "config/prod.yml", "deploy.env", None, "web"])
        else:
            value = rng.choice([
                lambda: word() + word().title() + word().title() + word().title() + word().title(),
                lambda: "/".join([word() for _ in range(3)] + [f"{word()}{rng.randint(1, 99)}"]) + "/index",
                lambda: "_".join([word(), word(), word(), str(rng.randint(1, 2030))]) + word(),
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
                lambda: "x" * rng.randint(12, 20) + str(rng.randint(1000, 9999)),
                lambda: "your-api-key-" + word() + "-1234567",
                lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
                lambda: pick(hexes, 40),
                lambda: pick(string.digits, rng.choice([16, 19])),
                lambda: word().upper() + "_" + word().upper() + "_" + word() + str(rng.randint(1, 9)),
            ])()
            opaque = all(c in hexes + "-" for c in value)
            before = rng.choice(["commit", "sha256:", "uuid =", "checksum", "etag", "file hash"] if opaque else ["", word(), "import", "see", "version", f"{word()} {word()}", "path ="])
            path = rng.choice(["src/app.py", "tests/fixture.json", "docs/readme.md", "package-lock", None, "web"])
        if len(value) >= 16:
            out.append({"value": value, "path": path, "before": before, "after": rng.choice(["", word(), "for"]), "label": int(secret)})
    rows = F.from_json(F.lit(json.dumps(out)), _FINDING)
    return spark.range(1).select(F.inline(rows))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, word, value, before, after of every candidate of every text."""
    words = docs.select("doc_id", F.col(path).cast("string").alias("path"), F.split("text", r"[\x20\x09-\x0D]+").alias("words"))
    mixed = lambda w: (F.length(w) >= 16) & w.rlike(CANDIDATE) & w.rlike(MIXED)
    at = F.filter(F.transform("words", lambda w, i: F.when(mixed(w), i)), lambda i: i.isNotNull())
    near = lambda i, k: F.coalesce(F.get("words", i + k), F.lit(""))
    found = F.transform(at, lambda i: F.struct(i.alias("word"), near(i, 0).alias("whole"), F.concat_ws(" ", near(i, -3), near(i, -2), near(i, -1)).alias("before"), near(i, 1).alias("after")))
    rows = words.select("doc_id", "path", F.explode_outer(found).alias("_c")).where("_c is not null").select("doc_id", "path", "_c.*")
    # key and value in one word, as in password=..., are context and candidate
    values = F.filter(F.regexp_extract_all("whole", F.lit(CANDIDATE), F.lit(0)), lambda v: v.rlike(MIXED))
    head = F.regexp_extract("whole", rf"^(.*?){CANDIDATE}", 1)
    rows = rows.select("doc_id", "path", "word", F.concat_ws(" ", "before", head).alias("before"), "after", values.alias("values"))
    return rows.select("doc_id", "path", "word", F.explode_outer("values").alias("value"), "before", "after").where("value is not null")


def dictionary(docs: DataFrame) -> DataFrame:
    """The four-letter beginnings of words, lower-cased, that all texts hold at least ``LEAST_COUNT`` times, and as often in ``IN_WORDS`` words."""
    begins = F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{PIECE}}}"), F.lit(0)))
    counts = cut(docs.select(begins.alias("piece")).where("piece is not null").groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    words = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(LEAST_COUNT, LEAST_COUNT * words / IN_WORDS)).select("piece")


def with_features(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """``found`` (value, path, before, after, ...) with the columns of ``FEATURES``."""
    v = F.col("value")
    # values are named by their digest, and cut into blocks, so that no row carries a long value once for each of its places
    name = lambda c: F.sha2(c.cast("binary"), 256)
    raw = F.col("value").cast("binary")
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("value") - PIECE + 1, F.lit(1)), F.lit(BLOCK))
    blocks = found.select("value").distinct().select(name(v).alias("_value"), F.explode(F.transform(starts, lambda i: F.substr(raw, i, F.lit(BLOCK + PIECE - 1)))).alias("_block"))
    places = F.sequence(F.lit(1), F.greatest(F.octet_length("_block") - PIECE + 1, F.lit(1)))
    parts = blocks.select("_value", F.explode(F.transform(places, lambda i: F.lower(F.substr(F.col("_block"), i, F.lit(PIECE)).cast("string")))).alias("_piece"))
    known = parts.join(small_or_shuffled(pieces), F.col("_piece") == F.col("piece"), "left")
    coverage = known.groupBy("_value").agg(F.avg(F.col("piece").isNotNull().cast("int")).alias("coverage"))
    size = F.length("value").cast("double")
    flag = lambda c: c.cast("double")
    of = lambda letters: (F.length(v) - F.length(F.translate(v, letters, ""))) / size
    changes = F.length(v) - F.length(F.regexp_replace(v, r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])", ""))
    return found.join(small_or_shuffled(cut(coverage)), name(v) == F.col("_value")).drop("_value").withColumns({
        "length": size,
        "changes": changes / size,
        "digits": of(string.digits),
        "variety": sum((F.contains(v, F.lit(c)).cast("int") for c in KEY_CHARACTERS), F.lit(0)) / size,
        "capitals": of(string.ascii_uppercase),
        "hex": flag(v.rlike("^[0-9a-fA-F-]+$")),
        "placeholder": flag(v.rlike(PLACEHOLDER)),
        "test_path": flag(F.coalesce(F.col("path"), F.lit("")).rlike(TEST_PATH)),
        "keyword": flag(F.col("before").rlike(GIVES_KEYS)),
        "other_word": flag(F.concat_ws(" ", "before", "after").rlike(GIVES_OTHERS)),
        "slashes": of("/_-"),
    })


def fit_forest(x: np.ndarray, y: np.ndarray, seed: int = 4) -> list:
    """Trees as nested (feature, limit, left, right), leaves as shares of secrets; bootstrap rows and a third of the features at each split."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, depth: int):
        labels = y[rows]
        share = float(labels.mean())
        if depth == DEPTH or share in (0.0, 1.0) or len(rows) < 2 * LEAST_LEAF:
            return round(share, 6)
        best = None
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
            impurity = n * p * (1 - p) + (len(order) - n) * q * (1 - q)
            impurity[(values[1:] == values[:-1]) | (n < LEAST_LEAF) | (len(order) - n < LEAST_LEAF)] = np.inf
            i = int(impurity.argmin())
            if np.isfinite(impurity[i]) and (best is None or impurity[i] < best[0]):
                best = (impurity[i], int(f), float((values[i] + values[i + 1]) / 2))
        if best is None:
            return round(share, 6)
        _, f, limit = best
        left = x[rows, f] <= limit
        return (f, limit, grow(rows[left], depth + 1), grow(rows[~left], depth + 1))

    return [grow(rng.integers(0, len(y), len(y)), 0) for _ in range(TREES)]


def forest_score(trees: list) -> Column:
    """The mean of the trees as one expression."""

    def of(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, limit, left, right = node
        return F.when(F.col(FEATURES[f]) <= limit, of(left)).otherwise(of(right))

    return F.round(F.aggregate(F.array(*map(of, trees)), F.lit(0.0), lambda a, b: a + b) / len(trees), 6)


def fitted(findings: DataFrame, pieces: DataFrame) -> list:
    rows = with_features(findings.limit(MOST_FINDINGS), pieces).select("label", *FEATURES).collect()  # bounded by the limit
    if not rows:
        return [0.5]
    rows = np.array(sorted(map(tuple, rows)), dtype=float)
    return fit_forest(rows[:, 1:], rows[:, 0])


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, word (its number in the text), value, before, after, score, is_secret of every candidate."""
    pieces = cut(dictionary(docs))
    trees = fitted(labelled_findings(docs.sparkSession) if findings is None else findings, pieces)
    found = with_features(cut(candidates(docs, path)), pieces).withColumn("score", forest_score(trees))
    return found.select("doc_id", "path", "word", "value", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))


def op2(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "word", "value", "score", "is_secret")
