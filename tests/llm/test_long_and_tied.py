"""Operators on very long texts, ties, repeated rows, no rows and clashing column names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import code_switch, html_lines, mixing, quality, secret_forest, sharding, spaced_seeds, token_counts
from lodestone.llm.lsh_forest import near_duplicates
from tests.llm.test_odd_cases import ODD

LONG = 120_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 40))), rng.choice(["a", "b", None])) for i in range(40)]
    long = " ".join(word() for _ in range(LONG))
    key = "token = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows += [(100, long, "a"), (101, long + " more", "b"), (102, "same " * LONG, "a"), (103, None, None), (104, "", "a"), (None, "no number", "b"), (105, f"{long[:5000]} {key}", "a"), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")).cache()


@pytest.fixture(scope="module")
def benchmark(spark, docs):
    long = docs.where("doc_id = 100").first()["text"].split(" ")
    return spark.createDataFrame([(1, " ".join(long[70_000:70_020])), (2, "same " * 30), (3, None), (4, ""), (5, "absent words only " * 5)], "item_id long, text string")


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


def language(d):
    return code_switch.predict(d, code_switch.fit(code_switch.sample_windows(d, F.lit(True))))


OPERATORS = {
    "language": (language, True),
    "secrets": (secret_forest.scan, False),
    "shards": (sharding.assign_shards, True),
    "mix": (mixing.mix_plan, True),
    "near": (near_duplicates, True),
    "tokens": (token_counts.token_counts, True),
    "quality": (lambda d: quality.scored(d, labels(d), F.lit(True)), True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, docs, name):
    operator, every_row = OPERATORS[name]
    rows = lambda df: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    plain = operator(docs)
    got = rows(plain)
    if every_row:
        at = plain.columns.index("doc_id")
        assert Counter(r[at] for r in got.elements()) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert rows(operator(docs.select("*", *[F.lit("x").alias(c) for c in ODD]))) == got
    assert operator(docs.limit(0)).count() == 0


def test_long_texts_are_read_to_their_end(docs, benchmark):
    found = {(r.doc_id, r.item_id): r for r in spaced_seeds.contaminated(docs, benchmark).collect()}
    assert set(found) == {(100, 1), (101, 1), (102, 2)}
    assert found[100, 1].doc_start == 70_000 and found[102, 2].matched == 30
    near = {r.doc_id: r for r in near_duplicates(docs, 4, 80).collect()}
    assert near[100].component_id == near[101].component_id == 100 and near[101].n_shingles > LONG // 2
    assert near[102].n_shingles == 1 and near[104].n_shingles == 0 and near[103].component_id == 103
    assert {r.doc_id: r["_size"] for r in mixing.mix_plan(docs).collect()}[102] == LONG
    assert 105 in {r.doc_id for r in secret_forest.scan(docs).where("is_secret").collect()}


def test_no_benchmark_and_no_documents(docs, benchmark):
    assert spaced_seeds.contaminated(docs, benchmark.limit(0)).count() == 0
    assert spaced_seeds.contaminated(docs.limit(0), benchmark).count() == 0
    assert spaced_seeds.decontaminated(docs, benchmark.limit(0)).count() == docs.count()


def test_equal_sources_take_equal_targets(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a", "f", "k"] * 20)]  # weights 5, 2, 1 by code point
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id", "source"))
    per = {r["source"]: r for r in plan.groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.first("_target").alias("target")).collect()}
    assert [round(per[s]["target"], 6) for s in "afk"] == [375.0, 150.0, 75.0]
    assert all(abs(per[s]["taken"] - per[s]["target"]) <= 60 for s in "afk")


def test_repeated_and_tied_pages(spark):
    html = "<html><body><article><p>" + "alpha beta gamma delta. " * 20 + "</p><p>" + "alpha beta gamma delta. " * 20 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", html, "x"), (1, "u", html, "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    got = html_lines.extracted(pages).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == {(1, 2 * 479 + 1): 2, (2, 0): 1, (None, 0): 1}
    assert html_lines.extracted(pages.limit(0)).count() == 0
