"""An index of segments finds what a search over the living texts finds, whatever came, went or was revised."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators import segments as G

FIELDS = {"text": 1}
WORDS = "red fox dog blue tree house of the and on".split()


def frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def rows(df):
    return sorted((r["query"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "red fox"), (1, "the"), (2, "absent"), (3, None), (4, "tree house of the dog")], "query long, text string")


def same(spark, path, texts, queries):
    docs = frame(spark, texts)
    assert rows(G.search(spark, path, "doc_id", queries)) == rows(R.bm25(docs, "doc_id", FIELDS, queries))
    segments = G.manifest(spark, path)
    stats = R.corpus_stats(docs, "doc_id", FIELDS).first()
    assert sum(s.n - s.gone_n for s in segments) == stats.n and sum(s.total - s.gone_total for s in segments) == (stats.total_len or 0)


def test_add_revise_forget_merge(spark, tmp_path, queries):
    rng, path, texts = random.Random(7), f"{tmp_path}/index", {}
    text = lambda: rng.choice([None, ""] + [" ".join(rng.choices(WORDS, k=rng.randint(1, 12)))] * 6)
    texts = {i: text() for i in range(30)}
    assert G.sync(frame(spark, texts), "doc_id", FIELDS, path, merging=False) == {"added": 30, "revised": 0, "forgotten": 0}
    same(spark, path, texts, queries)
    assert G.sync(frame(spark, texts), "doc_id", FIELDS, path) == {"added": 0, "revised": 0, "forgotten": 0}
    for step in range(3):
        for i in rng.sample(sorted(texts), 6):
            texts[i] = f"{text()} changed {step}"
        for i in rng.sample(sorted(texts), 3):
            del texts[i]
        texts |= {100 * step + k + 50: text() for k in range(4)}
        G.sync(frame(spark, texts), "doc_id", FIELDS, path, merging=False)
        same(spark, path, texts, queries)
    assert len(G.manifest(spark, path)) == 4
    assert G.merge(spark, path, 2) == 3  # tombstones about the first two stay
    same(spark, path, texts, queries)
    gone = sorted(texts)[:5]
    assert G.forget(spark, path, spark.createDataFrame([(i,) for i in [*gone, 999]], "key long")) == 5
    texts = {i: t for i, t in texts.items() if i not in gone}
    same(spark, path, texts, queries)
    texts[gone[0]] = "red again"  # one that was forgotten comes back
    G.sync(frame(spark, texts), "doc_id", FIELDS, path, merging=False)
    same(spark, path, texts, queries)
    assert G.merge(spark, path) == 1 and not G.manifest(spark, path)[0].gone_n
    same(spark, path, texts, queries)
    assert G.drop_unlisted(spark, path) > 3
    same(spark, path, texts, queries)


def test_tails_are_merged(spark, tmp_path, queries):
    path, texts = f"{tmp_path}/index", {}
    for k in range(5):
        texts |= {10 * k + j: f"red fox {j}" for j in range(4)}
        G.sync(frame(spark, texts), "doc_id", FIELDS, path)
        same(spark, path, texts, queries)
    assert len(G.manifest(spark, path)) <= 3


def test_empty_and_filtered(spark, tmp_path, queries):
    path = f"{tmp_path}/index"
    assert G.documents(spark, path) is None and G.forget(spark, path, spark.createDataFrame([(1,)], "key long")) == 0
    with pytest.raises(ValueError):
        G.search(spark, path, "doc_id", queries)
    G.sync(frame(spark, {1: "red"}).limit(0), "doc_id", FIELDS, path)
    assert G.search(spark, path, "doc_id", queries).count() == 0
    texts = {1: "red fox", 2: "red", 3: "fox fox"}
    G.sync(frame(spark, texts), "doc_id", FIELDS, path, version=F.lit(1))
    kept = spark.createDataFrame([(1,)], "doc_id long")
    assert {r[1] for r in rows(G.search(spark, path, "doc_id", queries, keep=kept))} == {1}
    assert G.sync(frame(spark, texts), "doc_id", FIELDS, path, version=F.lit(2))["revised"] == 3
    same(spark, path, texts, queries)


def test_a_change_that_was_broken_off_leaves_the_index(spark, tmp_path, queries, monkeypatch):
    path, texts = f"{tmp_path}/index", {1: "red fox", 2: "the dog"}
    G.sync(frame(spark, texts), "doc_id", FIELDS, path)

    def fails(*_):
        raise OSError("no more room")

    with monkeypatch.context() as m:
        m.setattr(G, "_publish", fails)
        with pytest.raises(OSError):
            G.sync(frame(spark, texts | {3: "red"}), "doc_id", FIELDS, path)
    same(spark, path, texts, queries)


def test_postings_stay_out_of_checkpoints(spark, tmp_path, monkeypatch):
    """What a change leaves on disk is its segment: no checkpoint of postings, no working table."""
    seen, path = [], f"{tmp_path}/index"
    kept = G.cut
    monkeypatch.setattr(G, "cut", lambda df: seen.append(df.columns) or kept(df))
    for texts in ({i: f"red fox {i}" for i in range(20)}, {i: f"blue dog {i}" for i in range(10, 30)}):
        G.sync(frame(spark, texts), "doc_id", FIELDS, path)
    assert seen and not any("term" in columns for columns in seen)
    assert not list((tmp_path / "index" / "work").iterdir())
