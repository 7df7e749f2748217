"""Clashing column names, empty tables, repeats and extreme values through stages and operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.quality import BUCKETS, POOLED_AT_ONCE, TOKENS_AT_ONCE, _in_runs, fit, pooled
from lodestone.llm.threshold_topk import exact_topk

ODD = ["_id", "_hash", "_size", "_text_hash", "_row", "_copies", "gone_id_", "gone_hash_", "text_hash_", "id_", "repeated_", "key", "set_id", "row", "label", "score", "_label", "item_id", "shift"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("odd")), random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    item = " ".join(word() for _ in range(15))
    texts = [" ".join([*(word() for _ in range(30)), *([] if i % 9 else item.split()), *(["$$$"] * 20 if i % 4 == 0 else [])]) for i in range(60)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[1], "en", "a", 1), (101, None, "en", None, 0), (None, texts[2], "en", "a", 1), (102, "", "en", "b", 0), rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_columns_and_without_rows(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.select("*", *[F.lit("x").alias(c) for c in ODD])
    plain, wide = stage(spark, docs, tables), stage(spark, odd, tables)
    key = lambda df: Counter((r.doc_id, r.text if name != "sharding" else r.shard, r.source) for r in df.collect())
    assert key(plain) == key(wide)
    if name != "sharding":
        assert plain.columns == docs.columns and wide.columns == odd.columns
    assert stage(spark, docs.limit(0), tables).count() == 0


def brute(vectors, k=5):
    whole = lambda v: [max(-(1 << 63), min((1 << 63) - 1, int(256 * x // 1))) for x in v]
    usable = [(i, whole(v)) for i, v in vectors if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = Counter()
    for q in {i for i, _ in usable if i % 50 == 0}:
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for i, v in usable if i == q for j, w in usable if j != q]
        out.update((q, n, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k], 1))
    return out


def test_topk_of_repeats_and_extreme_values(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    vectors += [(50, [1.0, 0.0, 0.0, 0.0]), (7, [1.0] * 4), (7, [1.0] * 4), (8, None), (9, [None, 1.0]), (11, [float("nan")] * 4), (12, []), (13, [0.5])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, _place int").select("*")
    wide = lambda rows: frame([(*r, "x", 1) for r in rows])
    is_query = F.col("vec_id") % 50 == 0
    assert Counter(map(tuple, exact_topk(wide(vectors), is_query).collect())) == brute(vectors)
    huge = vectors[:60] + [(60, [1e30, -1e30, 0.0, 1.0]), (61, [1e300] * 4), (100, [-1e30, 1.0, 1e17, 0.0])]
    assert Counter(map(tuple, exact_topk(wide(huge), is_query).collect())) == brute(huge)
    assert exact_topk(wide(vectors[:1]), is_query).count() == 0


def test_few_labels_and_long_texts_of_the_classifier():
    import numpy as np

    net = fit(np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 1.1], [1.1, 0.0]]), np.array([0, 1, 0, 1]))
    assert net.layers is not None and net(np.array([[1.0, 0.0]]))[0] > net(np.array([[0.0, 1.0]]))[0]
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(BUCKETS, 64)).astype(np.float32)
    ids = rng.integers(0, BUCKETS, TOKENS_AT_ONCE + 5)
    assert np.allclose(pooled([ids[:7], ids], vectors)[1, :-1], vectors[ids].mean(axis=0, dtype=np.float64), atol=1e-6)
    ids = rng.integers(0, BUCKETS, POOLED_AT_ONCE + 1)  # the least text that goes by the counts of its buckets
    assert np.allclose(pooled([ids, ids[:-1]], vectors)[0, :-1], vectors[ids].mean(axis=0, dtype=np.float64), atol=1e-6)


def test_pieces_of_any_size_hold_every_text_once():
    import numpy as np
    import pyarrow as pa

    texts = ["a b c d", None, "", "e " * 50, "f g", "h"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    whole = [h.tolist() for _, _, held in _in_runs(iter([batch]), 0) for h in held]
    for most in (1, 3, 10, 1000):
        pieces = list(_in_runs(iter([batch]), 0, most))
        assert [h.tolist() for _, _, held in pieces for h in held] == whole
        assert [first for _, first, _ in pieces] == np.cumsum([0] + [len(held) for _, _, held in pieces])[:-1].tolist()
