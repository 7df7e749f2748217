import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.mixing import mix_plan, mixed, source_targets
from lodestone.llm.sharding import assign_shards
from lodestone.llm.threshold_topk import exact_topk
from lodestone.llm.token_counts import counter, token_counts

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("shard", T.StringType())])


def documents(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i if rng.random() > 0.02 else None, None if rng.random() < 0.05 else " ".join(rng.choices("aé b\tcc ddd '' ,", k=rng.randint(0, 30))), "en", rng.choice(["hot"] * 5 + ["s1", "s2", None, "é"]), "x", "y") for i in range(n)]
    return rows + rows[:3]


def test_shards_match_brute_force(spark):
    rows = documents(spark, 500)
    got = assign_shards(spark.createDataFrame(rows, DOCS), 7).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in rows:
        body = (r[1] or "").encode()
        crc, size = zlib.crc32(body), len(body) + 16
        by[r[3]].append((md5(f"interleave:{'' if r[0] is None else r[0]}:{crc}:{size}".encode()).hexdigest(), crc, size, r[0]))
    order = sorted(((2 * k + 1) / (2 * len(v)), s is None, s or "", 2 * k + 1, x) for s, v in by.items() for k, x in enumerate(sorted(v, key=lambda x: x[:3])))
    want = Counter((x[3], x[2], x[1], p * 7 // len(order), p - -(-(p * 7 // len(order)) * len(order) // 7)) for p, (*_, x) in enumerate(order))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.values()) <= 1
    mix = Counter((r.shard, r.source) for r in got)
    for s, v in by.items():
        assert all(abs(mix[k, s] - len(v) / 7) <= 2 for k in range(7))


def test_shards_of_nothing(spark):
    assert assign_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_targets_are_water_filled(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 0), ("d", 50)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    # weights a 5, b 2, c 1, d 5, null 2; limits 30, 3000, 3, 150, 0: a, c, d and null stop, b takes the rest
    assert got == {"a": 30.0, "c": 3.0, "d": 150.0, None: 0.0, "b": 1061 - 183.0}


def test_mix_repeats_by_rate(spark):
    rows = documents(spark, 900, 2)
    frame = spark.createDataFrame(rows, DOCS)
    plan = mix_plan(frame, keep=("doc_id", "source")).collect()
    assert all(int(r._rate) <= r._copies <= min(3, int(r._rate) + 1) for r in plan)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in plan:
        by[r.source][0] += r._size * r._copies
        by[r.source][1] += r._size
        by[r.source][2] = r._target
    assert all(abs(t - want) <= 0.3 * s for t, s, want in by.values())
    assert mixed(frame).count() == sum(r._copies for r in plan)
    assert mixed(frame).columns == frame.columns
    assert sorted(map(str, mix_plan(frame).collect())) == sorted(map(str, mix_plan(frame.repartition(3)).collect()))
    assert mix_plan(frame.limit(0)).count() == 0


def test_equal_rows_draw_each_for_itself(spark):
    rows = [(1, "w " * 4, "a", i) for i in range(1000)] + [(i, "w " * 4, "b", i) for i in range(800)] + [(None, None, None, 0)] * 3 + [(None, "w", None, 0)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _part int").repartition(5)
    plan = mix_plan(frame, weights=(7, 9, 1), keep=("doc_id", "source"))
    got = {r["source"]: r for r in plan.groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.first("_target").alias("target"), F.count(F.lit(1)).alias("n")).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 1000, "b": 800, None: 6}
    assert all(abs(got[s].taken - got[s].target) < 0.04 * got[s].target for s in "ab"), got
    draws = lambda f: Counter(tuple(r) for r in mix_plan(f, weights=(7, 9, 1)).collect())
    assert draws(frame) == draws(frame.repartition(2)) == draws(frame.coalesce(1))
    again = mixed(frame, weights=(7, 9, 1))
    assert again.columns == frame.columns and again.where("source = 'a'").count() * 4 == got["a"].taken


def test_topk_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.003, 0.25, rng.uniform(-1, 1)]) for _ in range(6)], "x") for i in range(400)]
    rows += [(1000 + i, [0.25] * 6, "tie") for i in range(40)] + [(2000, None, "n"), (2001, [0.1, None], "n"), (2002, [float("nan")] * 6, "n"), (2003, [float("inf")] * 6, "n"), (None, [0.1] * 6, "n"), (2004, [], "n"), (2005, [3e5, 2.0], "wide")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    import math

    ints = {i: [math.floor(256 * x) for x in v] + [0] * (6 - len(v)) for i, v, k in rows if i is not None and k != "n"}
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = {tuple(r) for r in exact_topk(frame, frame.vec_id % 50 == 0).collect()}
    assert got == want
    assert exact_topk(frame.limit(0), frame.vec_id % 50 == 0).count() == 0
    assert exact_topk(frame.where("vec_id in (50, 51, 52)"), frame.vec_id % 50 == 0).count() == 2


def texts(n):
    rng = random.Random(5)
    alphabet = ["the", " token", "é", "ß", "  ", "\n", "\n\n ", "'re", "'", "don't", "123", " 4", "!!", "***", " <|endoftext|>", "<|endo", "日本", "😀", "　", "_x", "aaaaaaaaaaaaaaaa", "zqxj", " \t"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(n)] + ["", "a" * 5000, " " * 700, "\n" * 90 + "x"]


def test_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    library, own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in texts(400):
        assert own.count(t) == n(t), t
    for t in texts(60)[:60]:
        assert own.prefix_counts(t) == [n(t[:i]) for i in range(len(t) + 1)], t
    long = "the quick brown fox " * 300
    assert n(long[: own.longest_within(long, 100)]) <= 100 < n(long[: own.longest_within(long, 100) + 1])
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts(50))] + [(None, None, "y")], "doc_id long, text string, n_tokens string")
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame).collect()} == {(i, len(t.encode()), n(t), n(t) > 512) for i, t in enumerate(texts(50))} | {(None, 0, 0, False)}
    assert token_counts(frame.limit(0)).count() == 0
