import random

import numpy as np
from pyspark.sql import types as T

from lodestone.llm import lsh_forest
from lodestone.llm.lsh_forest import deduplicated, near_duplicates

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("set_id", T.StringType()), T.StructField("source", T.StringType())])


def sets(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(n, len(words))
    return frozenset((k, *words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, n, percent=80):
    """component name (least id reachable) of each row, by every pair."""
    s = [sets(r[1], n) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [r[0] if not s[i] else least.get(find(i)) for i, r in enumerate(rows)], s


def corpus(seed, big=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 6)))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one two three four", "One two\tthree  four"]
    for _ in range(20):
        texts.append(" ".join(word() for _ in range(rng.randint(3, 120))))
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(rng.randint(2, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    base = [word() for _ in range(147)]
    for _ in range(big):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    rows = [(i, t, "x", "s") for i, t in enumerate(texts)]
    rows += [(900 + i, " ".join(base), "x", "s") for i in range(30)] + [rows[20], rows[20], (None, texts[12], "x", None), (None, texts[12], "x", None)]
    rng.shuffle(rows)
    return rows


def test_components_match_every_pair(spark):
    rows = corpus(1)
    for n in (4, 5):
        want, s = brute(rows, n)
        got = near_duplicates(spark.createDataFrame(rows, DOCS), n).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((r[0], len(x), c) for r, c, x in zip(rows, want, s)), key=str)


def test_large_regions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 8)
    monkeypatch.setattr(lsh_forest, "CONFIRM_NODES", 10)
    rows = corpus(2, 120)
    want, _ = brute(rows, 4)
    got = near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((r[0], c) for r, c in zip(rows, want)), key=str)


def test_large_region_of_a_template_family(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 8)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    template, rows = [word() for _ in range(200)], []
    for i in range(300):  # twins at 0.8 or a little more, half alike to all other rows
        own = [word() for _ in range(75)]
        rows += [(2 * i, " ".join(template + own), "x", "s"), (2 * i + 1, " ".join([*template, *own[:47], *(word() for _ in range(28))]), "x", "s")]
    want, _ = brute(rows, 4)
    got = near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect()
    missed = [r.doc_id for r, c in zip(sorted(got), want) if r.component_id != c]
    assert len(set(want)) == 300 and not missed, missed


def test_one_row_of_each_component_stays(spark):
    rows = corpus(3)
    want, s = brute(rows, 5)
    frame = spark.createDataFrame(rows, DOCS)
    kept = deduplicated(frame, 5).collect()
    assert deduplicated(frame, 5).columns == frame.columns
    groups = {c for c, x in zip(want, s) if x}
    assert sorted(r.doc_id for r in kept if sets(r.text, 5)) == sorted(groups)
    assert sum(not sets(r.text, 5) for r in kept) == sum(not x for x in s)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None, "", "")], DOCS)).count() == 1


def test_linked_is_exact():
    rng = np.random.default_rng(1)
    sets_ = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    root = lsh_forest.linked(sets_, 60)
    for i in range(40):
        for j in range(40):
            c = len(np.intersect1d(sets_[i], sets_[j]))
            if 100 * c >= 60 * (len(sets_[i]) + len(sets_[j]) - c):
                assert root[i] == root[j]
