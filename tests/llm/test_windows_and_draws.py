"""Rolling windows and resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import target_resampling as T
from lodestone.llm import window_ranks as W


def odd_documents(rng, n):
    word = lambda: "".join(rng.choices("abcdéあ1XY", k=rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 19, 20, 21, 60]))), rng.choice(["en", "de", None]), rng.choice(["hot"] * 4 + ["b", None])) for i in range(n)]
    rows += [(5, None, "fr", "hot"), (6, "", None, "hot"), (None, "no id " * 20, "en", "hot"), (None, "no id " * 20, "en", None), (7, "x" * 3000 + " y" * 30, "en", "b")]
    return rows + [rows[1]] * 30 + [(3, "other words under the same id " * 5, "es", rows[3][3])] * 3


SCHEMA = "doc_id long, text string, lang string, source string, event_s string, length string, n string, block string, stretch string, score string, rank string, lowest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)


def windows_by_hand(rows):
    at = lambda i: None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 10000) // 6)
    out = Counter()
    for doc_id, _, _, source in rows:
        for w in (600, 43200):
            e = at(doc_id)
            seen = [r for r in rows if e is not None and r[0] is not None and r[3] == source and e - w <= at(r[0]) < e]
            lengths = sorted(len(r[1]) for r in seen if r[1] is not None)
            m = len(lengths)
            out[(doc_id, w, e, len(seen), sum(lengths), len({r[2] for r in seen} - {None}), lengths[-(-m // 2) - 1] if m else None, lengths[-(-90 * m // 100) - 1] if m else None)] += 1
    return out


def test_windows_match_brute_force(spark):
    rows = odd_documents(random.Random(3), 500)
    assert Counter(map(tuple, W.document_windows(frame(spark, rows)).collect())) == windows_by_hand(rows)
    assert W.document_windows(frame(spark, rows).limit(0)).count() == 0


def test_negative_and_large_ids(spark):
    rows = [(i, "ab", "en", "s") for i in (-5, -1, 0, 10**15, 10**15 + 7)]
    assert Counter(map(tuple, W.document_windows(frame(spark, rows)).collect())) == windows_by_hand(rows)


def test_persistent_tree_versions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 57):
        values, weights = rng.integers(0, 9, n), rng.integers(0, 3, n)
        tree = W.PersistentTree(values, weights)
        for low in range(n + 1):
            for high in range(low, n + 1):
                held = np.sort(np.repeat(values[low:high], weights[low:high]))
                ask = lambda f, x: f(np.array([low]), np.array([high]), np.array([x]))[0]  # noqa: B023, E731
                assert all(ask(tree.kth, k + 1) == v for k, v in enumerate(held))
                assert all(ask(tree.below, x) == (held < x).sum() for x in (0, 1, 4, 9, 99))


def test_no_driver_and_no_single_task(spark):
    plan = W.document_windows(frame(spark, odd_documents(random.Random(3), 50)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("SinglePartition|Broadcast", plan)


def draw_by_hand(rows, target, percent=25, least=20, buckets=10_000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    features = lambda w: [*w, *[f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]
    hashed = lambda t: [zlib.crc32(x.encode()) % buckets for x in features(words(t))]
    s, t = (Counter(b for x in texts for b in hashed(x)) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    scored = []
    for doc_id, text, *_ in rows:
        f = hashed(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(f), weight, score, len(words(text)) >= least))
    may = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = percent * len(may) // 100
    return Counter([(*x[:4], k if k <= drawn else None) for k, x in enumerate(may, 1)] + [(*x[:4], None) for x in scored if not x[4]])


@pytest.mark.parametrize("rows_a_range", [1, 7, 1000])
def test_draw_matches_brute_force(spark, rows_a_range):
    rows, target = odd_documents(random.Random(8), 300), ["abc あ XY 1 aa", None, "", "bb " * 9]
    got = T.resampled(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), rows_a_range=rows_a_range)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == draw_by_hand(rows, target)


def test_draw_of_nothing(spark):
    rows = odd_documents(random.Random(8), 30)
    docs, none = frame(spark, rows), spark.createDataFrame([], "text string")
    assert T.resampled(docs.limit(0), none).count() == 0
    got = T.resampled(docs, none).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == draw_by_hand(rows, [])
    assert T.resampled(docs, none, percent=0).where("rank is not null").count() == 0
    assert T.resampled(docs, none, percent=100).where("rank is not null").count() == sum(len(re.findall("[^ ]+", r[1] or "")) >= 20 for r in rows)


def test_checksums_of_pairs():
    rng, counter = random.Random(1), T.BucketCounter(10_000)
    for _ in range(200):
        text = " ".join(rng.choice(["Hello", "a", "é日本", "x" * 300, "12", "don't", "y" * 255, "z" * 256]) for _ in range(rng.randint(0, 9)))
        words = text.encode().translate(T.LETTERS).split()
        want = [zlib.crc32(x) % 10_000 for x in [*words, *[a + b" " + b for a, b in zip(words, words[1:], strict=False)]]]
        n, buckets = counter.of(text)
        assert n == len(words) and buckets.tolist() == want


def test_tournament_merges_and_stops():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 9))]
        tree, out, stop = T.Tournament([iter([r[i : i + 3] for i in range(0, len(r), 3)]) for r in runs]), [], rng.randint(1, 60)
        for key in tree:
            out.append(key)
            if len(out) == stop:
                break
        whole = sorted(x for r in runs for x in r)
        assert out == whole[:stop] and sorted(out + list(tree.rest())) == whole
