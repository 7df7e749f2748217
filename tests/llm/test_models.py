import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import code_switch, quality

WORDS = {"aa": ["kalo", "mino", "peka", "solu", "tiva"], "bb": ["strg", "vrchn", "blmt", "krst", "gnz"]}


def docs(spark, n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 40))), lang, "s", 0.5))
    rows += [(1000, None, "aa", "s", 0.1), (1001, "", "aa", "s", 0.1), (1002, "12 !! \n", "bb", "s", 0.1), (1003, "kalo mino", None, "s", 0.1), (None, "krst gnz", None, None, None), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    lengths, k = np.array([3, 1, 4, 2, 0]), 3
    e, a = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k))
    place, active, _ = code_switch.side_by_side(lengths)
    laid = np.empty_like(e)
    laid[place] = e
    both, joint = code_switch.forward_backward(laid, active, a, pairs=True)
    both, want_joint = both[place], np.zeros((k, k))
    for at, n in zip(np.cumsum(lengths) - lengths, lengths):
        want, total, pair = np.zeros((n, k)), 0.0, np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = np.exp(sum(e[at + t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
            for x, y in zip(path, path[1:]):
                pair[x, y] += p
        if n:
            assert np.allclose(both[at : at + n], want / total)
            want_joint += pair / total
    assert np.allclose(joint, want_joint)


def test_languages(spark):
    frame = docs(spark)
    field = code_switch.fit(code_switch.sample_windows(frame, ~code_switch.held_out()))
    got = code_switch.predict(frame, field).collect()
    assert len(got) == frame.count()
    by = {r.doc_id: r for r in got}
    truth = {r.doc_id: r.lang for r in frame.where("doc_id < 1000").collect()}
    assert all(by[i].lang_pred == lang and 0.5 < by[i].score <= 1 for i, lang in truth.items())
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003].lang_pred == "aa" and by[None].lang_pred == "bb"
    switched = code_switch.word_labels(field, "kalo mino peka solu tiva kalo strg, vrchn blmt krst gnz krst")
    assert [lab for _, lab, _ in switched] == ["aa"] * 6 + ["bb"] * 6
    assert code_switch.predict(frame.limit(0), field).count() == 0
    nothing = code_switch.fit(code_switch.sample_windows(frame, F.lit(False)))
    assert {r.lang_pred for r in code_switch.predict(frame, nothing).collect()} == {"und"}


def test_long_text_equals_short_batches(spark):
    field = code_switch.fit(code_switch.sample_windows(docs(spark), F.lit(True)))
    long = WORDS["aa"] * 4000
    assert len(field.distributions([long, ["krst"], []])[0]) == len(long)
    assert np.allclose(field.distributions([long, ["krst"], []])[1], field.distributions([["krst"]])[0])


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = rng.choices(["".join(rng.choices("abcdefg", k=5)) for _ in range(30)] + ["the", "of", "and"] * 8, k=rng.randint(20, 60))
        rows.append((i, " ".join(words if good else [w + "$$$" for w in words]), None, "x"))
        labels += [(i, int(good), "x")] * (i % 4 != 0)
    rows += [(1000, None, "x", "x"), (1001, "", "x", "x"), (1002, "word " * 60_000, "x", "x"), (None, "the of", "x", "x"), rows[0]]
    labels += [(1, None, "x"), (None, 1, "x"), (5000, 1, "x"), (2, 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, predicted string")


def test_quality_on_held_out_rows(judged):
    frame, labels = judged
    got = quality.scored(frame, labels, ~quality.held_out()).collect()
    assert len(got) == frame.count() and all(0 <= r.score <= 1 for r in got)
    bad = {r.doc_id for r in frame.where("text like '%$$$%'").collect()}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([(r.score < 0.3) == (r.doc_id in bad) for r in held]) > 0.98
    assert quality.scored(frame.limit(0), labels, ~quality.held_out()).count() == 0
    assert {r.score for r in quality.scored(frame, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_context_vectors_match_brute_force(judged):
    frame, _ = judged
    places, want = quality.index_places(), np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for r in frame.collect():
        ids = quality.token_buckets(r.text or "") if len(r.text or "") < 10_000 else []
        for i, a in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    want[a, places[ids[j], 0]] += 1
                    want[a, places[ids[j], 1]] -= 1
    assert np.array_equal(quality.context_vectors(frame.where("length(text) < 10000 or text is null")), want)
