import random
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import quality
from tests.llm.test_lsh_forest import brute, sets
from tests.llm.test_text_operators import brute as leaks


def make(path, spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        good = i % 5 != 0
        words = [word() for _ in range(rng.randint(20, 80))]
        if i % 13 == 1:
            words[5:5] = items[i % 5][1].split()
        if not good:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1))
        labels.append((i, int(good), 0))
    for i in range(40):
        base = rows[rng.choice([1, 2, 3, 4, 6])][1].split()
        if i % 2:
            base[rng.randrange(len(base))] = "zzz"
        rows.append((300 + i, " ".join(base), "en", "a", 1))
    rows += [(1000, None, "en", "a", 0), (None, rows[2][1], "en", "b", 0), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = make(str(tmp_path), spark)
    read = lambda: spark.read.parquet(f"{tmp_path}/documents.parquet")
    f = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
    key = lambda rs: sorted(map(str, (tuple(r) for r in rs)))

    kept = f["quality classifier"](spark, read(), str(tmp_path))
    assert kept.columns == read().columns
    kept = kept.cache()
    scores = quality.scored(read(), spark.read.parquet(f"{tmp_path}/labels.parquet"), F.lit(True)).collect()
    score = {r.doc_id: r.score for r in scores}  # rows of an id have equal texts here
    assert key(kept.collect()) == key(r for r in rows if score[r[0]] >= 0.3)
    assert sum((score[r[0]] >= 0.3) == ("$$$" not in (r[1] or "")) for r in rows) >= 0.95 * len(rows)

    once = f["MinHash near-dedup"](spark, kept, str(tmp_path)).cache()
    left = [tuple(r) for r in kept.collect()]
    names, s = brute(left, 5)
    got = once.collect()
    assert sorted(r.doc_id for r in got if sets(r.text, 5)) == sorted({c for c, x in zip(names, s) if x})
    assert set(map(tuple, got)) <= set(left) and sum(r.text is None for r in got) == 1

    clean = f["benchmark decontamination"](spark, once, str(tmp_path)).cache()
    bad = {d for d, *_ in leaks([(r.doc_id, r.text) for r in got], items)}
    assert len(bad) > 3 and key(clean.collect()) == key(r for r in got if r.doc_id not in bad)

    mixed = f["mixing to target weights"](spark, clean, str(tmp_path)).cache()
    copies, sizes = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: len((r.text or "").split()) for r in clean.collect()}
    of, total = {r.doc_id: r.source for r in clean.collect()}, defaultdict(int)
    for d, n in sizes.items():
        total[of[d]] += n
    weights = dict(zip(sorted(total, key=lambda x: (x is None, x or "")), [5, 2, 1, 5]))
    target, free = {}, set(total)
    while True:
        rest = sum(total.values()) - sum(target.values())
        share = {k: weights[k] * rest / sum(weights[x] for x in free) for k in free}
        over = [k for k in free if share[k] > 3 * total[k]]
        if not over:
            break
        for k in over:
            target[k] = 3.0 * total[k]
            free.discard(k)
    target |= share
    for r in clean.collect():
        rate = target[r.source] / total[r.source]
        u = int(md5(f"mix:{r.doc_id}:{r.text or ''}".encode()).hexdigest()[:8], 16) / 2**32
        assert copies[r.doc_id] == int(rate + 1e-9) + (u < rate - int(rate + 1e-9))

    placed = f["sharding"](spark, mixed, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in placed) == copies
    per = defaultdict(list)
    for r in placed:
        per[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert key(whole) == key(placed)
