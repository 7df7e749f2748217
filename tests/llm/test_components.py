import random

import pytest

from lodestone.llm import components as module
from lodestone.llm.components import components


@pytest.mark.parametrize("few", [module.FEW, 0])
def test_components_match_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 640)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    name = lambda i: f"{i:06d}".encode()
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in components(frame).collect()}
    assert got == {name(x): name(find(x)) for ab in links if ab[0] != ab[1] for x in ab}
    assert components(frame.limit(0)).count() == 0


def test_components_of_numbers(spark):
    frame = spark.createDataFrame([(3, 1), (1, 2), (9, 8)], "a long, b long")
    assert {(r.node, r.root) for r in components(frame).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
