"""Graphs of one shape are laid out once, and the order in which links come does not move a node."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators.layout import layout, positions


def star(graph, n):
    return [(graph, f"n{i:04d}", "hub") for i in range(n)]


def places(df):
    return {(r.graph, r.node): (r.x, r.y) for r in df.collect()}


def test_places_of_each_graph(spark):
    rng = random.Random(1)
    links = [("a", f"n{i}", f"n{j}") for i in range(9) for j in range(9) if rng.random() < 0.3] + [("loop", "x", "x"), (None, "p", "q")] + star("s", 12) + star("t", 12)
    got = places(layout(spark.createDataFrame(links, "graph string, from string, to string"), "graph", steps=30))
    want = {}
    for g in {x[0] for x in links}:
        own = sorted((a, b) for h, a, b in links if h == g)
        nodes = sorted({v for ab in own for v in ab})
        p = positions(nodes, [(nodes.index(a), nodes.index(b)) for a, b in own if a != b], 30).round(6)
        want |= {(g, v): tuple(xy) for v, xy in zip(nodes, p.tolist(), strict=True)}
    assert got == want
    assert layout(spark.createDataFrame([], "graph string, from string, to string"), "graph").count() == 0


def test_order_of_links_and_shapes(spark):
    links = spark.createDataFrame([x for g in ("a", "b", "c") for x in star(g, 400)], "graph string, from string, to string")
    one, other = (places(layout(links.orderBy(F.rand(seed)).repartition(3), "graph", steps=20)) for seed in (1, 2))
    assert one == other
    assert all(one[g, v] == one["a", v] for g in "bc" for v in {k[1] for k in one})
    # shapes are laid out, not groups
    plan = layout(links, "graph", steps=5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and np.isfinite(list(one.values())).all()
