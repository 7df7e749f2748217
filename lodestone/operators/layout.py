"""Force layout of a link graph: repulsion k^2/d, attraction d^2/k, a pull to the centre, linear cooling.

Places depend only on how many nodes there are and which of them, in their order, are linked. So each graph gets the digest of that, its
shape; a shape is laid out once, exactly, and its places go to all graphs that have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.common import by_groups, cut

STEPS, PULL, ROWS_AT_ONCE = 300, 0.02, 64
#: Nodes of all shapes up to which their places are broadcast.
BROADCAST_NODES = 1_000_000


def positions(nodes: list, edges: list[tuple[int, int]], steps: int = STEPS) -> np.ndarray:
    """(n, 2) places; starts from a spiral, so that runs agree."""
    n = len(nodes)
    k = 1 / np.sqrt(max(n, 1))
    turn = np.arange(n) * 2.399963
    p = np.stack([np.cos(turn), np.sin(turn)], axis=1) * np.sqrt((np.arange(n) + 0.5) / max(n, 1))[:, None] / 2
    e = np.array(edges, dtype=int).reshape(-1, 2)
    for step in range(steps if n > 1 else 0):
        move = -PULL * k * p
        x, y = p.T.copy()
        for at in range(0, n, ROWS_AT_ONCE):  # exact repulsion, in bounded blocks, a plane for each coordinate
            low = min(at, n - 2)  # two columns at least, since one alone is summed in another order
            own = slice(low, at + ROWS_AT_ONCE)
            dx, dy = x[own] - x[:, None], y[own] - y[:, None]
            force = dx * dx
            force += dy * dy
            force += 1e-9
            np.divide(k * k, force, out=force)
            dx *= force
            dy *= force
            move[at : at + ROWS_AT_ONCE, 0] += dx.sum(axis=0)[at - low :]
            move[at : at + ROWS_AT_ONCE, 1] += dy.sum(axis=0)[at - low :]
        if len(e):
            diff = p[e[:, 0]] - p[e[:, 1]]
            pull = diff * (np.linalg.norm(diff, axis=1) / k)[:, None]
            np.add.at(move, e[:, 0], -pull)
            np.add.at(move, e[:, 1], pull)
        length = np.linalg.norm(move, axis=1, keepdims=True) + 1e-12
        p = p + move / length * np.minimum(length, 0.1 * (1 - step / steps))
    return p


_INTS = pa.list_(pa.int32())
_DOUBLES = pa.list_(pa.float64())


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """by, nodes, shape, n, ends of the links but loops, by number: a row for each graph, out of links in order."""
    by, held, kinds = None, [], []

    def graph() -> pa.RecordBatch:
        start, end = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        nodes, number = np.unique(np.concatenate([start, end]), return_inverse=True)
        a, b = number[: len(start)].astype(np.int32), number[len(start) :].astype(np.int32)
        a, b = a[a != b], b[a != b]
        shape = hashlib.sha256(np.int64(len(nodes)).tobytes() + a.tobytes() + b.tobytes()).hexdigest()
        columns = [pa.array([by], kinds[0]), pa.array([nodes], pa.list_(kinds[1])), pa.array([shape]), pa.array([len(nodes)], pa.int32()), pa.array([a], _INTS), pa.array([b], _INTS)]
        return pa.RecordBatch.from_arrays(columns, ["_by", "_nodes", "_shape", "_n", "_a", "_b"])

    for batch in batches:
        kinds = [batch.schema.field(k).type for k in (0, 1)]
        graphs, start, end = batch.column(0).to_pylist(), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        cuts = [0, *(k for k in range(1, len(graphs)) if graphs[k] != graphs[k - 1]), len(graphs)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and graphs[low] != by:
                yield graph()
                held = []
            by = graphs[low]
            held.append((start[low:high], end[low:high]))
    if held:
        yield graph()


def _laid_out(steps: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shape, n, a, b in zip(*[batch.column(c).to_pylist() for c in ("_shape", "_n", "_a", "_b")], strict=True):
                p = positions(range(n), list(zip(a, b, strict=True)), steps).round(6)
                yield pa.RecordBatch.from_arrays([pa.array([shape]), pa.array([p[:, 0]], _DOUBLES), pa.array([p[:, 1]], _DOUBLES)], ["_shape", "_x", "_y"])

    return task


def layout(edges: DataFrame, by: str, steps: int = STEPS) -> DataFrame:
    """by, node, x, y: one layout for each group of edges (by, from, to); groups are what a screen shows."""
    group, node = (edges.schema[c].dataType.simpleString() for c in (by, "from"))
    links = edges.select(F.col(by).alias("_by"), F.col("from").alias("_from"), F.col("to").cast(node).alias("_to"))
    links = by_groups(links, "_by").sortWithinPartitions("_by", "_from", "_to")
    graphs = cut(links.mapInArrow(_shaped, f"_by {group}, _nodes array<{node}>, _shape string, _n int, _a array<int>, _b array<int>"))
    shapes = graphs.groupBy("_shape").agg(F.first(F.struct("_n", "_a", "_b")).alias("_s")).select("_shape", "_s.*")
    places = cut(by_groups(shapes, "_shape").mapInArrow(_laid_out(steps), "_shape string, _x array<double>, _y array<double>"))
    many = places.agg(F.sum(F.size("_x"))).first()[0] or 0
    found = graphs.select("_by", "_nodes", "_shape").join(F.broadcast(places) if many <= BROADCAST_NODES else places, "_shape")
    rows = found.select(F.col("_by").alias(by), F.explode(F.arrays_zip("_nodes", "_x", "_y")).alias("_p"))
    return rows.select(by, F.col("_p._nodes").alias("node"), F.col("_p._x").alias("x"), F.col("_p._y").alias("y"))


def fitted(p: np.ndarray, width: float, height: float, margin: float = 0.05) -> np.ndarray:
    """Places scaled into a frame, proportions kept."""
    if not len(p):
        return p
    low, high = p.min(axis=0), p.max(axis=0)
    span = np.where(high - low > 0, high - low, 1)
    scale = min(width * (1 - 2 * margin) / span[0], height * (1 - 2 * margin) / span[1])
    return (p - (low + high) / 2) * scale + np.array([width / 2, height / 2])
