"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Every text becomes its set of n-word shingles, named by a 96-bit digest, with a signature of
   16 trees x 8 minhash codes. Rows with equal sets collapse into one node, so that copies cost
   nothing from here on.
2. Each tree puts all nodes into the order of their eight codes; 16 sorted orders, cut into ranges.
   Neighbours whose longest common prefix is ``DEPTH`` codes at least form a region. A region of
   more than ``BLOCK`` nodes is cut, again and again, at its neighbours with the shortest common
   prefix, so that a block reaches as deep into the tree as its region is dense.
3. In a block, whole signatures are compared; nodes that agree in at least ``TENTATIVE`` of the codes
   (four and a half standard deviations under 0.8) are joined to tentative components.
4. Blocks of one region then meet: nodes outside the region's main tentative component are laid,
   part by part, against all nodes of the region. So every pair of a region is compared or is
   already joined, however large the region is; that costs (nodes outside) x (nodes of the region) /
   ``BLOCK`` rows.
5. Each tentative component gets the texts of its nodes once; there links are confirmed on the
   full sets, breadth first from every node, so that components under confirmed links are exact
   within it. A large component is cut into blocks that share one of its nodes; then nodes not
   joined to that one are laid, part by part, against all nodes in the same way.

A pair at similarity 0.8 has no region in common once in five thousand times ((1 - 0.8^4)^16); no pair
of a region is dropped. Nothing is collected to the driver, and a task holds two bounded blocks.

Defined cases: null and empty texts, and texts of white space only, have no shingles and stand
alone; a text of fewer than n words has one shingle, all its words; a null ``doc_id`` is never a
component's name unless all its members are null; repeated rows are members like others. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh, n_rows, small_or_shuffled, without
from lodestone.llm.components import components
from lodestone.llm.shingles import MinHash, set_id, shingle_set

TREES, DEPTH = 16, 4
CODES = TREES * 8
BLOCK = 1_024
CONFIRM_NODES, CONFIRM_SHINGLES = 1_000, 1_000_000
TENTATIVE = 0.64

Groups = Callable[[pa.Table], list[tuple]]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id, sig of every row; ``sig`` holds two numbers of four codes for each tree."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(CODES)
        for batch in batches:
            sizes, names, sigs = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py() or b"", n)
                sizes.append(len(s))
                names.append(set_id(s) if len(s) else None)
                sigs.append(minhash(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "sig"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(task, f"doc_id {kind}, text_hash long, n_shingles long, set_id binary, sig array<bigint>")


def by_group(rows: DataFrame, handle: Groups, schema: str, arrow: pa.Schema) -> DataFrame:
    """``handle`` on the rows of each group; the first column, a number, names the group. Groups are bounded and many share a task.

    Should two groups have one name they are handled as one, which compares more pairs and loses none.
    """
    name = rows.columns[0]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        out: list[tuple] = []

        def pack() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            ids = held.column(0).to_numpy()
            edges = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            begin = 0
            for end in edges:
                if end - begin > 1:
                    out.extend(handle(held.slice(begin, end - begin)))
                    if len(out) > 20_000:
                        yield pack()
                begin = int(end)
            held = held.slice(begin)
        if held is not None and len(held) > 1:
            out.extend(handle(held))
        if out:
            yield pack()

    return rows.repartition(name).sortWithinPartitions(name).mapInArrow(task, schema)


PAIR, LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())]), pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """The codes of signatures, a row each."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1).view(np.uint16)


def _close(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sig == one).sum(axis=-1) >= TENTATIVE * sig.shape[-1]


def _tentative(group: pa.Table) -> list[tuple]:
    """(node, least node of its component) for nodes whose signatures agree often enough."""
    keys, sig = group.column(1).to_numpy(), _codes(group.column(2))
    if len(keys) == 2:
        return [(int(keys.max()), int(keys.min()))] if _close(sig[0], sig[1]) else []
    order = np.argsort(keys)
    keys, sig, left, out = keys[order], sig[order], np.arange(len(keys)), []
    while len(left) > 1:
        first, wave, left = int(keys[left[0]]), [left[0]], left[1:]
        while wave and len(left):
            close = _close(sig[left], sig[wave.pop()])
            out += [(int(keys[j]), first) for j in left[close]]
            wave += list(left[close])
            left = left[~close]
    return out


def _met(group: pa.Table) -> list[tuple]:
    """Links between labels: every asking node against all others of its cell that bear another label."""
    known, label = np.unique(group.column(1).to_numpy(), return_inverse=True)
    asks, sig = group.column(2).to_numpy(zero_copy_only=False), _codes(group.column(3))
    own, out = label.copy(), []
    for i in np.flatnonzero(asks):
        others = np.flatnonzero(label != label[i])
        for j in others[_close(sig[others], sig[i])]:
            if label[j] != label[i]:
                out.append((int(known[own[i]]), int(known[own[j]])))
                label[label == label[j]] = label[i]
    return out


def _neighbours(sets: list[np.ndarray], percent: int) -> Callable[[int], np.ndarray]:
    """Which sets have 100 * common >= percent * union with the set of this number, decided on full sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(vocabulary), dtype=np.int32)

    def near(i: int) -> np.ndarray:
        own = codes[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        common = np.add.reduceat(marked[codes], starts)
        marked[own] = 0
        return 100 * common >= percent * (sizes + sizes[i] - common)

    return near


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The first member of each set's component under 100 * common >= percent * union."""
    near, root = _neighbours(sets, percent), np.full(len(sets), -1)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], wave = first, [first]
        while wave and (root < 0).any():
            new = near(wave.pop()) & (root < 0)
            root[new] = first
            wave += list(np.flatnonzero(new))
    return root


def confirm(group: pa.Table, n: int, percent: int) -> list[tuple]:
    """(first member, member) of each component among the nodes of a group; a shared node, if there is one, comes first."""
    rows = {name: (not shared, text) for name, text, shared in zip(group.column(1).to_pylist(), group.column(2), group.column(3).to_pylist(), strict=True)}  # repeated rows once
    ids = sorted(rows, key=lambda name: (rows[name][0], name))
    root = linked([shingle_set(rows[i][1].as_py(), n) for i in ids], percent)
    return [(ids[r], name) for r, name in zip(root, ids, strict=True)]


def confirm_met(group: pa.Table, n: int, percent: int) -> list[tuple]:
    """Links between labels: every asking node against all others of its cell that bear another label."""
    rows: dict[bytes, tuple] = {}
    for name, label, text, asks in zip(group.column(1).to_pylist(), group.column(2).to_pylist(), group.column(3), group.column(4).to_pylist(), strict=True):
        if name not in rows or asks:
            rows[name] = (label, text, asks)
    known, label = np.unique([x for x, _, _ in rows.values()], return_inverse=True)
    if len(known) == 1 or not any(x for _, _, x in rows.values()):
        return []
    near, own, out = _neighbours([shingle_set(t.as_py(), n) for _, t, _ in rows.values()], percent), label.copy(), []
    for i in np.flatnonzero([x for _, _, x in rows.values()]):
        for j in np.flatnonzero(near(i)):
            if label[j] != label[i]:
                out.append((bytes(known[own[i]]), bytes(known[own[j]])))
                label[label == label[j]] = label[i]
    return out


def cuts(lo: np.ndarray) -> list[tuple[int, int]]:
    """A region, as the rest of its nodes' codes in order, cut into blocks of ``BLOCK`` nodes at most: at the shortest common prefixes of neighbours."""
    out, todo = [], [(0, len(lo))]
    apart = lo[1:].view(np.uint64) ^ lo[:-1].view(np.uint64)  # the larger, the shorter the common prefix
    depth = np.zeros(len(apart), dtype=np.int8)
    for k in range(4):
        depth += apart < np.uint64(1) << np.uint64(16 * (k + 1))
    while todo:
        a, b = todo.pop()
        if b - a <= BLOCK:
            out.append((a, b))
            continue
        inner = depth[a : b - 1]
        at = np.flatnonzero(inner == inner.min()) + a + 1
        middle = int(at[np.abs(at - (a + b) // 2).argmin()])  # of equals the one nearest the middle
        if not (b - a) // 8 <= middle - a <= 7 * (b - a) // 8:
            middle = (a + b) // 2
        todo += [(a, middle), (middle, b)]
    return out


def blocks_of_orders(nodes: DataFrame) -> DataFrame:
    """block, key, region: neighbours in the sorted order of some tree; ``region`` is null unless it may have further blocks."""
    trees = [F.struct(F.lit(t).alias("tree"), F.col("sig")[2 * t].alias("hi"), F.col("sig")[2 * t + 1].alias("lo")) for t in range(TREES)]
    order = nodes.select("key", F.inline(F.array(*trees))).repartitionByRange("tree", "hi", "lo", "key").sortWithinPartitions("tree", "hi", "lo", "key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, dtype=np.int64)
        key, tree, hi, lo = empty, empty, empty, empty
        first, out = True, ([], [], [])

        def emit(begin: int, end: int, whole: bool) -> None:
            pieces = cuts(lo[begin:end]) if end - begin > 1 else [(0, end - begin)]
            region = None if whole and len(pieces) == 1 else xxhash.xxh3_64_intdigest(np.array([tree[begin], hi[begin]]).tobytes()) - (1 << 63)
            for a, b in pieces:
                if region is None and b - a < 2:
                    continue
                members = key[begin + a : begin + b]
                block = xxhash.xxh3_64_intdigest(np.sort(members).tobytes()) - (1 << 63)  # equal blocks of several trees become one
                out[0].extend([block] * len(members))
                out[1].extend(members.tolist())
                out[2].extend([region] * len(members))

        def pack() -> Iterator[pa.RecordBatch]:
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["block", "key", "region"])
                for c in out:
                    c.clear()

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(4)]
            key, tree, hi, lo = (np.concatenate([a, b.astype(np.int64)]) for a, b in zip((key, tree, hi, lo), new, strict=True))
            edges = np.flatnonzero((hi[1:] != hi[:-1]) | (tree[1:] != tree[:-1])) + 1
            begin = 0
            if first and len(edges):
                emit(0, int(edges[0]), False)  # a region may go on in the range before
                first, begin = False, int(edges[0])
            bounds = np.concatenate([[begin], edges[edges > begin]])
            for at in np.flatnonzero(np.diff(bounds) > 1):
                emit(int(bounds[at]), int(bounds[at + 1]), True)
            begin = int(bounds[-1])
            if len(key) - begin > 16 * BLOCK:  # a very large region goes on block by block
                emit(begin, len(key), False)
                begin, first = len(key), True
            key, tree, hi, lo = key[begin:], tree[begin:], hi[begin:], lo[begin:]
            yield from pack()
        if len(key):
            emit(0, len(key), False)
        yield from pack()

    return order.select("key", "tree", "hi", "lo").mapInArrow(task, "block long, key long, region long").distinct()


def cells(asking: DataFrame, asked: DataFrame, size: int, *columns: str) -> DataFrame:
    """group, columns..., asks: parts of asking nodes beside parts of all nodes of the same ``of``, parts of about the weight ``size``.

    Both sides have ``of``, ``key``, ``n`` (weight of the nodes of this ``of``) and ``out`` (of the asking ones among them).
    """
    parts = lambda count: F.ceil(F.col(count) / size).cast("long")
    own = lambda count: F.pmod(F.xxhash64("key"), parts(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), parts(count) - 1))
    left = asking.select("of", own("out").alias("i"), every("n").alias("j"), *columns, F.lit(True).alias("asks"))
    right = asked.select("of", every("out").alias("i"), own("n").alias("j"), *columns, F.lit(False).alias("asks"))
    return left.union(right).select(F.xxhash64("of", "i", "j").alias("group"), *columns, "asks")


def outside_main(members: DataFrame) -> DataFrame:
    """of, main, n, out: groups of more than one label and their weight; ``main`` is the heaviest label, ``out`` the weight of the others."""
    shares = members.groupBy("of", "label").agg(F.sum("weight").alias("k"))
    sizes = shares.groupBy("of").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n"))
    return cut(sizes.select(F.col("of").alias("of_"), F.col("top.label").alias("main"), "n", (F.col("n") - F.col("top.k")).alias("out")).where("out > 0"))


def tentative_components(nodes: DataFrame) -> DataFrame:
    """node, root (both keys) of all nodes joined to another one by signatures that agree often enough, in some region."""
    placed = cut(blocks_of_orders(nodes))
    sigs = nodes.select(F.col("key").alias("key_"), "sig")
    in_blocks = placed.select("block", "key").distinct().join(sigs, F.col("key") == F.col("key_")).select("block", "key", "sig")
    joined = cut(components(by_group(in_blocks, _tentative, "a long, b long", PAIR)))
    shared = placed.where("region is not null")
    several = cut(shared.groupBy("region").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select(F.col("region").alias("of_")))
    if not n_rows(several):
        return joined
    members = shared.join(small_or_shuffled(several), F.col("region") == F.col("of_")).select(F.col("region").alias("of"), "key").distinct()
    members = cut(members.join(joined, F.col("key") == F.col("node"), "left").select("of", "key", F.coalesce("root", "key").alias("label")))
    mains = outside_main(members.withColumn("weight", F.lit(1)))
    if not n_rows(mains):
        return joined
    rest = members.join(small_or_shuffled(mains), F.col("of") == F.col("of_"))
    crossed = cells(rest.where("label <> main"), rest, BLOCK, "key", "label")
    crossed = crossed.join(sigs, F.col("key") == F.col("key_")).select("group", "label", "asks", "sig")
    more = cut(components(by_group(crossed, _met, "a long, b long", PAIR)).select(F.col("node").alias("node_"), F.col("root").alias("root_")))
    alone = more.join(joined, F.col("node_") == F.col("node"), "left_anti").select(F.col("node_").alias("node"), F.col("node_").alias("root"))
    return joined.union(alone).join(more, F.col("root") == F.col("node_"), "left").select("node", F.coalesce("root_", "root").alias("root"))


def _row_key() -> Column:
    """The member that stands for a group: the least doc_id, nulls last, then the least text hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))


def confirmed(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """set_id, component of the nodes of tentative components, after their links are confirmed."""
    tentative = tentative_components(nodes).join(nodes.drop("sig"), F.col("node") == F.col("key"))
    tentative = cut(tentative.select("root", "key", "set_id", "n_shingles", "row", "copies"))
    weight = F.greatest(F.lit(1), F.ceil(F.col("n_shingles") * CONFIRM_NODES / CONFIRM_SHINGLES)).cast("long")  # a long text counts for several nodes
    blocks = F.ceil(F.sum(weight) / CONFIRM_NODES).cast("long")
    # only the few components that are too large for a task meet this table; the rest need no join by root
    large = tentative.groupBy("root").agg(blocks.alias("blocks"), F.max(F.struct("copies", "key"))["key"].alias("shared")).where("blocks > 1")
    large = cut(large.withColumnRenamed("root", "root_"))
    is_shared = F.coalesce(F.col("key") == F.col("shared"), F.lit(False))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    at = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).when(is_shared, every).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("blocks"))))
    placed = tentative.join(small_or_shuffled(large), F.col("root") == F.col("root_"), "left").withColumn("at", at).withColumn("shared", is_shared)

    pointer = placed.select("root", "key", "set_id", "at", "shared", F.col("row.doc_id").alias("id_"), F.col("row.text_hash").alias("hash_"))
    with_text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    texts = with_text.join(small_or_shuffled(pointer, at_most=tentative), same)

    spread = texts.select("root", F.explode("at").alias("at"), "set_id", "text", "shared").select(F.xxhash64("root", "at").alias("group"), "set_id", "text", "shared")
    stars = cut(by_group(spread, lambda g: confirm(g, n, percent), "a binary, b binary", LINK).distinct())
    whole = stars.select(F.col("b").alias("set_id"), F.col("a").alias("component"))
    if not n_rows(large):
        return whole
    members = placed.where("blocks > 1").select(F.col("root").alias("of"), "key", "set_id", weight.alias("weight"))
    members = cut(members.join(stars, F.col("set_id") == F.col("b"), "left").select("of", "key", "set_id", "weight", F.coalesce("a", "set_id").alias("label")))
    mains = outside_main(members)
    if not n_rows(mains):
        return whole
    rest = members.join(small_or_shuffled(mains), F.col("of") == F.col("of_"))
    crossed = cells(rest.where("label <> main"), rest, CONFIRM_NODES, "set_id", "label").withColumnRenamed("set_id", "set_")
    wanted = rest.select(F.col("set_id").alias("wanted"))
    bodies = texts.select("set_id", "text").join(small_or_shuffled(wanted, at_most=members), F.col("set_id") == F.col("wanted"), "left_semi")
    crossed = crossed.join(bodies, F.col("set_") == F.col("set_id")).select("group", "set_id", "label", "text", "asks")
    more = components(by_group(crossed, lambda g: confirm_met(g, n, percent), "a binary, b binary", LINK)).withColumnRenamed("root", "main")
    return whole.join(more, F.col("component") == F.col("node"), "left").select("set_id", F.coalesce("main", "component").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, keeper of every row of ``docs``.

    ``text_hash`` is xxhash64 of the text; ``keeper`` marks the row (or rows equal to it) that stands for its component.
    """
    signed = cut(signatures(docs, n))
    sets = signed.where("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min(_row_key()).alias("row"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(sets.withColumn("key", F.xxhash64("set_id")))  # a short name; should two sets share it, they are compared together
    of = confirmed(docs, nodes, n, percent)

    # nodes that stand for more than their own row, and the row that stands for them
    joined = nodes.select("set_id", "row", "copies").join(of.withColumnRenamed("set_id", "of_set"), F.col("set_id") == F.col("of_set"), "left")
    joined = joined.where("copies > 1 or component is not null").select("set_id", "row", "copies", F.coalesce("component", "set_id").alias("component"))
    best = joined.groupBy(F.col("component").alias("component_")).agg(F.min("row").alias("best"))
    verdict = cut(joined.join(best, F.col("component") == F.col("component_")).select(F.col("set_id").alias("set_"), "best"))
    out = signed.drop("sig").join(small_or_shuffled(verdict), F.col("set_id") == F.col("set_"), "left")
    keeper = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash")))
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), keeper.alias("keeper"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, whole, with their columns."""
    verdict = cut(near_duplicates(docs, n, percent))
    kept = without(docs, verdict.where("not keeper"))
    repeated = cut(verdict.where("keeper and n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1"))
    if not n_rows(repeated):
        return kept
    # rows that repeat both id and text: one of them, whichever comes first
    h, i, r = fresh(docs, "text_hash", "id", "repeated")
    marks = repeated.select(F.col("doc_id").alias(i), F.col("text_hash").alias(r))
    hashed = kept.withColumn(h, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(r))
    once = hashed.join(small_or_shuffled(marks), same, "left_semi").dropDuplicates(["doc_id", h])
    return hashed.join(small_or_shuffled(marks), same, "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
