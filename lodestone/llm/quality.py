"""Quality of documents by random-indexing word vectors and a two-layer network.

Tokens are runs of letters (lower-cased; all-capital words are one token), digit runs by length,
runs of other signs, and a mark for a token that repeats the one before; they fall into ``BUCKETS``
buckets by hash. Every bucket has a sparse random index vector, one +1 and one -1. Its context
vector is the sum of the index vectors of the two neighbours on either side, over all tokens of all
documents; partial sums of each task are added up by bucket, so what is gathered is bounded by
buckets x dimensions and not by the corpus. A word vector is the context vector scaled to length
one, plus the index vector. A document is the mean of its tokens' vectors and the logarithm of
their number.

The network (one hidden layer) is fitted in numpy on at most about ``SAMPLE`` labelled documents
chosen by hash of the id; a fifth of these is kept from the fit to find the temperature that makes
the probabilities calibrated.

Defined cases: null and empty texts and texts of white space have no tokens, vector zero and the
network's score for it; labels that are null or not 0 or 1 are not learned from; of several labels
of a document each counts; without two classes among them every score is the share of ones (0.5 if there are
no labels), and from two labels on the network is fitted, however few they are. A text of any length is pooled in bounded memory. Repeated rows get equal scores. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_or_shuffled

BUCKETS, DIMENSIONS, NEIGHBOURS = 8_192, 64, 2
SAMPLE, HIDDEN, ROUNDS = 8_000, 32, 40
REMEMBERED, TOKENS_AT_ONCE = 100_000, 250_000
#: Tokens whose vectors are pooled at once: beside them lies a copy in double precision, 768 bytes a token.
POOLED_AT_ONCE = 50_000
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall


class _Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        name = token.lower() if token.isalpha() else f"#{min(len(token), 12)}" if token.isdigit() else token
        if len(token) > 1 and token.isupper():
            name = "^^"
        self[token] = n = 1 + zlib.crc32(name.encode()) % (BUCKETS - 1)
        return n


_BUCKET = _Buckets()
_REPEATED = 0


def token_buckets(text: str) -> np.ndarray:
    tokens = TOKEN(text)
    ids = np.fromiter(map(_BUCKET.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    if len(ids) > 1:
        ids[1:][ids[1:] == ids[:-1]] = _REPEATED
    return ids


def index_places(seed: int = 5) -> np.ndarray:
    """The places of +1 and of -1 of each bucket."""
    rng = np.random.default_rng(seed)
    plus = rng.integers(0, DIMENSIONS, BUCKETS)
    return np.stack([plus, (plus + rng.integers(1, DIMENSIONS, BUCKETS)) % DIMENSIONS], axis=1)


def _in_runs(batches: Iterator[pa.RecordBatch], column: int, most: int = POOLED_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Batches in pieces of bounded numbers of tokens: (batch, first row, buckets of each row)."""
    for batch in batches:
        held, first, n = [], 0, 0
        for i, text in enumerate(batch.column(column)):
            held.append(token_buckets(text.as_py() or ""))
            n += len(held[-1])
            if n > most:
                yield batch, first, held
                held, first, n = [], i + 1, 0
        if held:
            yield batch, first, held


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Sums of neighbours' index vectors over all tokens of all rows: buckets x dimensions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = index_places()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for _, _, held in _in_runs(batches, 0, TOKENS_AT_ONCE):
            # gaps between rows, so that no neighbour is of another row
            gap = np.full(NEIGHBOURS, -1)
            ids = np.concatenate([x for h in held for x in (h, gap)])
            for d in range(1, NEIGHBOURS + 1):
                a, b = ids[:-d], ids[d:]
                real = (a >= 0) & (b >= 0)
                a, b = a[real], b[real]
                for x, y in ((a, b), (b, a)):
                    total += np.bincount(x * DIMENSIONS + places[y, 0], minlength=len(total))
                    total -= np.bincount(x * DIMENSIONS + places[y, 1], minlength=len(total))
        rows = total.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(rows.any(axis=1))
        if len(used):
            sums = pa.array([r.tobytes() for r in rows[used].astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), sums], names=["bucket", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, dtype=np.float32 if len(v) == 4 * DIMENSIONS else np.float64)
                total[k] = total[k] + v if k in total else v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["bucket", "sums"])

    parts = docs.select("text").mapInArrow(partial, "bucket long, sums binary")
    rows = parts.repartition("bucket").mapInArrow(added, "bucket long, sums binary").collect()  # one row a bucket at most
    out = np.zeros((BUCKETS, DIMENSIONS))
    for r in rows:
        out[r.bucket] = np.frombuffer(bytes(r.sums))
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    index = np.zeros((BUCKETS, DIMENSIONS))
    places = index_places()
    index[np.arange(BUCKETS), places[:, 0]] += 1
    index[np.arange(BUCKETS), places[:, 1]] -= 1
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.where(length > 0, length, 1) + index).astype(np.float32)


def pooled(held: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean vector and logarithm of the number of tokens of each document."""
    out = np.zeros((len(held), DIMENSIONS + 1))
    sizes = np.array([len(h) for h in held])
    full = np.flatnonzero((sizes > 0) & (sizes <= POOLED_AT_ONCE))
    for i in np.flatnonzero(sizes > POOLED_AT_ONCE):  # a very long text by the counts of its buckets
        out[i, :-1] = np.bincount(held[i], minlength=len(vectors)) @ vectors.astype(np.float64) / sizes[i]
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ids = np.concatenate([held[i] for i in full])
        out[full, :-1] = np.add.reduceat(vectors[ids], starts, axis=0, dtype=np.float64) / sizes[full, None]
    out[:, -1] = np.log1p(sizes)
    return out


class Network:
    """Two layers, standardised input, temperature."""

    def __init__(self, share: float):
        self.share, self.layers, self.temperature = share, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, a, b, c, d = self.layers
        return np.tanh((x - mean) / scale @ a + b) @ c + d

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    net = Network(float(y.mean()) if len(y) else 0.5)
    if len(set(y.tolist())) < 2:
        return net
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % 5 == 0
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(float)
    train, valid = (x[~kept], y[~kept]), (x[kept], y[kept])
    mean, scale = train[0].mean(axis=0), train[0].std(axis=0) + 1e-6
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    z = (train[0] - mean) / scale
    for _ in range(ROUNDS):
        order = rng.permutation(len(z))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            h = np.tanh(z[part] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -50, 50))) - train[1][part]) / len(part)
            back = np.outer(error, w[2]) * (1 - h**2)
            steps = [z[part].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(steps):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] -= 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.layers = (mean, scale, *w[:3], w[3][0])
    raw = net.logits(valid[0])
    loss = lambda k: np.logaddexp(0, np.where(valid[1] == 1, -raw, raw) / k).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _vectors_of(docs: DataFrame, shared, extra: str, kinds: str) -> DataFrame:
    """The pooled vector of each row beside column ``extra``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, held in _in_runs(batches, 1):
            x = pooled(held, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array([r.tobytes() for r in x], pa.binary())], names=[extra, "x"])

    return docs.select(extra, "text").mapInArrow(task, f"{extra} {kinds}, x binary")


def scored(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text_hash, score of every row of ``docs``. ``learnable``: a condition on labels' doc_id."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(word_vectors(context_vectors(docs)))  # of fixed size: buckets x dimensions
    good = labels.where(learnable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, sample / max(1, good.count()))
    drawn = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = good.where(drawn < share).withColumnRenamed("doc_id", "_id").withColumnRenamed("quality", "_label")
    found = docs.select("doc_id", "text").join(small_or_shuffled(chosen), F.col("doc_id") == F.col("_id")).select("_label", "text")
    # vectors, not texts, come together; repeated labels could pass the share by any number, this bound holds always
    rows = sorted((r["_label"], bytes(r.x)) for r in _vectors_of(found, shared, "_label", "int").limit(2 * sample).collect())
    x = np.stack([np.frombuffer(b) for _, b in rows]) if rows else np.zeros((0, DIMENSIONS + 1))
    net = sc.broadcast(fit(x, np.array([y for y, _ in rows], dtype=int)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, held in _in_runs(batches, 2):
            score = net.value(pooled(held, shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), batch.column(1).slice(first, len(held)), pa.array(score, pa.float64())], names=["doc_id", "text_hash", "score"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(task, f"doc_id {kind}, text_hash long, score double")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, labels, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
