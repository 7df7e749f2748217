"""Importance resampling towards a target distribution, drawn through tournament trees over sorted runs.

Features are the runs of one and two consecutive words, hashed into buckets. The gain of a bucket is
the logarithm of how much likelier it is in the target than in the corpus, with one added to every
bucket; a document's weight is its mean gain, and with Gumbel noise added the highest scores are a
draw without replacement by weight.

Counting and weighing run over Arrow batches on arrays: words are split as bytes, each word's
checksum is remembered, and the checksum of a pair follows from those of its words (checksums are
linear), so that no pair is ever written out. Gains are one array of a number a bucket, whatever the
size of the input; each task adds its counts to one row a bucket before the shuffle.

Drawing: a table of counts by score (scores are whole numbers within a known range) gives the score
at which the draw ends; only rows at or above it go on. It is cut into ranges of about
``ROWS_A_RANGE`` rows, a score of more rows being cut again by id. Each batch of a partition is sorted
into a run, whose slice for a range is one row of arrays; a range's task merges the slices it got,
block by block, in a tournament tree, numbers them from the count of rows before the range, and
stops after the exact number of the draw. No task sees more than a range, the driver sees the number
of rows only, and what is broadcast is a row a score.

Defined cases: a null or empty text has no words, no features and weight 0, and is not eligible. Rows
without ``doc_id`` draw their number from an empty id and come last among equal scores. Rows equal in
score and id go by n_features; equal in that too, they are interchangeable, each with a rank of its
own. Very long words and texts are counted whole. An empty target counts nothing; an empty table gives an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, n_rows, small_or_shuffled, table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
ROWS_A_RANGE = 50_000
#: Words whose checksum a task remembers; the store is emptied when full.
REMEMBERED = 200_000
#: Rows that a run hands to the tournament at a time.
BLOCK = 1_024
ROWS_A_RUN = 500_000
#: Id of rows without one, behind all others.
NO_ID = (1 << 63) - 1

#: A-Z lower-cased, all other ASCII characters but letters and digits made blanks; bytes of longer characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shift_tables(longest: int = 255) -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, being b, becomes when n more bytes follow (checksums without the usual complement)."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # a byte into an empty register
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = [[b << 8 * k for b in range(256)] for k in range(4)]
    for n in range(1, longest + 1):
        before = out[n - 1]
        out[n] = (before >> 8) ^ one[before & 255]
    return out


class BucketCounter:
    """Buckets of the one- and two-word runs of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.tables = buckets, shift_tables()

        class Words(dict):
            """A word's checksum, and its size above that; sizes past the tables count as 0."""

            def __missing__(words, word: bytes) -> int:  # noqa: N805
                if len(words) >= REMEMBERED:
                    words.clear()
                words[word] = x = zlib.crc32(word) | (len(word) if len(word) < len(self.tables) else 0) << 32
                return x

        self.words = Words()

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of each feature."""
        split = text.encode().translate(LETTERS).split()
        n = len(split)
        known = np.fromiter(map(self.words.__getitem__, split), np.int64, n)
        crc, size = (known & 0xFFFFFFFF).astype(np.uint32), known >> 32
        # checksum of a + " " + b: that of a + " " moved on by the size of b, with that of b laid over it
        blank = self._moved(crc[:-1], np.ones(max(n - 1, 0), np.int64)) ^ np.uint32(zlib.crc32(b" "))
        pairs = self._moved(blank, size[1:]) ^ crc[1:]
        for i in np.flatnonzero(size[1:] == 0):
            pairs[i] = zlib.crc32(split[i] + b" " + split[i + 1])
        return n, np.concatenate([crc, pairs]).astype(np.int64) % self.buckets

    def _moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[by, 0, crc & 255] ^ t[by, 1, crc >> 8 & 255] ^ t[by, 2, crc >> 16 & 255] ^ t[by, 3, crc >> 24]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all rows of ``texts`` (column ``text``)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, n = BucketCounter(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    n += np.bincount(counter.of(text.as_py())[1], minlength=buckets)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * log of the target's share over the corpus's share) of each bucket, one added to all counts."""
    sides = bucket_counts(corpus, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sides = sides.unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = {r.bucket: (r.s, r.t) for r in sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}  # of ``buckets`` rows
    all_s, all_t = (sum(x[k] for x in counts.values()) for k in (0, 1))
    pairs = [counts.get(b, (0, 0)) for b in range(buckets)]
    return [math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets)))) for s, t in pairs]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from 32 bits of sha256 over seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def weighed(docs: DataFrame, gains: Sequence[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, n_words of every row."""
    gains = np.asarray(gains, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = BucketCounter(len(gains))
        for batch in batches:
            found = np.zeros((len(batch), 3), np.int64)
            for i, text in enumerate(batch.column(2)):
                if text.is_valid:
                    n, buckets = counter.of(text.as_py())
                    found[i] = len(buckets), int(gains[buckets].sum()) // max(len(buckets), 1), n
            n_features, weight, n_words = map(pa.array, found.T.copy())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_features, weight, batch.column(1), n_words], names=["doc_id", "n_features", "weight", "noise", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), noise(F.col("doc_id"), seed).alias("noise"), "text")
    out = rows.mapInArrow(task, "doc_id long, n_features long, weight long, noise long, n_words long")
    return out.select("doc_id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "n_words")


class Tournament:
    """Merges sorted runs of key tuples: each inner node of a tree holds the loser of its match, so the next winner costs one match a level.

    A run is an iterator over blocks (lists of keys), of which one is held at a time.
    """

    def __init__(self, runs: Sequence[Iterator[list[tuple]]]):
        self.blocks = list(runs)
        self.held: list[list[tuple]] = [[] for _ in self.blocks]
        self.at = [0] * len(self.blocks)
        self.size = 1 << max(0, len(self.blocks) - 1).bit_length()
        head = [self._next(k) if k < len(self.blocks) else None for k in range(self.size)]
        winners = [None] * self.size + list(zip(head, range(self.size), strict=True))
        self.losers: list = [None] * self.size
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self._played(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    @staticmethod
    def _played(a, b):
        return (a, b) if b[0] is None or a[0] is not None and a[0] <= b[0] else (b, a)

    def _next(self, run: int) -> tuple | None:
        """The first key of the run that was not taken yet; None at its end."""
        while self.at[run] >= len(self.held[run]):
            if (block := next(self.blocks[run], None)) is None:
                return None
            self.held[run], self.at[run] = block, 0
        self.at[run] += 1
        return self.held[run][self.at[run] - 1]

    def __iter__(self) -> Iterator[tuple]:
        while self.winner[0] is not None:
            key, run = self.winner
            rival, node = (self._next(run), run), (run + self.size) // 2
            while node:
                rival, self.losers[node] = self._played(rival, self.losers[node])
                node //= 2
            self.winner = rival
            yield key

    def rest(self) -> Iterator[tuple]:
        """What was not taken, in no order; nothing can be taken after it."""
        for key, _ in [self.winner, *self.losers[1:]]:
            if key is not None:
                yield key
        for run, blocks in enumerate(self.blocks):
            yield from self.held[run][self.at[run] :]
            for block in blocks:
                yield from block


KEYS = ("doc_id", "n_features", "weight", "score")


def _cells(eligible: DataFrame, n_drawn: int, rows_a_range: int) -> DataFrame:
    """For each score that the draw reaches: rows before it, the stretch it lies in, and the parts it is cut into by id.

    Scores lie within a few ten thousand of 0, since logarithms of counts and of 32-bit fractions do, so the window over
    them has as many rows at most, whatever the number of documents. Scores of the same stretch of ``rows_a_range`` places
    share a range; only the last of a stretch can have more rows than that, and is cut.
    """
    by_score = eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_score.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
        .where(F.col("before") < n_drawn)
        .select(F.col("score").alias("_score"), "lowest", "highest", "before", F.expr(f"before div {rows_a_range}").alias("stretch"), F.ceil(F.col("n") / rows_a_range).alias("parts"))
    )


def _slices(rows: DataFrame) -> DataFrame:
    """stretch, part, before and arrays of keys and counts: the rows of a task in sorted runs, a row for each range that a run meets."""
    fields = [*KEYS, "n"]

    def sliced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        x = {c: np.asarray(t[c].fill_null(NO_ID).to_numpy()) for c in ("stretch", "part", "before", *fields)}
        order = np.lexsort((x["weight"], x["n_features"], x["doc_id"], -x["score"], x["part"], x["stretch"]))
        x = {c: v[order] for c, v in x.items()}
        first = np.flatnonzero(np.r_[True, (np.diff(x["stretch"]) != 0) | (np.diff(x["part"]) != 0)])
        before = np.minimum.reduceat(x["before"], first)
        offsets = pa.array(np.r_[first, len(order)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[c])) for c in fields]
        return pa.RecordBatch.from_arrays([pa.array(x["stretch"][first]), pa.array(x["part"][first]), pa.array(before), *lists], names=["stretch", "part", "before", *fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= ROWS_A_RUN:
                yield sliced(held)
                held, n = [], 0
        if n:
            yield sliced(held)

    kinds = ", ".join(["stretch long, part long, before long", *[f"{c} array<long>" for c in fields]])
    return rows.select("stretch", "part", "before", *fields).mapInArrow(task, kinds)


def _blocks(row: dict) -> Iterator[list[tuple]]:
    """A run's slice as sorted blocks of (negative score, id, n_features, weight, count)."""
    for k in range(0, len(row["score"]), BLOCK):
        part = {c: row[c][k : k + BLOCK] for c in (*KEYS, "n")}
        yield list(zip([-x for x in part["score"]], part["doc_id"], part["n_features"], part["weight"], part["n"], strict=True))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``scored`` (a written table of :func:`weighed`)."""
    may = F.col("n_words") >= least_words
    n_drawn = percent * scored.where(may).count() // 100
    cells = cut(_cells(scored.where(may), n_drawn, rows_a_range))
    placed = scored.join(small_or_shuffled(cells), may & (F.col("score") == F.col("_score")), "left")
    outside = placed.where("stretch IS NULL").select(*KEYS, F.lit(None).cast("long").alias("rank"))

    share = (F.col("doc_id").cast("double") - F.col("lowest")) / (F.col("highest").cast("double") - F.col("lowest") + 1)
    part = F.coalesce(F.floor(share * F.col("parts")), F.col("parts") - 1)  # rows without an id come last
    part = F.when(F.col("parts") > 1, 1 + F.greatest(F.lit(0), F.least(part, F.col("parts") - 1))).otherwise(0).cast("long")
    # rows that agree in all are one row with a count, combined before the shuffle
    counted = cut(placed.where("stretch IS NOT NULL").groupBy("stretch", part.alias("part"), "before", *KEYS).agg(F.count(F.lit(1)).alias("n")))
    lower = Window.partitionBy("_stretch").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy(F.col("stretch").alias("_stretch"), F.col("part").alias("_part")).agg(F.sum("n").alias("_n"), F.min("before").alias("_first"))
    first = F.min("_first").over(Window.partitionBy("_stretch")) + F.coalesce(F.sum("_n").over(lower), F.lit(0))
    starts = cut(sizes.select("_stretch", "_part", first.alias("base")))
    slices = _slices(counted).join(small_or_shuffled(starts), (F.col("stretch") == F.col("_stretch")) & (F.col("part") == F.col("_part")))

    def task(group: pa.Table) -> pa.Table:
        base = group["base"][0].as_py()
        merged, left = [], n_drawn - base
        runs = Tournament([_blocks(row) for row in group.select([*KEYS, "n"]).to_pylist()])
        for key in runs:
            merged.append(key)
            left -= key[4]
            if left <= 0:
                break
        # the draw is full: what the runs still hold is not merged
        keys = np.array(merged + list(runs.rest()), np.int64).reshape(-1, 5)
        start = base + np.cumsum(keys[:, 4]) - keys[:, 4]
        drawn = np.where(np.arange(len(keys)) < len(merged), np.clip(n_drawn - start, 0, keys[:, 4]), 0)
        return pa.table({
            "doc_id": pa.array(keys[:, 1], mask=keys[:, 1] == NO_ID), "n_features": keys[:, 2], "weight": keys[:, 3], "score": -keys[:, 0],
            "start": start, "drawn": drawn, "n": keys[:, 4],
        })

    merged = slices.groupBy("stretch", "part").applyInArrow(task, ", ".join(f"{c} long" for c in [*KEYS, "start", "drawn", "n"]))
    # a counted row stands for n rows again: those drawn have the ranks from start + 1 on
    each = merged.select(*KEYS, "start", "drawn", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    drawn = each.select(*KEYS, F.when(F.col("k") <= F.col("drawn"), F.col("start") + F.col("k")).alias("rank"))
    return drawn.unionByName(outside)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED, **limits) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every row of ``docs``, those drawn towards ``target`` with a rank."""
    return ranked(cut(weighed(docs, bucket_gains(docs, target, buckets), seed)), percent, **limits)


def op13(spark, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is the bitwise division, eight steps a byte; features that repeat are hashed once.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, 0 AS side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS place FROM documents
  UNION ALL
  SELECT NULL, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), -row_number() OVER () FROM benchmark),
f AS (
  SELECT place, side, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS feature FROM d WHERE len(w) > 0),
bytes AS (
  SELECT feature, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda h: ('0x' || h)::BIGINT) AS bs FROM (SELECT DISTINCT feature FROM f)),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda r, step: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 10000 AS bucket
  FROM bytes),
fb AS (SELECT place, side, bucket FROM f JOIN hashed USING (feature)),
sums AS (SELECT count(*) FILTER (side = 0) AS alls, count(*) FILTER (side = 1) AS allt FROM fb),
gains AS (
  SELECT bucket, floor(1000 * ln(((count(*) FILTER (side = 1) + 1)::DOUBLE * (alls + 10000)::DOUBLE) / ((count(*) FILTER (side = 0) + 1)::DOUBLE * (allt + 10000)::DOUBLE)))::BIGINT AS gain
  FROM fb CROSS JOIN sums GROUP BY bucket, alls, allt),
weights AS (SELECT place, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fb JOIN gains USING (bucket) WHERE side = 0 GROUP BY place),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (place) WHERE d.side = 0),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, 25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS n_drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= n_drawn THEN r END AS rank FROM ranks
"""
