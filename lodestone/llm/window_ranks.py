"""Rolling window features from a persistent segment tree over length ranks.

Rows of a source are put in the order of time. A segment tree over the ranks of lengths counts the
rows of every rank range; each row makes a new version that shares all nodes but one path with the
version before, so version i is the tree of the first i rows. A window is the difference of two
versions: going down both roots at once finds its kth length. Sums are differences of prefix sums.
Distinct languages are rows whose previous row of the same language lies before the window: a
second tree, over these previous places, counts them.

Plan: rows that agree in source, time, length and language are counted first (combined before the
shuffle), so repeated rows cost one. Time is cut into blocks of a quarter of the longest window;
a block's task also gets the rows of one longest window before it, and answers each time of the
block once. So a row goes to five blocks, a source of a third of all rows is spread over its
blocks, and a task holds the distinct (time, length, language) of five quarters of a window whatever
the size of the table. With the event times of the registered query, ids that do not repeat give
15,400 rows at most. Answers come back to the documents by a sort-merge join on source and time;
nothing that grows is broadcast, sent to the driver or put through one task.

Defined cases: a null text has no length and is still an event; an empty one has length 0; a null
language is no language; a null source is a source of its own; a row without ``doc_id`` has no
time, lies in no window, and its own windows are empty. Rows at the same time do not see each other.
Repeated rows each count and each get their two rows. An empty table gives an empty result. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table

WINDOWS = (600, 43_200)
BLOCKS_A_WINDOW = 4
#: number ceil(p * m / 100) of m lengths
PERCENTILES = {"median_chars": 50, "high_chars": 90}


class PersistentTree:
    """Versions of a counting tree over whole numbers; version i holds the first i values with their weights.

    A node is named by its level and by the row that made it, 0 being the empty node: a row makes one node a level,
    so the path that it copies needs no other storage, and all versions are built a level at a time.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        n = len(values)
        self.depth = max(1, int(values.max(initial=0)).bit_length())
        self.count, self.left, self.right = [], [], []
        for level in range(self.depth + 1):
            prefix = values >> (self.depth - level)
            order = np.argsort(prefix, kind="stable")  # rows of a node together, in order of time
            first = np.r_[True, prefix[order][1:] != prefix[order][:-1]] if n else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            running = np.cumsum(weights[order])
            self.count.append(self._placed(order, running - (running - weights[order])[start]))
            if level < self.depth:
                goes_right = (values[order] >> (self.depth - level - 1)) & 1 == 1
                self.left.append(self._placed(order, self._latest(~goes_right, start, order)))
                self.right.append(self._placed(order, self._latest(goes_right, start, order)))

    @staticmethod
    def _placed(order: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order) + 1, np.int64)
        out[order + 1] = x
        return out

    @staticmethod
    def _latest(mine: np.ndarray, start: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The node of the last row up to here, within the parent's rows, that went to this side; 0 if none did."""
        at = np.maximum.accumulate(np.where(mine, np.arange(len(order)), -1))
        return np.where(at >= start, order[at] + 1, 0)

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The kth smallest (from 1) of the rows low + 1 .. high; undefined where there are fewer."""
        out = np.zeros(len(k), np.int64)
        for left, right, count in zip(self.left, self.right, self.count[1:], strict=True):
            there = count[left[high]] - count[left[low]]
            over = k > there
            k = k - np.where(over, there, 0)
            low, high = np.where(over, right[low], left[low]), np.where(over, right[high], left[high])
            out = 2 * out + over
        return out

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The weight of values under ``x`` in the rows low + 1 .. high."""
        out = np.zeros(len(x), np.int64)
        everything = x >= 1 << self.depth
        total = self.count[0][high] - self.count[0][low]
        for level, (left, right, count) in enumerate(zip(self.left, self.right, self.count[1:], strict=True)):
            over = (x >> (self.depth - level - 1)) & 1 == 1
            out += np.where(over, count[left[high]] - count[left[low]], 0)
            low, high = np.where(over, right[low], left[low]), np.where(over, right[high], left[high])
        return np.where(everything, total, out)


def previous_places(codes: np.ndarray) -> np.ndarray:
    """For each row the place (from 1) of the last row before it with the same code, 0 if there is none."""
    order = np.argsort(codes, kind="stable")
    same = np.r_[False, codes[order][1:] == codes[order][:-1]] if len(codes) else np.zeros(0, bool)
    out = np.zeros(len(codes), np.int64)
    out[order[same]] = order[np.flatnonzero(same) - 1] + 1
    return out


def window_answers(time, length, has_length, lang, has_lang, n, asked, windows: Sequence[int]) -> dict[str, np.ndarray]:
    """Features of the windows [t - W, t) for each asked time t and each W, W running fastest. Rows may come in any order."""
    order = np.argsort(time, kind="stable")
    time, length, has_length, lang, has_lang, n = (x[order] for x in (time, length, has_length, lang, has_lang, n))
    values, ranks = np.unique(length, return_inverse=True)
    with_length = n * has_length
    tree = PersistentTree(ranks, with_length)
    languages = PersistentTree(previous_places(lang), has_lang.astype(np.int64))
    before = lambda x: np.r_[0, np.cumsum(x)]
    events, chars, lengths = before(n), before(with_length * length), before(with_length)

    t, w = np.repeat(asked, len(windows)), np.tile(np.asarray(windows, np.int64), len(asked))
    low, high = np.searchsorted(time, t - w), np.searchsorted(time, t)
    m = lengths[high] - lengths[low]
    out = {"event_s": t, "window_s": w, "n_events": events[high] - events[low], "sum_chars": chars[high] - chars[low], "n_langs": languages.below(low, high, low + 1)}
    for name, p in PERCENTILES.items():
        at = tree.kth(low, high, -(-p * m // 100))
        out[name] = np.ma.masked_array(values[np.where(m > 0, at, 0)] if len(values) else at, m == 0)
    return out


def rolling_features(rows: DataFrame, windows: Sequence[int] = WINDOWS, blocks_a_window: int = BLOCKS_A_WINDOW) -> DataFrame:
    """source, event_s, window_s, n_events, sum_chars, n_langs, median_chars, high_chars for each source and time of ``rows``.

    ``rows``: source, event_s (seconds, not null), length, lang; one row an event.
    """
    longest = max(windows)
    block_s = max(1, longest // blocks_a_window)
    counted = rows.groupBy("source", "event_s", "length", "lang").agg(F.count(F.lit(1)).alias("n"))
    own, last = F.floor(F.col("event_s") / block_s), F.floor((F.col("event_s") + longest) / block_s)
    dealt = counted.select("*", own.alias("own"), F.explode(F.sequence(own, last)).alias("block"))

    def task(group: pa.Table) -> pa.Table:
        mine = lambda c, kind=np.int64: np.asarray(group[c].to_numpy(), kind)
        own_times = np.unique(mine("event_s")[mine("own") == mine("block")])
        lang = group["lang"].combine_chunks().dictionary_encode(null_encoding="encode").indices
        out = window_answers(
            mine("event_s"), np.asarray(group["length"].fill_null(0).to_numpy(), np.int64), np.asarray(group["length"].is_valid().to_numpy(), np.int64),
            np.asarray(lang.to_numpy(zero_copy_only=False), np.int64), np.asarray(group["lang"].is_valid().to_numpy(), bool), mine("n"), own_times, windows,
        )
        columns = {"source": pa.repeat(group["source"][0], len(out["event_s"])) if len(own_times) else pa.array([], group.schema.field("source").type)}
        for name, x in out.items():
            columns[name] = pa.array(np.ma.getdata(x), pa.int64(), mask=np.ma.getmaskarray(x))
        return pa.table(columns)

    kind = rows.schema["source"].dataType.simpleString()
    names = ", ".join(f"{c} long" for c in ("event_s", "window_s", "n_events", "sum_chars", "n_langs", *PERCENTILES))
    return dealt.groupBy("source", "block").applyInArrow(task, f"source {kind}, {names}")


def event_seconds(doc_id: Column) -> Column:
    """60 * floor((doc_id + crc32 of its decimal digits mod 10000) / 6), exact for long ids."""
    x = doc_id.cast("long") + F.crc32(doc_id.cast("string")) % 10_000
    return 10 * (x - F.pmod(x, F.lit(6)))


def document_windows(docs: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """doc_id, window_s, event_s and the features: a row for each row of ``docs`` and each window."""
    timed = docs.select("doc_id", "source", event_seconds(F.col("doc_id")).alias("event_s"))
    events = docs.select("source", event_seconds(F.col("doc_id")).alias("event_s"), F.length("text").cast("long").alias("length"), "lang")
    answers = rolling_features(events.where(F.col("event_s").isNotNull()), windows)
    answers = answers.select(F.col("source").alias("_source"), F.col("event_s").alias("_at"), *[c for c in answers.columns if c not in ("source", "event_s")])
    known = timed.where(F.col("event_s").isNotNull()).hint("merge")
    found = known.join(answers, F.col("source").eqNullSafe(F.col("_source")) & (F.col("event_s") == F.col("_at")))
    names = ["n_events", "sum_chars", "n_langs", *PERCENTILES]
    nothing = [F.lit(None if c in PERCENTILES else 0).cast("long").alias(c) for c in names]
    each = F.explode(F.array(*[F.lit(int(w)).cast("long") for w in windows]))
    untimed = timed.where(F.col("event_s").isNull()).select("doc_id", each.alias("window_s"), "event_s", *nothing)
    return found.select("doc_id", "window_s", "event_s", *names).unionByName(untimed)


def op11(spark, sf_dir: str) -> DataFrame:
    return document_windows(table(spark, sf_dir, "documents"))


#: crc32 of an id's digits is the bitwise division, eight steps a digit.
OP11_SQL = """
WITH d AS (
  SELECT doc_id, source, lang, length(text) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
        lambda r, step: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) AS h
  FROM documents),
t AS (SELECT *, (60 * floor((doc_id + h % 10000) / 6.0))::BIGINT AS event_s FROM d),
w AS (SELECT unnest([600, 43200])::BIGINT AS window_s),
k AS (SELECT DISTINCT source, event_s FROM t),
a AS (
  SELECT k.source, k.event_s, w.window_s, count(t.doc_id) AS n_events, coalesce(sum(t.n), 0)::BIGINT AS sum_chars, count(DISTINCT t.lang) AS n_langs,
    list_sort(list(t.n) FILTER (t.n IS NOT NULL)) AS ns
  FROM k CROSS JOIN w LEFT JOIN t ON t.source IS NOT DISTINCT FROM k.source AND t.event_s >= k.event_s - w.window_s AND t.event_s < k.event_s
  GROUP BY ALL)
SELECT t.doc_id, a.window_s, t.event_s, a.n_events, a.sum_chars, a.n_langs,
  ns[(len(ns) + 1) // 2]::BIGINT AS median_chars, ns[(90 * len(ns) + 99) // 100]::BIGINT AS high_chars
FROM t JOIN a ON t.source IS NOT DISTINCT FROM a.source AND t.event_s = a.event_s
"""
