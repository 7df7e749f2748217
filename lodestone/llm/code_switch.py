"""Language of words and texts by a linear-chain conditional random field.

Words (runs of letters) have affix, character n-gram, shape and lexicon features, hashed into a
table of weights for each language; learned transition weights tie neighbouring words. The field is
fitted by stochastic gradient on sequences put together from windows of texts of one and of several
languages, so that both staying and switching are learned. Labels come from whole texts: every word
of a training window has its text's language.

In use, forward-backward gives each word its distribution over languages given the whole text
(:func:`word_labels`); a text's distribution is the mean over its words. Texts of a batch advance
side by side, one word at a time, so a text of any length is handled whole. The weights of a word
are computed once and remembered in a bounded store of each worker.

The sample for fitting is bounded: about ``DOCS_PER_LANGUAGE`` documents of each language, chosen
by hash of the id, and of each a window of ``WINDOW`` words at a place chosen by hash. Prediction
covers every word of every row.

Defined cases: a text that is null or has no letter is ``und`` with score 0.0, and all are if no
row can be learned from; a null ``lang`` is never learned from; ties go to the language first in
order; repeated rows get equal results; a null ``doc_id`` is predicted like others, and learned
from as the empty text's checksum says. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCS_PER_LANGUAGE, WINDOW = 400, 80
SEQUENCES, ROUNDS, BATCH = 3_000, 4, 64
WEIGHTS = 1 << 16
REMEMBERED = 400_000
TEXTS_SIDE_BY_SIDE, WORDS_SIDE_BY_SIDE = 512, 375_000
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARKS = {"start": np.uint64(1), "end": np.uint64(2)}


def _hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Places in the table of weights for features of one kind, from their parts."""
    h = np.uint64(kind * int(_MIX) & (1 << 64) - 1)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _MIX
        h = h ^ (h >> np.uint64(31))
    return (h % np.uint64(WEIGHTS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all features of distinct words, sorted by owner: word, case, length, prefixes and suffixes of 1 to 3 letters, 2- and 3-grams with the word's ends, letters beyond ASCII, lexicon."""
    low = [w.lower() for w in words]
    n = np.array([len(w) for w in low], dtype=np.int64)
    letters = np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(low)), n)
    starts = np.cumsum(n) - n
    # with a mark before and after each word
    marked = np.empty(len(letters) + 2 * len(low), dtype=np.uint64)
    inside = np.arange(len(letters)) + 2 * owner + 1
    marked[inside] = letters
    marked[starts + 2 * np.arange(len(low))], marked[starts + n + 2 * np.arange(len(low)) + 1] = _MARKS["start"], _MARKS["end"]
    of = np.repeat(np.arange(len(low)), n + 2)
    out = []
    for k in (2, 3):
        ok = of[: len(of) - k + 1] == of[k - 1 :]
        out.append((of[: len(of) - k + 1][ok], _hashed(k, *[marked[i : len(marked) - k + 1 + i] for i in range(k)])[ok]))
    every = np.arange(len(low))
    for k in (1, 2, 3):
        long = n >= k
        out.append((every[long], _hashed(10 + k, *[letters[starts[long] + i] for i in range(k)])))
        out.append((every[long], _hashed(20 + k, *[letters[starts[long] + n[long] - k + i] for i in range(k)])))
    place = np.arange(len(letters)) - np.repeat(starts, n)
    whole = np.zeros(len(low), dtype=np.uint64)
    np.add.at(whole, owner, (letters + np.uint64(7)) * (_MIX ** (place.astype(np.uint64) + np.uint64(1))))
    out.append((every, _hashed(30, whole)))
    case = np.array([2 if w.isupper() else 1 if w[0].isupper() else 0 for w in words], dtype=np.uint64)
    out.append((every, _hashed(31, case)))
    out.append((every, _hashed(32, np.minimum(n, 12))))
    beyond = letters > 127
    out.append((owner[beyond], _hashed(33, letters[beyond])))
    known = np.array([lexicon.get(w, -1) for w in low], dtype=np.int64)
    out.append((every[known >= 0], _hashed(34, known[known >= 0])))
    owners, places = np.concatenate([o for o, _ in out]), np.concatenate([p for _, p in out])
    order = np.argsort(owners, kind="stable")
    return owners[order], places[order]


def side_by_side(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts joined end to end: the place of every word when words are ordered by (position, text), longer texts first; how many texts have each position; the order of texts."""
    order = np.argsort(-lengths, kind="stable")
    active = (lengths[None, :] > np.arange(lengths.max(initial=0))[:, None]).sum(axis=1) if lengths.max(initial=0) * len(lengths) < 1 << 24 else len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[order] = np.arange(len(lengths))
    begins = np.concatenate([[0], np.cumsum(active)])
    position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return begins[position] + np.repeat(rank, lengths), active, order


def forward_backward(emission: np.ndarray, active: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Distributions of all words, laid out as :func:`side_by_side` says; with ``pairs`` the sum of distributions of neighbours too."""
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    a = np.exp(transition - transition.max())
    begins = np.concatenate([[0], np.cumsum(active)])
    forward, backward = np.empty_like(e), np.ones_like(e)
    for t, n in enumerate(active):
        now = e[begins[t] : begins[t] + n]
        f = now if t == 0 else (forward[begins[t - 1] : begins[t - 1] + n] @ a) * now
        forward[begins[t] : begins[t] + n] = f / f.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        b = (backward[begins[t + 1] : begins[t + 1] + n] * e[begins[t + 1] : begins[t + 1] + n]) @ a.T
        backward[begins[t] : begins[t] + n] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both, None
    joint = np.zeros_like(a)
    for t in range(len(active) - 1):
        n = active[t + 1]
        left, right = forward[begins[t] : begins[t] + n], backward[begins[t + 1] : begins[t + 1] + n] * e[begins[t + 1] : begins[t + 1] + n]
        scale = np.einsum("ni,ij,nj->n", left, a, right)
        joint += np.einsum("ni,nj,n->ij", left, right, 1 / scale) * a
    return both, joint


class Field:
    def __init__(self, labels: Sequence[str], weights: np.ndarray, transition: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.weights, self.transition, self.lexicon = list(labels), weights, transition, lexicon
        self.rows: dict[str, int] = {}
        self.table = np.empty((1 << 16, len(self.labels)), dtype=np.float32)

    def learn_rows(self, words: set[str]) -> None:
        """Emissions of words not met yet, all at once."""
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        owner, place = features(new, self.lexicon)
        begins = np.searchsorted(owner, np.arange(len(new)))
        at = len(self.rows)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at : at + len(new)] = np.add.reduceat(self.weights[place], begins, axis=0)
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def __getstate__(self):
        return self.labels, self.weights, self.transition, self.lexicon

    def __setstate__(self, state):
        self.__init__(*state)

    def distributions(self, texts: list[list[str]]) -> list[np.ndarray]:
        """A row for each word of each text."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        if not lengths.sum():
            return [np.empty((0, len(self.labels)))] * len(texts)
        if len(self.rows) >= REMEMBERED:
            self.rows.clear()
        flat = list(chain.from_iterable(texts))
        self.learn_rows(set(flat))
        words = np.fromiter(map(self.rows.__getitem__, flat), dtype=np.int64, count=len(flat))
        place, active, _ = side_by_side(lengths)
        emission = np.empty((len(words), len(self.labels)))
        emission[place] = self.table[words]
        found = forward_backward(emission, active, self.transition)[0][place]
        return np.split(found, np.cumsum(lengths)[:-1])


def fit(samples: list[tuple[str, list[str]]], seed: int = 11) -> Field | None:
    """A field from (language, words) pairs."""
    samples = sorted((s for s in samples if s[1]), key=lambda s: (s[0], s[1]))
    if not samples:
        return None
    labels = sorted({s[0] for s in samples})
    number = {lab: i for i, lab in enumerate(labels)}
    seen: dict[str, Counter] = defaultdict(Counter)
    for lab, words in samples:
        for w in set(map(str.lower, words)):
            seen[w][lab] += 1
    lexicon = {w: number[c.most_common(1)[0][0]] for w, c in seen.items() if sum(c.values()) >= 5 and max(c.values()) >= 0.9 * sum(c.values())}
    rng = np.random.default_rng(seed)
    by = defaultdict(list)
    for lab, words in samples:
        by[lab].append(words)
    sequences = []
    for _ in range(SEQUENCES):
        words, tags = [], []
        for _ in range(rng.choice([1, 1, 2, 3])):
            lab = labels[rng.integers(len(labels))]
            source = by[lab][rng.integers(len(by[lab]))]
            at, n = rng.integers(len(source)), rng.integers(4, 20)
            words += source[at : at + n]
            tags += [number[lab]] * len(source[at : at + n])
        sequences.append((words, tags))
    vocabulary = sorted({w for words, _ in sequences for w in words})
    owner, place_of = features(vocabulary, lexicon)
    begins = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    nth, widest = {w: i for i, w in enumerate(vocabulary)}, int(np.diff(begins).max())
    table = np.full((len(vocabulary), widest), WEIGHTS)
    table[owner, np.arange(len(owner)) - begins[owner]] = place_of
    weights, transition = np.zeros((WEIGHTS + 1, len(labels))), np.zeros((len(labels), len(labels)))
    w_past, t_past = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)

    for _ in range(ROUNDS):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), BATCH):
            part = [sequences[i] for i in order[at : at + BATCH]]
            lengths = np.array([len(w) for w, _ in part])
            place, active, _ = side_by_side(lengths)
            f = np.empty((lengths.sum(), widest), dtype=np.int64)
            f[place] = table[[nth[w] for ws, _ in part for w in ws]]
            tags = np.empty(lengths.sum(), dtype=np.int64)
            tags[place] = [t for _, ts in part for t in ts]
            both, joint = forward_backward(weights[f].sum(axis=1), active, transition, pairs=True)
            error = -both
            error[np.arange(len(tags)), tags] += 1
            seen_pairs = np.zeros_like(transition)
            for _, ts in part:
                np.add.at(seen_pairs, (ts[:-1], ts[1:]), 1)
            rows, where = np.unique(f, return_inverse=True)
            step = np.stack([np.bincount(where.ravel(), np.repeat(error[:, k], widest), len(rows)) for k in range(len(labels))], axis=1)
            step = step / len(part) - 1e-4 * weights[rows]
            w_past[rows] += step**2
            weights[rows] += 0.2 * step / np.sqrt(w_past[rows])
            weights[WEIGHTS] = 0
            step = (seen_pairs - joint) / len(part)
            t_past += step**2
            transition += 0.2 * step / np.sqrt(t_past)
    return Field(labels, weights[:WEIGHTS].astype(np.float32), transition, lexicon)


def word_labels(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a code-switched text."""
    words = WORD.findall(text)
    best = [(d.argmax(), d.max()) for d in field.distributions([words])[0]]
    return [(w, field.labels[i], float(p)) for w, (i, p) in zip(words, best, strict=True)]


def sample_windows(docs: DataFrame, learnable: Column, per_language: int = DOCS_PER_LANGUAGE, window: int = WINDOW) -> list[tuple[str, list[str]]]:
    """A bounded sample of (language, words): languages are counted, then rows chosen by hash of the id."""
    usable = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.25 * per_language / n))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    at = F.pmod(F.xxhash64(F.lit("window"), "doc_id"), F.greatest(F.size("words") - window, F.lit(0)) + 1).cast("int") + 1
    chosen = usable.where(drawn < share[F.col("lang")]).select("lang", "doc_id", words.alias("words")).select("lang", F.slice("words", at, window).alias("words"))
    # repeated ids could pass the share by any number; this bound holds always
    return [(r.lang, r.words) for r in chosen.limit(2 * per_language * len(counts)).collect()]


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if field is None:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size: the table of weights and a bounded lexicon

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        labels = field.labels

        def judged(texts: list[list[str]]) -> tuple[list[str], list[float]]:
            means = [d.mean(axis=0) if len(d) else None for d in field.distributions(texts)]
            return [UNDETERMINED if m is None else labels[m.argmax()] for m in means], [0.0 if m is None else min(1.0, float(m.max())) for m in means]

        for batch in batches:
            names, scores, held, n = [], [], [], 0
            for text in batch.column(1):
                words = WORD.findall(text.as_py() or "")
                if held and (len(held) >= TEXTS_SIDE_BY_SIDE or n + len(words) > WORDS_SIDE_BY_SIDE):
                    a, b = judged(held)
                    names, scores, held, n = names + a, scores + b, [], 0
                held.append(words)
                n += len(words)
            a, b = judged(held) if held else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names + a, pa.string()), pa.array(scores + b, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, lang_pred string, score double")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(sample_windows(docs, ~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
