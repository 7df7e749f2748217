"""Exact token counts at every prefix, by dynamic programming over byte pairs.

A text is cut into pieces by the vocabulary's pattern, and merges never cross a piece. Within a
piece the encoding of a prefix ends in some token t and is the encoding of the prefix before t
followed by t; of all vocabulary entries that end there, exactly one joins the encoding before it
without merging into it. So one pass over a piece gives the last token, and with it the count, of
every prefix. Whether two tokens can stand side by side is decided by merging their joined bytes,
and remembered.

Counts of a text add up over pieces; :meth:`PrefixCounter.prefix_counts` has the count of
every character prefix, encoded by itself, and answers truncation and budget questions
(:meth:`PrefixCounter.longest_within`) without encoding anything again. Where a prefix ends inside
a run of white space, or inside a contraction, the pattern cuts it differently from the
whole text; those few prefixes are cut again.

The registered query keeps the last entry of the prefix table (the whole text) and whether a limit
is passed. Pieces repeat, so their tables are remembered in a bounded store of each worker.

Defined cases: a null or empty text has 0 bytes and 0 tokens; the special string inside a text is
one token, as the library does it by default; surrogates cannot occur in Spark strings; nothing is
truncated. Ties, repeated rows and other columns have no influence. An empty table gives an empty
result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces (with their counts) and pairs that a worker remembers; the store is emptied when full.
REMEMBERED = 400_000
LIMIT = 512


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    def __init__(self, vocabulary: str, pattern: str):
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.ids = {as_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.cut = regex.compile(pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}

        class Counts(dict):
            def __missing__(counts, piece: str) -> int:  # noqa: N805
                if len(counts) >= REMEMBERED:
                    counts.clear()
                counts[piece] = n = self.table(piece.encode())[-1]
                return n

        self.counts = Counts()

    def merge(self, text: bytes) -> list[bytes]:
        """Byte pair merging in the order of ranks; used on two joined tokens at most."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, token: bytes) -> bool:
        if (ok := self.whole.get(token)) is None:
            ok = self.whole[token] = self.merge(token) == [token]
        return ok

    def side_by_side(self, a: bytes, b: bytes) -> bool:
        if (ok := self.joins.get((a, b))) is None:
            if len(self.joins) >= REMEMBERED:
                self.joins.clear()
            ok = self.joins[a, b] = self.merge(a + b) == [a, b]
        return ok

    def table(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one piece."""
        ids, joins, longest = self.ids, self.joins, self.longest
        counts, last = [0], [b""]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in ids:
                    if start == 0:
                        if self.stands(token):
                            break
                    elif (ok := joins.get((last[start], token))) or ok is None and self.side_by_side(last[start], token):
                        break
            counts.append(counts[start] + 1)
            last.append(token)
        return counts

    def parts(self, text: str) -> list[str]:
        return [p for p in self.split(text) if p] if self.split else [text]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of its pieces' prefix tables."""
        counts = self.counts
        if self.special and any(s in text for s in self.special):
            return sum(1 if part in self.special else sum(map(counts.__getitem__, self.cut(part))) for part in self.parts(text))
        return sum(map(counts.__getitem__, self.cut(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of text[:i], encoded by itself, for i from 0 to len(text)."""
        out, base = [0], 0
        before, begun = "", 0
        for part in self.parts(text):
            if part in self.special:
                # a prefix that stops inside the special string is ordinary text, one with what stands before
                out += [begun + self.count(before + part[:i]) for i in range(1, len(part))] + [base + 1]
                base += 1
                before, begun = "", base
                continue
            before, begun = part, base
            pieces = self.cut(part)
            for k, piece in enumerate(pieces):
                table, at = self.table(piece.encode()), 0
                for i, c in enumerate(piece, 1):
                    at += len(c.encode())
                    n = table[at]
                    if i < len(piece) and (piece[0] == "'" or piece[1:2] == "'") or piece.isspace():
                        n = self.count(piece[:i])
                    out.append(base + n)
                base += table[-1]
                if k and piece[0] == " " and pieces[k - 1].isspace():
                    # the run of white space that this piece's space belongs to ended the shorter prefix
                    out[-len(piece)] = base - table[-1] - self.counts[pieces[k - 1]] + self.count(pieces[k - 1] + " ")
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, n in enumerate(counts) if n <= budget)


@lru_cache(maxsize=4)
def counter(vocabulary: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(vocabulary, pattern)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``vocabulary``: path of a byte-level byte pair file."""
    import public_tokenizers

    path, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern).count
        for batch in batches:
            n = pa.array([count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
