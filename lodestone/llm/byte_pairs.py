"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A text is cut into pieces by the vocabulary's pattern; merges never cross a piece. The encoding of
every byte prefix of a piece ends in one token, and what stands before that token is the encoding of
the shorter prefix. So a piece is encoded by finding, prefix by prefix, the one vocabulary entry
that ends there and stands beside the last token before it (their joined bytes merge into just these
two). The table of last tokens is the whole state: reading it backwards gives the ids of any prefix;
more bytes lengthen it without touching what is there (:meth:`Encoded.append`); an edit re-cuts the
text from the last safe boundary before it to the first one behind it and keeps all other pieces
(:meth:`Encoded.replace`).

Documents are cut in two steps: at single spaces with something but white space on both sides, where no
match can cross, then by the pattern inside. What stands between two such spaces repeats, so its
ids and bytes are remembered in a bounded store of each worker; a text is then two joins of
remembered pieces. Decoding (:func:`decoded`) is a take from the table of token bytes.

Work is per row with no shuffle; a task holds one Arrow batch. Batches are cut again by bytes, so that a batch
of very long texts is encoded in parts.

Defined cases: a null text is an empty one, without ids. Special strings are ordinary text. Texts of any
length are encoded whole, a single piece of megabytes in time linear in its length. Bytes that are no
valid text cannot occur in Spark strings; decoding gives bytes, so ids that end inside a character are
no error; a null id in a list is passed over. Ties, repeated rows and other columns have no influence. An empty table gives an empty
result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Runs between single spaces, and pieces of the pattern, that a worker remembers in each of two generations.
REMEMBERED = 100_000
#: Pairs of tokens whose verdict is remembered, as a power of two; an entry gives way to the next pair of its slot.
PAIR_SLOTS = 20
#: Bytes of a piece up to which pieces are encoded side by side; a longer one is encoded alone.
SIDE_BY_SIDE = 1024
#: A single space with something but white space on both sides.
SAFE = r"(?<=\S)(?= \S)"
#: Bytes of text that are encoded before their ids are handed on.
BYTES_AT_ONCE = 2 << 20

NEVER = 1 << 40


class Generations:
    """A bounded store: what was not asked for since the last change of generations is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def lacking(self, keys: set) -> list:
        """The keys that are not there; those that are will stay for a generation."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        lacking, old, young = [], self.old, self.young
        for key in keys.difference(young):
            if (found := old.get(key)) is None:
                lacking.append(key)
            else:
                young[key] = found
        return lacking


class PairEncoder:
    """A vocabulary of byte tokens with ranks, and the pattern that cuts texts before merging."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        with open(vocabulary, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.cut = regex.compile(pattern).findall
        self.safe = regex.compile(SAFE)
        self.unsafe_space = regex.compile(r"\s (?!\S)|^ | $").search
        self.runs, self.pieces = Generations(REMEMBERED), Generations(REMEMBERED)
        self._parts_of_tokens()
        self._tree_of_tokens()
        # which sizes a token that ends in these two bytes can have, the longest first; a byte alone ends in any two
        sizes: dict[bytes, set[int]] = {}
        for token, i in self.ids.items():
            for tail in [token[-2:]] if len(token) > 1 else [bytes([x]) + token for x in range(256)]:
                if self.stands[i]:
                    sizes.setdefault(tail, set()).add(len(token))
        self.sizes = {tail: sorted(x, reverse=True) for tail, x in sizes.items()}
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.pair_keys, self.pair_verdicts = np.full(1 << PAIR_SLOTS, -1, np.int64), np.zeros(1 << PAIR_SLOTS, bool)

    def merge(self, text: bytes, to: int = 1) -> list[bytes]:
        """Byte pair merging in the order of ranks, until so many parts are left; used on tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > to:
            rank, at = min((self.ids.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts_of_tokens(self) -> None:
        """Of each token, the two parts of its last merge (-1: a byte, or no merges lead to it), and all pairs that join to a token."""
        n = max(self.tokens) + 1
        self.n, self.left, self.right, self.made, self.length = n, *(np.full(n, -1, np.int64) for _ in range(3)), np.zeros(n, np.int64)
        self.stands = np.zeros(n, bool)
        joined = {}
        for token, i in self.ids.items():
            self.length[i] = len(token)
            parts = self.merge(token, 2)
            self.stands[i] = len(parts) <= 2
            if len(parts) == 2:
                self.left[i], self.right[i], self.made[i] = self.ids[parts[0]], self.ids[parts[1]], i
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    joined[a * n + b] = i
        self.joined_keys = np.array(sorted(joined), np.int64)
        self.joined_to = np.array([joined[k] for k in self.joined_keys.tolist()], np.int64)

    def _tree_of_tokens(self) -> None:
        """A tree of bytes over the tokens that merges lead to."""
        children, token_at = [{}], [-1]
        for token, i in self.ids.items():
            if self.stands[i]:
                node = 0
                for byte in token:
                    if byte not in children[node]:
                        children[node][byte] = len(children)
                        children.append({})
                        token_at.append(-1)
                    node = children[node][byte]
                token_at[node] = i
        # inner nodes first, so that all leaves share one empty row
        order = sorted(range(len(children)), key=lambda k: not children[k])
        place = {node: k for k, node in enumerate(order)}
        self.inner = sum(map(bool, children))
        self.children = np.zeros((self.inner + 1, 256), np.int32)
        for node in order[: self.inner]:
            self.children[place[node], list(children[node])] = [place[x] for x in children[node].values()]
        self.token_at = np.array(token_at, np.int64)[order]

    def compare_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two tokens stay as they are when their bytes stand side by side.

        Seen backwards from the whole tokens, the later made of the two at the border falls into its parts. If the
        two that meet there could have joined before that one was made, they would have; of two equal merges the left
        one comes first.
        """
        ok = np.ones(len(a), bool)
        where, x, y, limit = np.arange(len(a)), a, b, np.full(len(a), NEVER)
        while len(where):
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.joined_keys, key), len(self.joined_keys) - 1)
            joins = (self.joined_keys[at] == key) & (self.joined_to[at] < limit)
            ok[where[joins]] = False
            mx, my = self.made[x], self.made[y]
            on = ~joins & ((mx >= 0) | (my >= 0))
            where, x, y, mx, my = where[on], x[on], y[on], mx[on], my[on]
            of_x = mx > my
            limit = np.where(of_x, mx, my + 1)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return ok

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`compare_pairs`, remembered."""
        key = a * self.n + b
        slot = (key * 0x9E3779B97F4A7C1 & (1 << 62) - 1) >> 62 - PAIR_SLOTS
        verdict, unknown = self.pair_verdicts[slot], np.flatnonzero(self.pair_keys[slot] != key)
        if len(unknown):
            keys, back = np.unique(key[unknown], return_inverse=True)
            found = self.compare_pairs(keys // self.n, keys % self.n)[back]
            verdict[unknown] = found
            # slots are filled by one write each, so that key and verdict belong together
            last = np.unique(slot[unknown][::-1], return_index=True)
            chosen = unknown[::-1][last[1]]
            self.pair_keys[last[0]], self.pair_verdicts[last[0]] = key[chosen], verdict[chosen]
        return verdict

    def last_tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Last token and token count of every prefix of every piece; entry k belongs to the prefix that ends with byte k of all pieces joined."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = begin + np.repeat(sizes, sizes)
        # all entries of the vocabulary that lie in a piece, from each byte down the tree
        start, node, found = np.arange(len(raw)), np.zeros(len(raw), np.int32), []
        depth = 0
        while len(start):
            node = self.children[np.minimum(node, self.inner), raw[start + depth]]
            start, node = start[node > 0], node[node > 0]
            depth += 1
            token = self.token_at[node]
            hit = token >= 0
            found.append((start[hit], np.full(hit.sum(), depth), token[hit]))
            on = start + depth < end[start]
            start, node = start[on], node[on]
        start, size, token = (np.concatenate(x) for x in zip(*found, strict=True))
        # prefixes of all pieces by their length; a prefix needs shorter ones only
        length = start + size - begin[start]
        order = np.argsort(length, kind="stable")
        start, size, token = start[order], size[order], token[order]
        bounds = np.searchsorted(length[order], np.arange(1, sizes.max(initial=0) + 2))
        last, count = np.full(len(raw), -1, np.int64), np.zeros(len(raw), np.int64)
        for low, high in zip(bounds, bounds[1:], strict=False):
            s, n, t = start[low:high], size[low:high], token[low:high]
            inside = s > begin[s]
            before = last[s - 1]
            ok = ~inside | (before >= 0)
            asked = np.flatnonzero(inside & ok)
            ok[asked] = self.side_by_side(before[asked], t[asked])
            s, n, t, inside = s[ok], n[ok], t[ok], inside[ok]
            last[s + n - 1], count[s + n - 1] = t, np.where(inside, count[s - 1], 0) + 1
        if (last < 0).any():
            raise ValueError(f"no token for byte {raw[np.flatnonzero(last < 0)[0]]}")
        return last, count

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        last, count = self.last_tokens(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end, begin = np.cumsum(sizes) - 1, np.cumsum(sizes) - sizes
        n = count[end]
        to = np.cumsum(n)
        out, slot = np.zeros(int(n.sum()), "<i4"), to - 1
        while len(end):  # backwards, the last token of every piece at once
            out[slot] = last[end]
            end, slot = end - self.length[last[end]], slot - 1
            on = end >= begin
            end, slot, begin = end[on], slot[on], begin[on]
        flat, bounds = out.tobytes(), np.r_[0, 4 * to].tolist()
        return [flat[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Lengthen ``last``, the last token of each prefix of 0 (-1), 1, ... bytes, to all prefixes of ``piece``."""
        last, ids, known, stands = list(last), self.ids, self.known_pairs, self.stands
        for end in range(len(last), len(piece) + 1):
            for n in self.sizes.get(piece[max(0, end - 2) : end], ()) if end > 1 else (1,):
                if n <= end and (token := ids.get(piece[end - n : end])) is not None and stands[token]:
                    if n == end:
                        break
                    before = last[end - n]
                    if (ok := known.get((before, token))) or ok is None and self.pair(before, token):
                        break
            else:
                raise ValueError(f"no token for byte {piece[end - 1]}")
            last.append(token)
        return last

    def pair(self, a: int, b: int) -> bool:
        if len(self.known_pairs) >= REMEMBERED:
            self.known_pairs.clear()
        ok = self.known_pairs[a, b] = bool(self.compare_pairs(np.array([a]), np.array([b]))[0])
        return ok

    def read_back(self, last: list[int], end: int) -> list[int]:
        """Ids of the prefix of ``end`` bytes, from the table of last tokens."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def runs_of(self, text: str) -> list[str]:
        """The text in parts that are cut alike alone and in the text."""
        if self.unsafe_space(text):
            return self.safe.split(text)
        first, *others = text.split(" ")
        return [first, *[" " + x for x in others]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        runs = [self.runs_of(t) for t in texts]
        known = self.runs
        lacking = known.lacking(set().union(*runs))
        cut = [self.cut(run) for run in lacking]
        self._learn(set().union(*cut))
        piece = self.pieces.young
        known.young.update((run, b"".join([piece[p] for p in parts])) for run, parts in zip(lacking, cut, strict=True))
        ids = known.young.__getitem__
        return [b"".join(map(ids, x)) for x in runs]

    def _learn(self, pieces: set[str]) -> None:
        """See that the store has the ids of these pieces."""
        known, short = self.pieces, {}
        for piece in known.lacking(pieces):
            raw = piece.encode()
            # the library takes a piece that is an entry as it is, whether merges lead to it or not
            if (whole := self.ids.get(raw)) is not None:
                known.young[piece] = np.array([whole], "<i4").tobytes()
            elif len(raw) <= SIDE_BY_SIDE:
                short[piece] = raw
            else:
                known.young[piece] = np.array(self.read_back(self.extend(raw, [-1]), len(raw)), "<i4").tobytes()
        if short:
            known.young.update(zip(short, self.encode_pieces(list(short.values())), strict=True))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoded:
    """A text with the prefix tables of its pieces, open to appends and edits."""

    def __init__(self, encoder: PairEncoder, text: str = ""):
        self.encoder, self.pieces, self.tables = encoder, [], []
        self.reencoded = 0  #: bytes whose last token was looked for
        self._set([], text, [])

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def _set(self, before: list[tuple], middle: str, after: list[tuple], known: tuple | None = None) -> None:
        """Pieces before and after stay with their tables; ``known``: a piece whose table serves as a beginning."""
        new = []
        for piece in self.encoder.cut(middle):
            raw, start = piece.encode(), [-1]
            if known and piece.startswith(known[0]):
                start, known = list(known[1]), None
            self.reencoded += len(raw) + 1 - len(start)
            new.append((piece, self.encoder.extend(raw, start)))
        whole = before + new + after
        self.pieces, self.tables = [p for p, _ in whole], [t for _, t in whole]

    def ids(self) -> list[int]:
        out: list[int] = []
        for piece, last in zip(self.pieces, self.tables, strict=True):
            whole = self.encoder.ids.get(piece.encode())
            out += [whole] if whole is not None else self.encoder.read_back(last, len(last) - 1)
        return out

    def append(self, more: str) -> None:
        self.replace(sum(map(len, self.pieces)), sum(map(len, self.pieces)), more)

    def replace(self, start: int, end: int, by: str) -> None:
        """Put ``by`` in place of the characters from ``start`` to before ``end``."""
        starts = np.cumsum([0, *map(len, self.pieces)])
        n = len(self.pieces)
        # a boundary is safe where a single space between two other characters begins a piece
        safe = [0, *[k for k in range(1, n) if self.pieces[k][0] == " " and not self.pieces[k].isspace() and not self.pieces[k - 1][-1].isspace()], n]
        first = max(k for k in safe if k == 0 or starts[k] + 1 < start)
        # the space and the character behind it, and the one before it, must lie behind the edit
        behind = min(k for k in safe if k == n or starts[k] > end)
        text = "".join(self.pieces[first:behind])
        middle = text[: start - starts[first]] + by + text[end - starts[first] :]
        held = list(zip(self.pieces, self.tables, strict=True))
        opened = next((held[k] for k in range(first, behind) if starts[k + 1] == start), None)
        self._set(held[:first], middle, held[behind:], opened)


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str) -> PairEncoder:
    return PairEncoder(vocabulary, pattern)


@lru_cache(maxsize=4)
def token_table(vocabulary: str) -> pa.Array:
    """Bytes of each id; ids that the file leaves out have none."""
    with open(vocabulary, "rb") as f:
        known = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())


def _named(vocabulary: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _parts(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BYTES_AT_ONCE; a single longer row is a part."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.fill_null(0).to_numpy(zero_copy_only=False)):
        if held and held + n > BYTES_AT_ONCE:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)


def _ids(texts: pa.Array, encode) -> pa.ListArray:
    found = encode([t or "" for t in texts.to_pylist()])
    offsets = np.cumsum([0, *[len(x) // 4 for x in found]], dtype=np.int64)
    flat = b"".join(found)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]))


def _bytes(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    flat = tokens.take(ids.flatten()).fill_null(b"")
    counts = np.r_[0, np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))]
    ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset) if len(flat) else np.zeros(1, np.int64)
    bounds = (ends - ends[0])[counts]
    data = flat.buffers()[2].slice(int(ends[0])) if len(flat) else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), data])


def encoded(docs: DataFrame, vocabulary: str | None = None, column: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, ids (the token ids of the whole text) for every row. ``vocabulary``: path of a rank file.

    ``with_bytes``: also what the ids decode to, as :func:`decoded` gives it, in the same pass.
    """
    path, pattern = _named(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens = encoder(path, pattern).encode_batch, token_table(path) if with_bytes else None
        for whole in batches:
            for batch in _parts(whole, pc.binary_length(whole.column(1))):
                ids = _ids(batch.column(1), encode)
                more = [_bytes(ids, tokens)] if with_bytes else []
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, *more], names=["doc_id", "ids", "bytes"][: 2 + with_bytes])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(column).alias("text")).mapInArrow(task, f"doc_id {kind}, ids array<int>" + ", bytes binary" * with_bytes)


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, bytes: what the ids stand for, as binary."""
    path, _ = _named(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_table(path)
        for whole in batches:
            for batch in _parts(whole, pc.multiply(pc.list_value_length(whole.column(1)), 4)):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(batch.column(1), tokens)], names=["doc_id", "ids", "bytes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(task, f"doc_id {kind}, ids array<int>, bytes binary")


def op12(spark, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents"), with_bytes=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
