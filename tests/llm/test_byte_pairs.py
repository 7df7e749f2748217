"""Prefix tables against the tokenizer library, edits against encoding anew."""

import base64
import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import byte_pairs as B

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "\n", "\t", "a", "the", " the", " quick", "'s", "é", "日本", "12", "!", " ", "　", "\x1c", "\x85", "\r\n", " \n", "'", "x" * 9, "<|endoftext|>", "😀"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encoder():
    return B.encoder(PATH, P.PATTERN)


def test_texts_agree_with_the_library(library, encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(3000)]
    texts += [f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}!" for c in [*range(0x3000), *range(0xF900, 0x10400)]]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library(text), text
        assert encoder.decode(np.frombuffer(ids, "<i4").tolist()) == text.encode()


def test_pairs_agree_with_merging(encoder):
    rng = random.Random(3)
    ids = list(encoder.tokens)
    a, b = (np.array(rng.choices(ids, k=4000)) for _ in range(2))
    want = [encoder.merge(encoder.tokens[x] + encoder.tokens[y]) == [encoder.tokens[x], encoder.tokens[y]] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert encoder.compare_pairs(a, b).tolist() == want and encoder.side_by_side(a, b).tolist() == want
    assert encoder.side_by_side(a, b).tolist() == want  # remembered


def test_every_prefix_has_its_last_token(library, encoder):
    piece = "internationalisation".encode()
    last, count = encoder.last_tokens([piece, b"x", piece[:7]])
    table = encoder.extend(piece, [-1])
    assert table[1:] == last[: len(piece)].tolist()
    for end in range(1, len(piece) + 1):
        assert encoder.read_back(table, end) == library(piece[:end].decode()) and count[end - 1] == len(library(piece[:end].decode()))


def test_long_pieces(library, encoder):
    rng = random.Random(2)
    for text in ("x" * 200_000, "".join(rng.choices("abcdefghij", k=60_000)), "日本語" * 20_000):
        assert encoder.encode(text) == library(text)


def test_edits_agree_with_encoding_anew(library, encoder):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 25)))
        held = B.Encoded(encoder, text)
        for _ in range(4):
            more = "".join(rng.choices(PARTS, k=rng.randint(0, 3)))
            if rng.random() < 0.4:
                held.append(more)
                text += more
            else:
                a = rng.randint(0, len(text))
                b = rng.randint(a, min(len(text), a + 5))
                held.replace(a, b, more)
                text = text[:a] + more + text[b:]
            assert held.text == text and held.ids() == library(text)


def test_edits_touch_what_is_near(encoder):
    held = B.Encoded(encoder, "the quick fox " * 5000)
    before = held.reencoded
    held.append("runs")
    held.replace(30_000, 30_003, "dog")
    assert held.reencoded - before < 100


def test_query_on_odd_rows(spark, library):
    texts = [None, "", "plain text", "plain text", " ", "a" * 5000, "日本語のテキスト", "the \n\n quick  ", "<|endoftext|> special", "long " * 300_000]
    frame = spark.createDataFrame([(i if i else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, bytes string")
    both = B.encoded(frame, with_bytes=True).collect()
    apart = B.decoded(B.encoded(frame)).collect()
    assert sorted(map(str, both)) == sorted(map(str, apart))
    for r in both:
        text = texts[r.doc_id or 0] or ""
        assert list(r.ids) == library(text) and bytes(r.bytes) == text.encode()
    assert B.encoded(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [262, None, 11]), (2, None), (3, [])], "doc_id long, ids array<int>")
    tokens = B.encoder(PATH, P.PATTERN).tokens
    assert {r.doc_id: bytes(r.bytes) for r in B.decoded(odd).collect()} == {1: tokens[262] + tokens[11], 2: b"", 3: b""}


def test_registered_query(spark, library, tmp_path):
    texts = ["one two three", None, "fünf sechs"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in B.op12(spark, str(tmp_path)).collect():
        ids = library(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
