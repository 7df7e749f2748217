"""Operators on small fixtures with known results, and properties on random ones."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import code, lines
from lodestone.functions import text as X
from lodestone.functions.chunks import chunk_spans, chunks
from lodestone.functions.snippet import snippet_of
from lodestone.operators import history as H
from lodestone.operators import retrieval as R
from lodestone.operators.layout import fitted, positions
from lodestone.sources import files, logs


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([(0, "alpha beta gamma delta"), (1, "alpha alpha beta"), (2, "alpha gamma gamma gamma"), (3, "beta delta")], "chunk long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha gamma"), (3, "delta"), (4, "Gamma")], "query long, text string")
    got = {}
    for r in R.top_k(R.bm25(docs, "chunk", {"text": 1}, q), 10, "query", "chunk").orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.chunk, pytest.approx(r.score, abs=1e-9)))
    assert got == {
        1: [(1, 0.5012728942), (0, 0.3259074568), (2, 0.3259074568)],
        2: [(2, 1.3638137062), (0, 0.9592623885), (1, 0.5012728942)],
        3: [(3, 0.8225730027), (0, 0.6333549318)],
        4: [(2, 1.0379062494), (0, 0.6333549318)],
    }


def test_terms_and_parts(spark):
    cases = {
        "IORING_SETUP_SQPOLL": (["ioring_setup_sqpoll"], ["ioring", "setup", "sqpoll"]),
        "CreateIoCompletionPort": (["createiocompletionport"], ["create", "io", "completion", "port"]),
        "IOCPHandle": (["iocphandle"], ["iocp", "handle"]),
        "int32_t sha256": (["int32_t", "sha256"], ["int", "32", "sha", "256"]),
        "Port": (["port"], []),
        "__init__": (["__init__"], ["init"]),
        "a-b.c/d e_f": (["a", "b", "c", "d", "e_f"], []),
        "É x": (["É", "x"], []),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.all_terms("t").alias("a"), F.transform(X.primary_terms("t"), X.fold).alias("p")).collect()
    for r in rows:
        assert r.p == cases[r.t][0] and [x for x in r.a if x not in r.p] == cases[r.t][1], r


def test_small_columns(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first().x
    assert ask(X.id_number(F.lit("D-12"))) == 12 and ask(X.id_number(F.lit("D-x"))) == 0
    assert [ask(X.duration_seconds(F.lit(d))) for d in ("90d", "36h", "0d", "90", "1y", "1M", "")] == [7776000, 129600, 0, None, None, None, None]
    assert ask(X.join_path(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d" and ask(X.join_path(F.lit("a"), F.lit("../../b"))) is None
    assert ask(X.utf8_clip(F.lit("aéé"), 4)) == "aé" and ask(X.utf8_clip(F.lit("日本"), 2)) == ""
    assert ask(X.chunk_header(F.lit("T"), F.lit("T > A"), F.lit("H"))) == "T > A > H"
    assert ask(X.chunk_header(F.lit("T"), F.lit(None).cast("string"), F.lit("T"))) == "T"
    assert ask(X.address_key(F.lit("http://a/b/index.html?q=1#x"))) == "http://a/b?q=1"
    assert ask(X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert ask(X.identifier_shaped(F.lit("io_uring_prep"))) and not ask(X.identifier_shaped(F.lit("how to poll")))


def test_fusion_fixtures(spark):
    def fuse(*lists):
        rows = [(1, n, i + 1, k) for n, keys in enumerate(lists) for i, k in enumerate(keys)]
        frame = spark.createDataFrame(rows, "query long, list_no int, rank int, key long")
        return [(r.key, r.score, r.tags) for r in R.fused_order(R.rrf(frame, "key"), "key", 10).orderBy("rank").collect()]

    assert [k for k, _, _ in fuse([1, 2, 3], [11, 12])] == [1, 11, 2, 12, 3]
    got = fuse([7, 1, 2], [9, 7])
    assert [k for k, _, _ in got] == [7, 9, 1, 2] and got[0][1] == pytest.approx(1 / 61 + 1 / 62) and [t for _, _, t in got] == [3, 2, 1, 1]
    scored = spark.createDataFrame([(1, 0, 1, 5, 4.0), (1, 0, 2, 6, 2.0), (1, 0, 3, 7, 1.0), (1, 1, 1, 6, 0.5)], "query long, list_no int, rank int, key long, score double")
    out = {r.key: r.score for r in R.score_fusion(scored, "key", {0: 0.4, 1: 0.6}).collect()}
    assert out == {5: pytest.approx(0.4), 6: pytest.approx(0.4 / 3 + 0.6), 7: 0.0}


def test_rerank_tail_keeps_its_order(spark):
    fused = spark.createDataFrame([(1, k, r) for r, k in enumerate([10, 11, 12, 13], 1)], "query long, key long, rank int")
    scores = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.1), (1, 13, 5.0)], "query long, key long, rerank double")
    assert [r.key for r in R.reranked(fused, "key", scores, 3).orderBy("final_rank").collect()] == [11, 12, 10, 13]


DIFFS = [
    ("a\nb\nc\n", "a\nb\nc\n", []),
    ("a\nb\nc\n", "a\nX\nc\n", [(2, 1, 2, 1)]),
    ("a\nb\nc\n", "a\nX\nY\nc\n", [(2, 1, 2, 2)]),
    ("a\nc\n", "a\nb\nc\n", [(2, 0, 2, 1)]),
    ("a\nb\nc\n", "a\nc\n", [(2, 1, 2, 0)]),
    ("", "a\nb\n", [(1, 0, 1, 2)]),
    ("a\nb\n", "a\nb", [(2, 1, 2, 1)]),
    ("a\n\nb\n", "X\n\nY\n", [(1, 3, 1, 3)]),
]


def test_line_differences():
    for old, new, want in DIFFS:
        assert lines.line_regions(old, new) == want, (old, new)
    two = lines.line_regions("a\nb\nc\nd\ne\n", "A\nb\nc\nD\ne\n")
    assert [r[2] for r in two] == [1, 4]
    assert lines.line_regions("a\nb\nc\n", "x\ny\nz\n", limit=1) == [(1, 3, 1, 3)]


texts = st.lists(st.sampled_from(["a", "b", "c", "", " ", "long line"]), max_size=14).flatmap(lambda x: st.sampled_from(["\n".join(x), "\n".join(x) + "\n" if x else ""]))


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_regions_rebuild_the_new_text(old, new):
    regions = lines.line_regions(old, new)
    assert lines.split_lines(lines.apply_regions(old, new, regions)) == lines.split_lines(new)
    assert all(b[0] >= a[0] + a[1] and b[2] >= a[2] + a[3] for a, b in zip(regions, regions[1:]))
    assert bool(regions) == (lines.split_lines(old) != lines.split_lines(new)) or not (old and new)


def test_picking_and_placing():
    regions = [(2, 1, 2, 1), (5, 0, 5, 3)]
    assert lines.pick_region(regions, 2, 2) == ("ok", (2, 1, 2, 1))
    assert lines.pick_region(regions, 6, 7) == ("ok", (5, 0, 6, 2))
    assert lines.pick_region(regions, 7, 9)[0] == "crosses" and lines.pick_region(regions, 20, 21)[0] == "none"
    parent = [((1, 0, 1, 2), ["p", "q"])]
    assert list(lines.place_on_parent(parent, [((4, 1, 4, 1), ["x"])])) == [("placed", (6, 1, 6, 1))]
    assert list(lines.place_on_parent([((4, 1, 4, 1), ["x"])], [((4, 1, 4, 1), ["x"])])) == [("done", None)]
    assert [s for s, _ in lines.place_on_parent([((4, 1, 4, 1), ["y"])], [((4, 1, 4, 1), ["x"]), ((9, 1, 9, 1), ["z"])])] == ["conflict", "left"]


def test_replay_rebuilds_random_histories(spark):
    rng, rows, want = random.Random(1), [], {}
    for f in range(8):
        cur = ""
        for pos in range(12):
            nxt = "\n".join(rng.choices("abcd", k=rng.randint(0, 8))) + "\n"
            for k, (os, ol, ns, nl) in enumerate(reversed(lines.line_regions(cur, nxt))):
                rows.append((f, pos * 100 + k, "edit", os, ol, ns, nl, lines.split_lines(nxt)[0][ns - 1 : ns - 1 + nl]))
            cur = nxt
        want[f] = lines.split_lines(cur)[0]
    frame = spark.createDataFrame(rows, "file long, pos long, op string, old_start int, old_lines int, new_start int, new_lines int, new_text array<string>").repartition(5)
    assert {r.file: r.lines for r in H.replay(frame).collect()} == want


def test_blame_finds_the_writing_edit(spark):
    rows = [("f", 1, "create", 1, 0, 1, 3, ["a", "b", "c"]), ("f", 2, "edit", 2, 1, 2, 2, ["X", "Y"]), ("f", 3, "edit", 1, 0, 1, 1, ["top"])]
    commits = spark.createDataFrame(rows, "file string, pos long, op string, old_start int, old_lines int, new_start int, new_lines int, new_text array<string>")
    asked = spark.createDataFrame([("f", i) for i in range(1, 6)], "file string, line int")
    assert {r.line: r.pos for r in H.blame(commits, asked).collect()} == {1: 3, 2: 1, 3: 2, 4: 2, 5: 1}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#\n`<h1>{}", max_size=400), st.sampled_from(["text", "markdown", "html", "code"]), st.integers(5, 60), st.integers(0, 20))
def test_chunks_cover_the_document(text, lang, target, overlap):
    spans = chunk_spans(text, lang, target, overlap)
    size = len(text.encode())
    if not size:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == size and all(0 <= a < b <= size for a, b, _, _ in spans)
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    raw = text.encode()
    assert all(raw[a:b].decode() is not None for a, b, _, _ in spans)


def test_markdown_headings(spark):
    text = "intro\n# One\n" + "x " * 300 + "\n## Two ##\n```\n# not a heading\n```\n" + "y " * 300
    got = chunk_spans(text, "markdown", 2000, 100)
    assert [(h, c) for _, _, h, c in got] == [(None, None), ("One", None), ("Two", "One")]
    assert chunks(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t", "markdown").count() == len(chunk_spans(text, "markdown"))


def test_snippets():
    text = "start " * 30 + "needle here and other words " + "tail " * 60
    s = snippet_of(text, ["needle", "other"])
    assert s.startswith("…") and s.endswith("…") and "needle here and other" in s
    assert snippet_of("short  text\nhere", []) == "short text here"


def test_code_readers():
    py = "import os\nfrom a.b import c\nclass K:\n    def f(self): pass\ndef g(): pass\n"
    assert code.symbols(py, "python") == [("K", "class", 3), ("f", "function", 4), ("g", "function", 5)]
    assert code.imports(py, "python") == [("os", False), ("a.b", False)]
    assert code.imports('#include <stdio.h>\n#include "x.h"\n', "c") == [("stdio.h", True), ("x.h", False)]
    assert [s for s, _, _ in code.symbols("export function a() {}\nclass B {}\nexport const c = 1\n", "ts")] == ["a", "B", "c"]
    src = 'x = "a" # note\nif y: 12'
    assert "".join(t for _, t in code.display_tokens(src)) == src and ("keyword", "if") in code.display_tokens(src)
    assert code.section_file("Intent: a\nmore\nBehavior: b", ("Intent", "Behavior")) == {"Intent": "a\nmore", "Behavior": "b"}
    with pytest.raises(ValueError):
        code.section_file("x\nIntent: a", ("Intent",))
    assert [code.typed_metadata(p)[1] for p in ("a=1", "a=1.5", "a=true", "a=01", "a=x=y")] == [1, 1.5, True, "01", "x=y"]
    assert 0 <= code.hash01("D-1") < 1


def test_layout_is_stable():
    p = positions(list(range(6)), [(0, 1), (1, 2)], 50)
    assert np.array_equal(p, positions(list(range(6)), [(0, 1), (1, 2)], 50))
    near = np.linalg.norm(p[0] - p[1])
    assert near < np.linalg.norm(p[0] - p[5]) * 2
    q = fitted(p, 100, 50)
    assert (q >= 0).all() and (q[:, 0] <= 100).all() and (q[:, 1] <= 50).all()


def test_document_log(spark, tmp_path):
    rec = [
        {"type": "document", "id": "D-1", "title": "a", "fetchedAt": "1"}, {"type": "touch", "id": "D-1", "fetchedAt": "5"}, {"type": "document", "id": "D-2", "title": "b", "fetchedAt": "2"},
        {"type": "forget", "id": "D-2"}, {"type": "strange", "id": "D-9"}, {"type": "document", "id": "D-3", "title": "c", "fetchedAt": "3"}, {"type": "document", "id": "D-3", "title": "c2", "fetchedAt": "4"},
        {"type": "link", "from": "D-1", "rel": "cites", "to": "D-3"}, {"type": "unlink", "from": "D-1", "rel": "cites", "to": "D-3"},
    ]
    (tmp_path / "documents.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rec) + '{"type": "document", "id": "D-4"')
    framed = logs.framed(spark, str(tmp_path))
    assert framed.where("not complete").count() == 1
    r = logs.records(framed, logs.DOCUMENT)
    assert r.where("bad").count() == 0
    log = r.select("pos", "r.*")
    assert {(x.id, x.title, x.fetched_at) for x in logs.fold_documents(log, values=("title",)).collect()} == {("D-1", "a", "5"), ("D-3", "c2", "4")}
    assert logs.fold_set(log, ["from", "rel", "to"], "pos", "type", "link", "unlink").count() == 0


def test_board_log(spark):
    rows = [
        {"op": "put", "item": {"id": "T-1", "kind": "ticket", "title": "a"}}, {"op": "comment", "ticket": "T-1", "author": "x", "body": "first", "at": "1"}, {"op": "archive", "id": "T-2", "at": "2"},
        {"op": "put", "item": {"id": "T-2", "kind": "ticket", "title": "b"}}, {"op": "put", "item": {"id": "T-1", "kind": "ticket", "title": "a2"}}, {"op": "comment", "ticket": "T-1", "author": "y", "body": "second", "at": "3"},
        {"op": "archive", "id": "T-1", "at": "4", "by": "me"}, {"op": "put", "item": {"id": "T-3", "kind": "ticket", "title": "c"}}, {"op": "delete", "id": "T-3", "at": "5"}, {"op": "mystery"},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "pos long, line string").select("pos", F.from_json("line", logs.BOARD).alias("r")).select("pos", "r.*")
    got = {r.id: r for r in logs.fold_board(frame).collect()}
    assert set(got) == {"T-1", "T-2"} and got["T-1"].item.title == "a2" and [c.body for c in got["T-1"].comments] == ["first", "second"]
    assert got["T-1"].archive.by == "me" and got["T-2"].archive is None


def test_chain_and_chunks(spark):
    import hashlib

    rows, prev = [], "0" * 64
    for i in range(5):
        rows.append(("m", i, f"line{i}", prev if i != 3 else "bad"))
        prev = hashlib.sha256(f"line{i}".encode()).hexdigest()
    frame = spark.createDataFrame(rows, "lineage string, pos long, line string, prev string")
    assert [r.pos for r in logs.chain_breaks(frame, "pos", "line", "prev", ["lineage"]).collect()] == [3]
    names = spark.createDataFrame([("m", 1), ("m", 2), ("m", 4)], "lineage string, n int")
    assert [r.n for r in logs.missing_chunks(names).collect()] == [4]


def test_folder_scan(spark, tmp_path):
    put = {"a.md": b"# Hi\n", ".hidden/x.md": b"x", "vendor/v.c": b"int x;", "b.bin": b"x", "package-lock.json": b"{}", "e.txt": b"", "n.txt": b"a\x00b", "g.py": b"# Generated by tool\n", "sub/t.txt": b"text", "big.txt": b"y" * ((1 << 20) + 1)}
    for p, b in put.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(b)
    got = {r.path: r.bucket for r in files.scan_folder(spark, f"file:{tmp_path}").collect()}
    # Spark's reader itself leaves out empty files and names that begin with a dot
    assert {k: v for k, v in got.items() if not k.startswith(".")} == {"a.md": None, "vendor/v.c": "vendored", "b.bin": "other_type", "package-lock.json": "generated_name", "n.txt": "binary_or_empty", "g.py": "generated_text", "sub/t.txt": None, "big.txt": "large"}


def test_buckets_in_order(spark):
    rows = [(".a/b.md", 1, b"x", "hidden"), ("e.txt", 0, b"", "binary_or_empty"), ("x.min.js", 1, b"x", "generated_name"), ("a.md", 1, None, "unreadable"), ("a.c", 2, b"\xff\xfe", "binary_or_empty")]
    frame = spark.createDataFrame(rows, "path string, size long, content binary, want string")
    assert frame.where(files.bucket_of(F.col("path"), F.col("size"), F.col("content")) != F.col("want")).count() == 0


def test_batch_is_all_or_nothing(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"path": "a", "text": "x"}\n{"path": "b", "text": ""}\n')
    assert files.read_batch(spark, str(good)).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"path": "a", "text": "x"}\n{"path": "b"}\n')
    with pytest.raises(Exception, match="batch_refused"):
        files.read_batch(spark, str(bad)).collect()


def test_pdf_paragraphs(spark):
    runs = [("p", i, 0.0, float(y), 10.0, t) for i, (y, t) in enumerate([(100, "Hello "), (100, "world"), (88, "same paragraph"), (76, "still"), (50, "new paragraph")])]
    frame = spark.createDataFrame(runs, "page string, pos long, x double, y double, h double, text string")
    assert files.pdf_paragraphs(frame, ["page"], "pos").first().text == "Hello world\nsame paragraph\nstill\n\nnew paragraph"


def test_tail(spark, tmp_path):
    from lodestone.streaming import tail

    log, state, mark = (str(tmp_path / n) for n in ("log", "state", "mark"))
    run = lambda: tail.tail_to_state(tail.stream_records(spark, log, "k string, pos long, v string"), state, mark, "k", "pos").awaitTermination()
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, pos long, v string").coalesce(1).write.mode("append").json(log)
    run()
    spark.createDataFrame([("a", 3, "z"), ("a", 0, "old")], "k string, pos long, v string").coalesce(1).write.mode("append").json(log)
    run()
    run()
    assert {(r.k, r.pos, r.v) for r in tail.current_state(spark, state).collect()} == {("a", 3, "z"), ("b", 2, "y")}


def test_layout_of_planes_is_that_of_pairs():
    """The same bits as from all differences at once, in a fraction of the time."""
    import time

    from lodestone.operators.layout import PULL, positions

    def plain(n, edges, steps):
        k = 1 / np.sqrt(n)
        turn = np.arange(n) * 2.399963
        p = np.stack([np.cos(turn), np.sin(turn)], axis=1) * np.sqrt((np.arange(n) + 0.5) / n)[:, None] / 2
        e = np.array(edges, dtype=int).reshape(-1, 2)
        for step in range(steps):
            diff = p[:, None] - p[None]
            move = -PULL * k * p + (diff * (k * k / ((diff**2).sum(axis=2) + 1e-9))[..., None]).sum(axis=1)
            diff = p[e[:, 0]] - p[e[:, 1]]
            pull = diff * (np.linalg.norm(diff, axis=1) / k)[:, None]
            np.add.at(move, e[:, 0], -pull)
            np.add.at(move, e[:, 1], pull)
            length = np.linalg.norm(move, axis=1, keepdims=True) + 1e-12
            p = p + move / length * np.minimum(length, 0.1 * (1 - step / steps))
        return p

    took = {plain: 0.0, positions: 0.0}
    for n in (2, 63, 64, 65, 600):
        edges, got = [(i, i // 2) for i in range(1, n)], []
        for f in took:
            began = time.process_time()
            got.append(f(n if f is plain else list(range(n)), edges, 5))
            took[f] += time.process_time() - began
        assert np.array_equal(*got)
    assert took[positions] < took[plain] / 2
