"""Chunks along the nesting of source text."""

import random

from lodestone.operators import nesting as N


def chunks(spark, text, target):
    rows = N.nested_chunks(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", target).orderBy("ordinal").collect()
    raw = (text or "").encode()
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    assert b"".join(raw[r.start : r.end] for r in rows) == raw
    return [(raw[r.start : r.end].decode(), r.heading) for r in rows]


METHOD = "  int {}(int x) {{\n    return x; // a '}}' in a comment\n  }}\n"


def test_a_text_that_fits_is_one_chunk(spark):
    assert chunks(spark, "int a;\nint b;\n", 100) == [("int a;\nint b;\n", "int a;")]
    assert chunks(spark, None, 100) == [] and chunks(spark, "", 100) == []


def test_small_units_go_together_and_large_ones_along_their_parts(spark):
    body = "".join(METHOD.format(f"m{i}") for i in range(4))
    text = "#include <x.h>\nint a;\n" + "class Big\n{\n" + body + "};\n" + "int z;\n"
    got = chunks(spark, text, 130)
    assert [h for _, h in got] == ["#include <x.h>", "class Big > int m1(int x) {", "class Big > int m3(int x) {"]
    assert got[1][0] == METHOD.format("m1") + METHOD.format("m2") and got[2][0].endswith("};\nint z;\n")
    assert all(len(c.encode()) <= 130 for c, _ in got)


def test_strings_and_comments_hold_no_brackets(spark):
    text = 'f("}}}{", \'{\');\n/* {{{\n {{ */ g();\n// {\nh(1);\n'
    rows = N.lines_with_depth(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("n").collect()
    assert [(r.before, r.after) for r in rows] == [(0, 0)] * 5


def test_what_does_not_match_is_cut_at_lines(spark):
    text = "".join(f"}} line {i} {{ {{ {{\n" for i in range(30))
    got = chunks(spark, text, 60)
    assert all(len(c) <= 60 and c.endswith("\n") for c, _ in got) and len(got) >= 10


def test_long_lines_and_deep_nesting(spark):
    text = "{\n" * 10 + "x" * 500 + "\n" + "}\n" * 10
    got = chunks(spark, text, 100)
    assert max(len(c) for c, _ in got) == 501
    deep = "".join("  " * i + f"block{i} {{\n" for i in range(8)) + "".join(f"stmt{i};\n" for i in range(40)) + "}\n" * 8
    assert all(len(c) <= 120 for c, _ in chunks(spark, deep, 120))


def written(seed):
    """Random code of a few hundred lines: nested blocks, comments over many lines, now and then a long line."""
    rng, out, depth = random.Random(seed), [], 0
    for i in range(rng.randint(1, 300)):
        kind = rng.random()
        out.append("  " * depth + ("{ /* open" if kind < 0.02 else "closed */" if kind < 0.06 else f"f{i}(" + "x" * rng.choice([3, 9, 200]) + ");" if kind < 0.6 else f"block{i} {{" if kind < 0.8 else "}" if kind < 0.97 else ""))
        depth = max(0, depth + (0.6 <= kind < 0.8) - (0.8 <= kind < 0.97))
    return "\n".join(out + ["}"] * depth) + rng.choice(["", "\n"])


def test_chunks_do_not_depend_on_ranges_or_pieces(spark, monkeypatch):
    texts = [(f"t{i}", written(i)) for i in range(12)]
    docs = spark.createDataFrame(texts, "id string, text string")
    lines = [(k, i // 3, i, x) for k, t in texts for i, x in enumerate(t.splitlines(keepends=True))]
    pieces = spark.createDataFrame(lines, "id string, place int, line int, text string")
    got = lambda d, *by: sorted(map(tuple, N.nested_chunks(d, "id", "text", 120, *by).collect()))
    whole = got(docs)
    assert len({r[0] for r in whole}) > 9 and len(whole) > 100
    monkeypatch.setattr(N, "RANGE", 37)  # many ranges a text; before, all lines of a text were ordered by one task
    assert got(docs) == whole
    assert got(pieces, "place", "line") == whole
