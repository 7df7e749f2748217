"""Commits, sessions, regions and display HTML on small cases."""

import random

from pyspark.sql import functions as F

from lodestone.functions import code as C
from lodestone.functions import lines as Ln
from lodestone.functions import text as X
from lodestone.functions.display import display_html, safe_href
from lodestone.operators import sessions as Se


def test_history_fold(spark):
    names = "pos long, type string, id string, session string, hash string, of string, user string, intent string, behavior string"
    rows = [
        (1, "commit", "C1", "S1", "h1", None, "a", "i1", "b1"), (2, "session_start", "S1", None, None, None, "a", None, None), (3, "commit", "C2", "S1", "h2", None, "a", "i2", "b2"),
        (4, "commit", "C3", None, "h3", None, None, None, None), (5, "amend", None, None, None, "h2", "b", "i2x", "b2x"), (6, "amend", None, None, None, "h2", None, "i2y", None), (7, "amend", None, None, None, "none", "b", "x", "x"), (8, "init", None, None, None, None, None, None, None),
    ]
    got = {r["pos"]: (r["orphan"], r["intent"], r["behavior"], r["amendments"], r["amended_by"]) for r in Se.commit_sessions(spark.createDataFrame(rows, names)).collect()}
    assert got == {1: (True, "i1", "b1", 0, None), 3: (False, "i2y", None, 2, None), 4: (True, None, None, 0, None)}
    assert Se.commit_sessions(spark.createDataFrame([], names)).count() == 0


def test_amendments_of_no_hash_and_of_a_hot_one(spark):
    names = "pos long, type string, id string, session string, hash string, of string, user string, intent string, behavior string"
    none = [(k, "amend", None, None, None, None, "u", "stray", None) for k in (2, 5)]
    rows = [(1, "commit", "C1", None, None, None, "a", "i1", None), (3, "commit", "C2", None, None, None, "a", "i2", None), (4, "commit", "C3", None, "h", None, "a", "i3", None), *none]
    hot = spark.range(10, 30_010).select(F.col("id").alias("pos"), F.lit("amend").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("id", "session", "hash")], F.lit("h").alias("of"), F.lit("b").alias("user"), F.concat(F.lit("to "), "id").alias("intent"), F.lit(None).cast("string").alias("behavior"))
    found = Se.commit_sessions(spark.createDataFrame(rows, names).union(hot))
    assert {r["pos"]: (r["intent"], r["amendments"], r["amended_by"]) for r in found.collect()} == {1: ("i1", 0, None), 3: ("i2", 0, None), 4: ("to 30009", 30_000, "b")}
    # a frame to the end of its group is read anew for each row
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_session_requests(spark):
    ops = [("end", "x"), ("start", " "), ("start", "a"), ("start", "b"), ("start", None), ("end", None), ("end", "x"), ("start", "c")]
    df = spark.createDataFrame([(1, i, *o) for i, o in enumerate(ops)], "k int, pos int, op string, msg string")
    got = [(r["answer"], r["session"]) for r in Se.session_requests(df, "k", "pos").orderBy("pos").collect()]
    assert got == [("no_active_session", None), ("message_required", None), ("ok", 1), ("session_active", None), ("message_required", None), ("ok", 1), ("no_active_session", None), ("ok", 2)]


def test_replaced_lines_equal_the_plain_function(spark):
    rng = random.Random(4)
    cases = [(i, [str(j) for j in range(rng.randint(0, 4))], rng.randint(-1, 6), rng.randint(-1, 3), ["x"] * rng.randint(0, 2)) for i in range(80)]
    df = spark.createDataFrame(cases, "i int, l array<string>, s int, n int, t array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", Ln.replaced(F.col("l"), F.col("s"), F.col("n"), F.col("t")).alias("r")).collect()}
    assert got == {i: Ln.replace_lines(a, s, n, t) for i, a, s, n, t in cases}


def test_committed_line_agrees_with_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        old = [f"l{j}" for j in range(rng.randint(1, 12))]
        new = [x for x in old if rng.random() < 0.8]
        for _ in range(rng.randint(0, 3)):
            new.insert(rng.randint(0, len(new)), f"n{rng.random()}")
        if new:
            rows.append((i, "\n".join(old) + "\n", "\n".join(new) + "\n"))
    df = spark.createDataFrame(rows, "i int, old string, new string").withColumn("r", Ln.diff_regions("old", "new"))
    df = df.withColumn("line", F.explode(F.sequence(F.lit(1), F.size(F.split("new", "\n")) - 1))).withColumn("at", Se.committed_line(F.col("r"), F.col("line")))
    for r in df.collect():
        if r["at"] is not None:
            assert r["old"].split("\n")[r["at"] - 1] == r["new"].split("\n")[r["line"] - 1]
        else:
            assert any(x["new_start"] <= r["line"] < x["new_start"] + x["new_lines"] for x in r["r"])


def test_display_html(spark):
    cases = {
        "<p>a<b>b<i>c</b>d": "<p>a<b>b<i>c</i></b>d</p>", "<script>x</script>y": "y", "<div>1 < 2 &amp; 3</div>": "1 &lt; 2 &amp; 3", "<a href='javascript:x'>t</a>": "t",
        "<a href=' java\tscript:x'>t</a>": '<a href="java\tscript:x">t</a>', "<a href='/p?q=1&amp;r'>t</a>": '<a href="/p?q=1&amp;r">t</a>', "": "", None: None, "<br/><hr>": "<br><hr>", "</p>x": "x", "<style>never closed": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r["h"]: r["s"] for r in df.select("h", display_html("h").alias("s")).collect()} == cases
    deep = display_html(F.lit("<b>" * 3000 + "x"))
    assert spark.range(1).select(deep.alias("s")).first()["s"].count("<b>") == 64
    hrefs = spark.createDataFrame([("\x00javascript:x",), ("HTTPS://a",), (None,), ("a:b",), ("a/b:c",)], "h string")
    assert [r[0] for r in hrefs.select(safe_href(F.col("h"))).collect()] == [None, "HTTPS://a", None, None, "a/b:c"]


def test_node_hash_and_marks(spark):
    texts = ["D-1", "", "é漢", "😀a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.node_hash("t")).collect()] == [None if t is None else C.hash01(t) for t in texts]
    m = spark.createDataFrame([("The a.b (x) theme", ["the", "a.b", "(x)", "theme", ""]), ("as is", []), (None, ["a"])], "t string, w array<string>")
    assert [r[0] for r in m.select(X.marked("t", "w")).collect()] == ["[The] [a.b] [(x)] [theme]", "as is", None]
