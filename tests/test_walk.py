import shlex

from pyspark.sql import functions as F

from lodestone.operators import branches as Br
from lodestone.operators import sessions as Se
from lodestone.sources import files, walk

# pattern, path, whether the pattern takes the path
GLOBS = [("a*c", "abbc", True), ("a*c", "ab/c", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("**/x", "ax", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**", "a/b/c", True), ("a/**", "ab", False),
         ("a**b", "axxb", True), ("a**b", "a/b", False), ("?.c", "x.c", True), ("?.c", "/.c", False), ("[a-c].h", "b.h", True), ("[a-c].h", "d.h", False), ("[!a-c].h", "d.h", True), ("[^a].h", "a.h", False), ("[!a]", "/", False), ("[]x]", "]", True),
         ("[z-a]", "m", False), ("[", "[", True), ("a[b", "a[b", True), (r"\*", "*", True), (r"\*", "x", False), (r"\!a", "!a", True), ("a.b", "axb", False), ("(a|b)+", "(a|b)+", True), ("$x^{2}", "$x^{2}", True), ("a&&b", "a&&b", True), ("[a&&b]", "&", True), ("[[]", "[", True), ("é*", "éa", True), ("", "", True)]


def test_globs(spark):
    rows = spark.createDataFrame(GLOBS, "pattern string, path string, want boolean")
    got = rows.select("pattern", "path", "want", F.regexp_like("path", walk.glob_regex(F.col("pattern"))).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def test_rules_in_order(spark):
    text = "# note\n\n*.o  \nkeep\\ \n!a.o\n/top\nsub/x\ndir/\n!\n/\n\\#x\r\n"
    one = spark.range(1).select(walk.rules_of(F.lit("b"), F.lit(text)).alias("rules"))
    ask = [("b/c/z.o", False, True), ("b/c/a.o", False, False), ("b/top", False, True), ("b/c/top", False, False), ("b/sub/x", False, True), ("b/c/sub/x", False, False), ("b/q/dir", True, True), ("b/q/dir", False, False), ("b/#x", False, True), ("b/keep ", False, True), ("c/z.o", False, False), ("bz.o", False, False)]
    rows = spark.createDataFrame(ask, "path string, is_dir boolean, want boolean").crossJoin(one)
    assert [r.path for r in rows.where(walk.is_ignored(F.col("path"), F.col("is_dir"), F.col("rules")) != F.col("want")).collect()] == []


def test_walk(spark, tmp_path):
    put = {".gitignore": b"*.txt\n/out\n", "a/.gitignore": b"!n.txt\n[ab].md\n", "a/n.txt": b"kept", "a/b/n.txt": b"kept too", "n.txt": b"x", "a/a.md": b"x", "a/_c.md": b"# Hi", "out/x.md": b"x", "sub/out/x.md": b"in", "e.md": b"", "_init_.py": b"x = 1", "a/vendor/v.c": b"x", "vendor": b"x", ".git/c.md": b"x", "big.json": b"1" * 65537, "big.md": b"y" * 65537, "z.c": b"a\x00b", "g.py": b"# Generated by a tool", "x.unknown": b"x"}
    for p, b in put.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(b)
    got = {r.path: (r.bucket, r.text) for r in walk.walked(spark, str(tmp_path)).collect()}
    taken = ("a/n.txt", "a/b/n.txt", "a/_c.md", "sub/out/x.md", "_init_.py", "big.md")
    assert {p: t for p, (b, t) in got.items() if b is None} == {p: put[p].decode() for p in taken}
    assert {p: b for p, (b, _) in got.items() if b} == {".gitignore": "hidden", "a/.gitignore": "hidden", ".git": "hidden", "n.txt": "ignored", "a/a.md": "ignored", "out": "ignored", "a/vendor": "vendored", "vendor": "other_type", "e.md": "binary_or_empty", "big.json": "large", "z.c": "binary_or_empty", "g.py": "generated_text", "x.unknown": "other_type"}
    (tmp_path / "none").mkdir()
    assert walk.walked(spark, str(tmp_path / "none")).count() == 0


def test_page_list(spark, tmp_path):
    pages = {"P-1": '{"id":"P-1","title":"é","keywords":["a",2],"createdAt":"1"}', "P-2": "{", "P-3": "[1]", "P-4": '{"id":"P-4","title":null}', "P-5": '{"id":"P-5","title":"","description":7,"updatedAt":"3"}'}
    for k, meta in pages.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / "meta.json").write_text(meta)
        (tmp_path / k / "page.html").write_text("<p>")
    got = {r.id: (r.problem, r.title, r.keywords, r.updatedAt, r.bytes) for r in files.page_list(spark, str(tmp_path)).collect()}
    assert got == {"P-1": (None, "é", ["a"], "1", 3), "P-2": ("unreadable", "", [], "", 3), "P-3": ("unreadable", "", [], "", 3), "P-4": ("no_title", "", [], "", 3), "P-5": (None, "", [], "3", 3)}


def test_ranges_of_refs(spark):
    commits = spark.createDataFrame([(10 * i, f"c{i}") for i in range(6)], "pos long, ref string")
    wanted = spark.createDataFrame([(1, "c1", "c4"), (2, "c4", "c1"), (3, "c2", "c2"), (4, "c0", "zz"), (5, None, "c1")], "request int, from string, to string")
    assert {r.request: tuple(r)[1:] for r in Br.ref_ranges(commits, wanted).collect()} == {1: ("ok", 10, 40, 4), 2: ("empty_range", None, None, None), 3: ("ok", 20, 20, 1), 4: ("not_found", None, None, None), 5: ("not_found", None, None, None)}


def test_finish_words(spark):
    names = ["plain/x.py", "two words", "it's", "$HOME", "a\nb", ""]
    row = spark.range(1).select(F.array(*map(F.lit, names)).alias("f"), Se.finish_message(F.lit("  A \n line (T-1)"), F.lit("T-1")).alias("m"), Se.finish_message(F.lit("A (T-11)"), F.lit("T-1")).alias("n"))
    got = row.select("m", "n", Se.finish_command(F.col("f"), F.col("m"), "log").alias("c"), Se.finish_comment(F.lit("S1"), F.col("m"), F.lit("T-1"), F.lit(" ok "), tests=F.lit("5 pass"), decided=F.lit(" ")).alias("t")).first()
    assert (got.m, got.n) == ("A line (T-1)", "A (T-11) (T-1)")
    assert shlex.split(got.c) == ["git", "add", "--", *names, "log", "&&", "git", "commit", "-m", got.m]
    assert got.t == 'Done in S1; git: "A line (T-1)" (`git log --grep T-1`).\n\n**Done.** ok\n\n**Tests.** 5 pass'
