"""Chunks of source text along its nesting, by windows over its lines; no grammar is needed.

Brackets outside strings and comments are counted line by line; their running sum is how deep a line begins. A unit of
depth d begins with each line that begins at d or less, and ends before the next. The whole text is cut into its units of depth 0, a unit
larger than the target into those of depth 1 inside it, and so on to ``DEEPEST``, below which every line is a unit. Neighbouring units that
fit together then become one chunk. A chunk is headed by the first lines of the large units it lies in, and its own first line.

Lines that only open a body or go on from the line before belong to it. A text whose brackets do not match (more than ``MOST_WRONG`` of them) has no
nesting to follow, and each of its lines is a unit, so that it is cut at line ends. A line longer than the target is a chunk of its own.

A text may be given whole or in pieces of whole lines. Lines are dealt by ranges of ``RANGE``; windows run inside a text's lines of one range, and
what goes on from range to range (sums, the last mark, the unit that is open, the chunk that is open) goes through tables of a row a text and range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.common import PIECES_A_CORE, bounded, cut, spread

DEEPEST, MOST_WRONG, HEADING = 4, 0.1, 80
#: Lines that are put in order together, about, and those below which a range is not made smaller to use all cores.
RANGE, LEAST = 50_000, 1_000
#: String literals, what one line has of block comments, and line comments.
STRINGS = r"""'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+\""""
WHOLE_COMMENTS, LINE_COMMENTS = r"/\*.*?\*/", r"//.*$|(?:^|\s)#(?:\s.*)?$"


def _count(c: Column, letters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, letters, ""))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each range in one piece again; the number is given, since pieces joined by their bytes, which say little of lines that repeat, grow large."""
    return rows.repartition(max(1, rows.rdd.getNumPartitions()), "_b")


def _before(key: str) -> tuple[Window, Window]:
    """A text's ranges before this one, and after it."""
    past = lambda c: Window.partitionBy(key).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    return past("_b"), past(F.desc("_b"))


def _ranged(docs: DataFrame, key: str, text: str, by: dict[str, str]) -> DataFrame:
    """key, by, _i, _p, line, size, _b: the lines, dealt by ranges of (key, by, _i, _p), which ``_b`` numbers in their order; ``_i`` keeps pieces of one place apart."""
    # counted before the lines are exploded, so that no line carries the text along
    pieces = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, *[F.col(c).alias(name) for name, c in by.items()], text, F.monotonically_increasing_id().alias("_i"))
    whole = spread(pieces, key, *by).select(key, *by, "_i", F.split(text, "\n").alias("_lines")).withColumn("_n", F.size("_lines"))
    n = whole.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, -(-n // RANGE), min(PIECES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, n // LEAST))
    lines = whole.select(key, *by, "_i", "_n", F.posexplode("_lines").alias("_p", "line"))
    lines = lines.where((F.col("line") != "") | (F.col("_p") < F.col("_n") - 1)).withColumn("size", F.octet_length("line").cast("long") + (F.col("_p") < F.col("_n") - 1).cast("long"))
    return lines.drop("_n").repartitionByRange(parts, key, *by, "_i", "_p").withColumn("_b", F.spark_partition_id())


def lines_with_depth(docs: DataFrame, key: str, text: str, *by: str) -> DataFrame:
    """key, n, line, size (bytes with the newline), at (byte it begins at), before, after (depths), goes_on, flat (brackets do not match), whole (bytes of the text), _b (its range).

    With ``by`` a text is given in pieces of whole lines, in the order of these columns.
    """
    by = {f"_k{i}": c for i, c in enumerate(by)}
    place = [*by, "_i", "_p"]
    lines = _ranged(docs, key, text, by)
    lines = lines.withColumn("_bare", F.regexp_replace(F.regexp_replace(F.regexp_replace("line", STRINGS, "_"), WHOLE_COMMENTS, ""), LINE_COMMENTS, ""))
    # 1: the line opens a comment that it does not close; -1: it closes one that an earlier line opened
    mark = F.when(F.col("_bare").contains("/*"), 1).when(F.col("_bare").contains("*/"), -1)
    lines = cut(lines.withColumn("_mark", mark))
    earlier, _ = _before(key)
    marks = lines.groupBy(key, "_b").agg(F.max(F.when(F.col("_mark").isNotNull(), F.struct(*place, "_mark"))).alias("_m"))
    marks = bounded(cut(marks.select(key, "_b", F.last("_m._mark", ignorenulls=True).over(earlier).alias("_earlier"))))
    order = Window.partitionBy(key, "_b").orderBy(*place)
    upto, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = _dealt(lines).join(marks, [key, "_b"])
    rows = rows.withColumn("_inside", F.coalesce(F.last("_mark", ignorenulls=True).over(past), F.col("_earlier"), F.lit(0)) == 1)
    code = F.when(F.col("_inside"), F.when(F.col("_mark") == -1, F.regexp_replace("_bare", r"^.*?\*/", "")).otherwise("")).otherwise(F.regexp_replace("_bare", r"/\*.*$", ""))
    rows = rows.withColumn("_code", code)
    opens, closes = _count(F.col("_code"), "{[("), _count(F.col("_code"), "}])")
    goes_on = F.trim("_code").rlike(r"^[{})\]]|^(?:else|catch|finally)\b") | (F.trim("line") == "")
    rows = rows.withColumns({"_delta": opens - closes, "_brackets": opens + closes, "goes_on": goes_on})
    rows = rows.withColumns({"_after": F.sum("_delta").over(upto), "_at": F.sum("size").over(upto) - F.col("size"), "_n": F.count(F.lit(1)).over(upto) - 1})
    rows = cut(rows.select(key, "_b", "line", "size", "goes_on", "_delta", "_brackets", "_after", "_at", "_n"))
    sums = rows.groupBy(key, "_b").agg(*[F.sum(c).alias(f"{c}s") for c in ("_delta", "size", "_brackets")], F.count(F.lit(1)).alias("_c"), F.min("_after").alias("_low"))
    base = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.withColumns({"_depth": base("_deltas"), "_byte": base("sizes"), "_line": base("_c")})
    of = Window.partitionBy(key)
    wrong = F.greatest(-F.min(F.col("_depth") + F.col("_low")).over(of), F.lit(0)) + F.abs(F.sum("_deltas").over(of))
    flat = wrong > MOST_WRONG * F.sum("_bracketss").over(of)
    sums = bounded(cut(sums.select(key, "_b", "_depth", "_byte", "_line", flat.alias("flat"), F.sum("sizes").over(of).alias("whole"))))
    after = F.col("_depth") + F.col("_after")
    return rows.join(sums, [key, "_b"]).select(
        key, (F.col("_line") + F.col("_n")).alias("n"), "line", "size", (F.col("_byte") + F.col("_at")).alias("at"), (after - F.col("_delta")).alias("before"), after.alias("after"), "goes_on", "flat", "whole", "_b"
    )


def units(lines: DataFrame, key: str, target: int) -> DataFrame:
    """key, at, whole, path, own, _b: a row for each unit, with the first lines of the large units that it lies in, and its own."""
    depths = range(DEEPEST + 1)
    first_line = F.substring(F.trim("line"), 1, HEADING)
    lines = lines.withColumns({f"_b{d}": (F.col("before") <= d) & ~F.col("goes_on") for d in depths})
    # what lies before the first unit goes with it from the first line on
    head = lambda d: F.when(F.col(f"_b{d}") | (F.col("n") == 0), F.struct("at", first_line.alias("own")))
    earlier, later = _before(key)
    ends = lines.groupBy(key, "_b").agg(*[F.min(head(d)["at"]).alias(f"_f{d}") for d in depths], *[F.max(head(d)).alias(f"_l{d}") for d in depths])
    ends = ends.select(key, "_b", *[F.last(f"_l{d}", ignorenulls=True).over(earlier).alias(f"_l{d}") for d in depths], *[F.last(f"_f{d}", ignorenulls=True).over(later).alias(f"_f{d}") for d in depths])
    rows = _dealt(lines).join(bounded(cut(ends)), [key, "_b"])
    of = Window.partitionBy(key, "_b")
    upto, past = of.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), of.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_h{d}": F.coalesce(F.last(head(d), ignorenulls=True).over(upto), F.col(f"_l{d}")) for d in depths})
    rows = rows.withColumns({f"_e{d}": F.coalesce(F.last(head(d)["at"], ignorenulls=True).over(past), F.col(f"_f{d}"), F.col("whole")) for d in depths})
    begins, heads, open_ = F.lit(False), [], ~F.col("flat")
    for d in depths:
        large = F.col(f"_e{d}") - F.col(f"_h{d}.at") > target
        begins = begins | (F.col(f"_b{d}") & open_)
        # a line that begins a unit heads it; what it lies in are the large units of lower depth
        heads.append(F.when(open_ & large & ~F.col(f"_b{d}"), F.col(f"_h{d}.own")))
        open_ = open_ & large
    path = F.concat_ws(" > ", F.array_distinct(F.filter(F.array(*heads), lambda h: h.isNotNull())))
    return rows.where(begins | open_ | F.col("flat") | (F.col("n") == 0)).select(key, "at", "whole", path.alias("path"), first_line.alias("own"), "_b")


def _of_key(rows: pd.DataFrame, key: str, by: str) -> Iterator[tuple[object, pd.DataFrame]]:
    rows = rows.sort_values([key, by], kind="stable", ignore_index=True)
    edges = np.flatnonzero(np.r_[True, rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1], True]) if len(rows) else [0]
    for i, j in zip(edges, edges[1:]):
        yield rows[key].iat[i], rows.iloc[i:j]


def _ways(rows: pd.DataFrame, key: str, target: int) -> pd.DataFrame:
    """For each unit of a range that may be the first to begin a chunk there: where it ends and begins, where the last chunk begins then, and how many do."""
    out = []
    for k, r in _of_key(rows, key, "at"):
        at, ends = r["at"].to_numpy(), np.append(r["at"].to_numpy()[1:], r["next"].iat[0])
        following = np.searchsorted(ends, at + target, "right").tolist()
        last, many = list(range(len(at))), [1] * len(at)
        for i in range(len(at) - 1, -1, -1):
            if i < (j := max(following[i], i + 1)) < len(at):
                last[i], many[i] = last[j], many[j] + 1
        # a chunk that is open before the range goes no further than one that began with it
        n = int(np.searchsorted(ends, at[0] + target, "right")) + 1
        out.append((k, r["_b"].iat[0], r["whole"].iat[0], ends[:n].tolist(), at[:n].tolist(), at[last[:n]].tolist(), many[:n]))
    return pd.DataFrame(out, columns=[key, "_b", "whole", "ends", "begins", "lasts", "many"])


def _entries(rows: pd.DataFrame, key: str, target: int) -> pd.DataFrame:
    """For each range of a text: where the chunk begins that is open before it, the number of chunks so far, and where the first one after it begins."""
    out = []
    for k, r in _of_key(rows, key, "_b"):
        open_, ordinal, found = -target - 1, 0, []
        for b, ends, begins, lasts, many in zip(r["_b"], r["ends"], r["begins"], r["lasts"], r["many"]):
            j = int(np.searchsorted(ends, open_ + target, "right"))
            found.append([k, b, open_, ordinal, begins[j] if j < len(ends) else None])
            if j < len(ends):
                open_, ordinal = lasts[j], ordinal + many[j]
        then = r["whole"].iat[0]
        for x in reversed(found):
            x[4], then = then, then if x[4] is None else x[4]
        out += found
    return pd.DataFrame(out, columns=[key, "_b", "open", "ordinal", "then"])


def _taken(rows: pd.DataFrame, key: str, target: int) -> pd.DataFrame:
    """The chunks that begin in a range."""
    out = []
    for _, r in _of_key(rows, key, "at"):
        at, ends = r["at"].to_numpy(), np.append(r["at"].to_numpy()[1:], r["next"].iat[0])
        i, cuts = int(np.searchsorted(ends, r["open"].iat[0] + target, "right")), []
        while i < len(at):
            cuts.append(i)
            i = max(int(np.searchsorted(ends, at[i] + target, "right")), i + 1)
        c = r.iloc[cuts]
        begins = c["at"].to_numpy()
        out.append(pd.DataFrame({key: c[key], "ordinal": (r["ordinal"].iat[0] + np.arange(len(cuts))).astype("int32"), "start": begins, "end": np.append(begins[1:], r["then"].iat[0])[: len(cuts)], "path": c["path"], "own": c["own"]}))
    return pd.concat(out) if out else pd.DataFrame(columns=[key, "ordinal", "start", "end", "path", "own"])


def nested_chunks(docs: DataFrame, key: str, text: str, target: int, *by: str) -> DataFrame:
    """key, ordinal, start, end, heading: chunks of ``target`` bytes at most where lines allow it; together they are the whole text.

    With ``by`` a text is given in pieces of whole lines, in the order of these columns.
    """
    rows = cut(units(lines_with_depth(docs, key, text, *by), key, target))
    kind, _later = rows.schema[key].dataType.simpleString(), _before(key)[1]
    # a unit ends where the next begins
    firsts = rows.groupBy(key, "_b").agg(F.min("at").alias("_first"), F.max("whole").alias("_whole"))
    firsts = bounded(cut(firsts.select(key, "_b", F.coalesce(F.last("_first").over(_later), F.col("_whole")).alias("next"))))
    dealt = lambda r: _dealt(r).join(firsts, [key, "_b"])
    # units in order; a chunk takes them while they fit, from range to range by the chunk that is open
    ways = dealt(rows.select(key, "_b", "at", "whole")).groupBy("_b").applyInPandas(lambda r: _ways(r, key, target), f"{key} {kind}, _b int, whole long, ends array<long>, begins array<long>, lasts array<long>, many array<long>")
    parts = max(1, rows.rdd.getNumPartitions())
    entries = cut(ways).groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_g")).applyInPandas(lambda r: _entries(r, key, target), f"{key} {kind}, _b int, open long, ordinal long, then long")
    taken = dealt(rows.drop("whole")).join(bounded(cut(entries)), [key, "_b"]).groupBy("_b").applyInPandas(lambda r: _taken(r, key, target), f"{key} {kind}, ordinal int, start long, end long, path string, own string")
    heading = F.concat_ws(" > ", F.when(F.col("path") != "", F.col("path")), F.col("own"))
    return taken.select(key, "ordinal", "start", "end", heading.alias("heading"))
