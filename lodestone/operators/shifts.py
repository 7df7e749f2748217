"""Replay and blame by a parallel scan over interval maps.

A run of edits is a map from the lines after it to where they come from: stretches of lines of the
text before the run, and stretches of lines that an edit of the run wrote. Two neighbouring runs
compose to the map of both, and composing is associative, so a file's log can be cut anywhere: each task
reads its range of the ordered edits as a stream, composes what it has of a file out of runs of a few hundred edits, and the
parts of a file are composed after that; a file with a third of all edits takes as many tasks as its edits fill. Lines are named by the
edit that wrote them (``source``) throughout, so the map of the whole log is the blame of the file; its text is fetched
at the end by a join.

Edits outside a file are clamped to it, which depends on how long the file is by then. So sizes come first for the files
that a range cuts (one at each end of a range at most): how many lines a part leaves, as a function of how many it finds, is its inserted
lines plus those found less the stretches that it removes (:class:`Sizes`), and these functions compose too. They hand
every part the size it starts from; a file inside a range starts empty.

Ranges are those of ``repartitionByRange(file, pos)``, which cut through a hot file.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.common import by_groups, cut, group_pieces
from lodestone.operators.history import GONE

EDITS_A_RUN = 512
FOREVER = 1 << 40
BEFORE = -1
#: Files, and stretches of them, that a task hands on at once.
FILES_AT_ONCE, STRETCHES_AT_ONCE = 2_000, 200_000
#: (source, first, end): lines first to before end, from 0, of what ``source`` wrote, or of the text before the run.
Segment = tuple[int, int, int]


class Sizes:
    """How many lines a run leaves of n: ``inserted`` + n - those of the first n that lie in ``removed``."""

    def __init__(self, inserted: int = 0, removed: list[tuple[int, int]] | None = None):
        self.inserted, self.removed = inserted, removed or []

    @classmethod
    def of_edit(cls, head: int, lines: int, written: int, gone: bool) -> Sizes:
        return cls(0, [(0, FOREVER)]) if gone else cls(written, [(head, head + lines)] if lines else [])

    def __call__(self, n: int) -> int:
        return self.inserted + n - sum(max(0, min(n, b) - a) for a, b in self.removed)

    def _reached(self, size: int) -> int:
        """The least n of which so many lines are left, ``FOREVER`` if there is none."""
        left, at = size - self.inserted, 0
        if left <= 0:
            return 0
        for a, b in self.removed:
            if at + left <= a:
                break
            left, at = left - max(0, a - at), b
        return min(at + left, FOREVER)

    def then(self, other: Sizes) -> Sizes:
        removed = sorted(self.removed + [(a, b) for a, b in ((self._reached(a), self._reached(b)) for a, b in other.removed) if a < b])
        merged: list[tuple[int, int]] = []
        for a, b in removed:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return Sizes(other(self.inserted), merged)


def edit_map(pos: int, head: int, lines: int, written: int, gone: bool, size: int) -> list[Segment]:
    """The map of one edit of a text of ``size`` lines."""
    if gone:
        return []
    head = min(head, size)
    return [s for s in ((BEFORE, 0, head), (pos, 0, written), (BEFORE, min(head + lines, size), size)) if s[1] < s[2]]


def composed(first: list[Segment], second: list[Segment]) -> list[Segment]:
    """The map of two runs, the second on what the first left."""
    starts, at = [], 0
    for _, a, b in first:
        starts.append(at)
        at += b - a
    out: list[Segment] = []

    def add(source: int, a: int, b: int) -> None:
        if out and out[-1][0] == source and out[-1][2] == a:
            out[-1] = (source, out[-1][1], b)
        else:
            out.append((source, a, b))

    for source, a, b in second:
        if source != BEFORE:
            add(source, a, b)
            continue
        k = bisect_right(starts, a) - 1
        while a < b and k < len(first):
            of, low, high = first[k]
            end = min(b, starts[k] + high - low)
            if a < end:
                add(of, low + a - starts[k], low + end - starts[k])
            a, k = max(a, end), k + 1
    return out


def all_composed(maps: list[list[Segment]]) -> list[Segment]:
    """Neighbours first, so that short maps meet short ones."""
    while len(maps) > 1:
        maps = [composed(maps[k], maps[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0]


def all_sizes(sizes: list[Sizes]) -> Sizes:
    """Neighbours first, as with maps."""
    while len(sizes) > 1:
        sizes = [sizes[k].then(sizes[k + 1]) if k + 1 < len(sizes) else sizes[k] for k in range(0, len(sizes), 2)]
    return sizes[0]


def edited(text: list[Segment], size: int, pos: int, head: int, lines: int, written: int, gone: bool) -> int:
    """One edit made in ``text`` of ``size`` lines; the lines it has then."""
    if gone:
        text.clear()
        return 0
    head = min(head, size)
    tail = min(head + lines, size)
    if head == tail and not written:
        return size
    first, at, n = 0, 0, len(text)
    while first < n:
        _, a, b = text[first]
        if at + b - a > head:
            break
        at, first = at + b - a, first + 1
    new = []
    if head > at:
        of, a, _ = text[first]
        new.append((of, a, a + head - at))
    if written:
        new.append((pos, 0, written))
    end = first
    while end < n:
        of, a, b = text[end]
        end += 1
        if at + b - a > tail:
            new.append((of, a + tail - at, b))
            break
        at += b - a
    text[first:end] = new
    return size - (tail - head) + written


def _lists(kind: pa.DataType, rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    """Rows (file, ...) as a batch; ``kind`` is the type of ``file``."""
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *types), strict=True)], ["file", *names])


_LONGS = pa.list_(pa.int64())
_SIZES = "file {kind}, part int, inserted long, removed_from array<long>, removed_to array<long>"
_MAP = "file {kind}, part int, last long, existing boolean, source array<long>, low array<long>, high array<long>"
_MAP_TYPES = (pa.int32(), pa.int64(), pa.bool_(), _LONGS, _LONGS, _LONGS)
_EDIT = ("at", "head", "cut_lines", "written", "gone")


def _sizes_task(edits_a_run: int):
    """The sizes of each part of a file, out of rows in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key, runs, run = None, None, [], []

        def ended() -> pa.RecordBatch:
            whole = all_sizes([*runs, all_sizes(run)])
            row = (*key, whole.inserted, [a for a, _ in whole.removed], [b for _, b in whole.removed])
            return _lists(kind, [row], ("part", "inserted", "removed_from", "removed_to"), (pa.int32(), pa.int64(), _LONGS, _LONGS))

        for batch in batches:
            kind = batch.schema.field("file").type
            columns = [batch.column(c).to_pylist() for c in ("file", "part", *_EDIT[1:])]
            for file, part, head, lines, written, gone in zip(*columns, strict=True):
                if key != (file, part):
                    if key is not None:
                        yield ended()
                    key, runs, run = (file, part), [], []
                elif len(run) == edits_a_run:
                    runs.append(all_sizes(run))
                    run = []
                run.append(Sizes.of_edit(head, lines, written, gone))
        if key is not None:
            yield ended()

    return task


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, part, start: the lines that each part of a file finds, out of sizes in order."""
    file, n, any_yet = None, 0, False
    for batch in batches:
        out = []
        for f, part, inserted, a, b in zip(*[batch.column(c).to_pylist() for c in ("file", "part", "inserted", "removed_from", "removed_to")], strict=True):
            if not any_yet or f != file:
                file, n, any_yet = f, 0, True
            out.append((f, part, n))
            n = Sizes(inserted, list(zip(a, b, strict=True)))(n)
        if out:
            yield _lists(batch.schema.field("file").type, out, ("part", "start"), (pa.int32(), pa.int64()))


def _map_row(file, part: int, last: int, existing: bool, whole: list[Segment]) -> tuple:
    return file, part, last, existing, [s for s, _, _ in whole], [a for _, a, _ in whole], [b for _, _, b in whole]


def _batches_of(rows: Iterator[tuple], kind: list) -> Iterator[pa.RecordBatch]:
    """Rows of maps in batches bounded by their stretches; ``kind`` has the type of ``file`` once there is a row."""
    out, n = [], 0
    for row in rows:
        out.append(row)
        n += len(row[4])
        if len(out) >= FILES_AT_ONCE or n >= STRETCHES_AT_ONCE:
            yield _lists(kind[0], out, ("part", "last", "existing", "source", "low", "high"), _MAP_TYPES)
            out, n = [], 0
    if out:
        yield _lists(kind[0], out, ("part", "last", "existing", "source", "low", "high"), _MAP_TYPES)


def _maps_task(edits_a_run: int):
    """The map of each part of a file, out of rows in order: runs of edits one by one, then runs of runs."""

    def rows(batches: Iterator[pa.RecordBatch], kind: list) -> Iterator[tuple]:
        key, n, last, existing, made, maps, text = None, 0, 0, True, 0, [], []
        for batch in batches:
            kind[:] = [batch.schema.field("file").type]
            for file, part, start, at, head, lines, written, gone in zip(*[batch.column(c).to_pylist() for c in ("file", "part", "start", *_EDIT)], strict=True):
                if key != (file, part):
                    if key is not None:
                        yield _map_row(*key, last, existing, all_composed([*maps, text]))
                    key, n, made, maps = (file, part), start or 0, 0, []
                    text = [(BEFORE, 0, n)] if n else []
                elif made == edits_a_run:
                    maps.append(text)
                    made, text = 0, [(BEFORE, 0, n)] if n else []
                n = edited(text, n, at, head, lines, written, gone)
                made, last, existing = made + 1, at, not gone
        if key is not None:
            yield _map_row(*key, last, existing, all_composed([*maps, text]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list = []
        yield from _batches_of(rows(batches, kind), kind)

    return task


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of each file, out of the maps of its parts in order."""
    kind: list = []

    def rows() -> Iterator[tuple]:
        held, maps = None, []
        for batch in batches:
            kind[:] = [batch.schema.field("file").type]
            for row in zip(*[batch.column(c).to_pylist() for c in ("file", "part", "last", "existing", "source", "low", "high")], strict=True):
                if held is not None and held[0] == row[0]:
                    maps = maps or [list(zip(*held[4:], strict=True))]
                    maps.append(list(zip(*row[4:], strict=True)))
                elif held is not None:
                    yield _map_row(*held[:4], all_composed(maps)) if maps else held
                    maps = []
                held = row
        if held is not None:
            yield _map_row(*held[:4], all_composed(maps)) if maps else held

    yield from _batches_of(rows(), kind)


def line_sources(commits: DataFrame, file: str = "file", pos: str = "pos", until: Column | None = None, edits_a_run: int = EDITS_A_RUN) -> DataFrame:
    """file, last, existing, source, low, high: for every file the stretches of its lines as of a position, with the edits that wrote them.

    ``commits``: file, pos (whole numbers, none twice in a file), op, old_start, old_lines, new_text. ``last`` is the position of the last edit.
    """
    rows = commits if until is None else commits.where(F.col(pos) <= until)
    gone = F.coalesce(F.col("op").isin(*GONE), F.lit(False))
    head, lines = F.greatest(F.col("old_start") - 1, F.lit(0)), F.col("old_lines")
    edits = rows.where(F.col(file).isNotNull()).select(
        F.col(file).alias("file"), F.col(pos).cast("long").alias("at"), head.cast("long").alias("head"), F.greatest(lines, F.lit(0)).cast("long").alias("cut_lines"),
        F.greatest(F.coalesce(F.size("new_text"), F.lit(0)), F.lit(0)).cast("long").alias("written"), gone.alias("gone"),
    )
    kind = rows.schema[file].dataType.simpleString()
    # written, since ranges are sampled and have to stay
    dealt = cut(edits.repartitionByRange(group_pieces(edits), "file", "at").sortWithinPartitions("file", "at").withColumn("part", F.spark_partition_id()))
    # files that lie in several ranges are the first or the last of each
    ends = dealt.groupBy("part").agg(F.min("file").alias("_a"), F.max("file").alias("_b")).select(F.explode(F.array_distinct(F.array("_a", "_b"))).alias("file"))
    parted = ends.groupBy("file").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("file")
    sizes = dealt.join(F.broadcast(parted), "file", "left_semi").mapInArrow(_sizes_task(edits_a_run), _SIZES.format(kind=kind))
    starts = by_groups(sizes, "file").sortWithinPartitions("file", "part").mapInArrow(_starts, f"file {kind}, part int, start long")
    maps = dealt.join(F.broadcast(starts), ["file", "part"], "left").mapInArrow(_maps_task(edits_a_run), _MAP.format(kind=kind))
    whole = by_groups(maps, "file").sortWithinPartitions("file", "part").mapInArrow(_files, _MAP.format(kind=kind))
    return whole.select(F.col("file").alias(file), "last", "existing", "source", "low", "high")


def blamed(sources: DataFrame, file: str = "file") -> DataFrame:
    """file, line (from 1), pos: the edit that wrote each line of each file."""
    sizes = F.transform(F.sequence(F.lit(0), F.size("low") - 1), lambda i: F.get("high", i) - F.get("low", i))
    has = sources.where(F.size("source") > 0).withColumn("_s", F.arrays_zip("source", "low", "high"))
    # lines before each segment, as running sums
    before = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = has.withColumn("_before", before).select(file, F.posexplode("_s").alias("_k", "_seg"), "_before").select(file, "_seg", F.get("_before", F.col("_k")).alias("_b"))
    return rows.select(file, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_seg.high") - F.col("_seg.low"))).alias("_i"), "_b", F.col("_seg.source").alias("pos")).select(file, (F.col("_b") + F.col("_i")).alias("line"), "pos")


def replayed(commits: DataFrame, file: str = "file", pos: str = "pos", until: Column | None = None, edits_a_run: int = EDITS_A_RUN) -> DataFrame:
    """file, lines, existing as of a position: the stretches of :func:`line_sources` with the text that their edits wrote."""
    sources = line_sources(commits, file, pos, until, edits_a_run)
    parts = sources.select(file, "existing", F.posexplode_outer(F.arrays_zip("source", "low", "high")).alias("_k", "_s")).select(file, "existing", "_k", "_s.*")
    texts = commits.where(F.size("new_text") > 0).select(F.col(file).alias("_file"), F.col(pos).cast("long").alias("_pos"), "new_text")
    text = F.slice("new_text", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    found = parts.join(texts, (F.col(file) == F.col("_file")) & (F.col("source") == F.col("_pos")), "left").select(file, "existing", F.when(F.col("_k").isNotNull(), F.struct("_k", text.alias("_text"))).alias("_s"))
    lines = F.flatten(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["_text"]))
    return found.groupBy(file).agg(lines.alias("lines"), F.any_value("existing").alias("existing"))
