"""Structural chunks of documents, in UTF-8 byte offsets.

Markdown splits at headings outside fences, HTML at h1-h6, code at top-level declarations; text is
one section. Small sibling sections of Markdown and HTML go together; sections longer than the
target are cut to overlapping windows that end at a line or a space where one is near.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import BYTES_PER_TOKEN, OVERLAP_TOKENS, TARGET_TOKENS

TARGET, OVERLAP = TARGET_TOKENS * BYTES_PER_TOKEN, OVERLAP_TOKENS * BYTES_PER_TOKEN
SCHEMA = "ordinal int, start long, end long, tokens long, heading string, context string"
HEADING_BYTES = 200


class Section(NamedTuple):
    start: int
    heading: str | None
    context: str | None


def _title(raw: bytes) -> str | None:
    raw = raw.strip(b" \t\r")
    cut = raw[:HEADING_BYTES].decode("utf-8", "ignore")
    return cut or None


def _markdown(text: bytes) -> Iterator[tuple[int, int, str | None]]:
    fenced, at = False, 0
    for line in text.split(b"\n"):
        if line.startswith((b"```", b"~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(rb"(#{1,6})[ \t](.*)", line, re.S)):
            title = _title(m[2])
            title = _title(title.encode().rstrip(b"#")) if title else None
            yield at, len(m[1]), title
        at += len(line) + 1


def _html(text: bytes) -> Iterator[tuple[int, int, str | None]]:
    for m in re.finditer(rb"<[hH]([1-6])(?=[> \t\n\r/])", text):
        open_end = text.find(b">", m.end(1))
        body = open_end + 1 if open_end >= 0 else len(text)
        close = re.compile(rb"</[hH]" + m[1]).search(text, body)
        inner = re.sub(rb"<[^>]*(>|\Z)", b"", text[body : close.start() if close else len(text)])
        yield m.start(), int(m[1]), b" ".join(inner.split()).decode("utf-8", "ignore") or None


_DECLARES = re.compile(rb"^(?:(?:export|public|private|static|async|pub|default|abstract|final)\s+)*(?:def|class|func|function|fn|struct|enum|interface|impl|trait|type|module|namespace|const|let|var|[A-Za-z_][\w\s*&<>,:]*\()")
_COMMENT = re.compile(rb"^(?:#|//|/\*|\*|--|\"\"\"|@)")


def _code(text: bytes) -> Iterator[tuple[int, int, str | None]]:
    """Declarations at the left margin and outside braces; comments and decorators right above belong to them."""
    at, depth, lead = 0, 0, None
    for line in text.split(b"\n"):
        if depth == 0 and line[:1].strip():
            if _COMMENT.match(line):
                lead = at if lead is None else lead
            else:
                if _DECLARES.match(line):
                    yield (at if lead is None else lead), 1, _title(line.split(b"{")[0].rstrip(b" :("))
                lead = None
        elif not line.strip():
            lead = None
        depth = max(0, depth + line.count(b"{") - line.count(b"}"))
        at += len(line) + 1


def sections(text: bytes, lang: str) -> list[Section]:
    found = {"markdown": _markdown, "html": _html, "code": _code}.get(lang, lambda _: iter(()))(text)
    out, trail = [Section(0, None, None)], [None] * 7
    for start, level, heading in found:
        context = " > ".join(h for h in trail[1:level] if h) or None
        if out[-1].start == start:
            out.pop()
        out.append(Section(start, heading, context))
        trail[level:] = [heading] + [None] * (6 - level)
    return out


def _merged(found: list[Section], end: int, target: int) -> list[Section]:
    ends = [s.start for s in found[1:]] + [end]
    out: list[Section] = []
    for s, stop in zip(found, ends):
        if out:
            p = out[-1]
            both = p.heading and s.heading and p.context == s.context
            if both and s.start - p.start < target // 8 and stop - s.start < target // 8 and stop - p.start <= target:
                continue
        out.append(s)
    return out


def _windows(text: bytes, start: int, end: int, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    while end - start > target:
        want = start + target
        floor = max(want - target // 5, start + 1)
        stop = max(text.rfind(b"\n", floor, want), -1) + 1 or text.rfind(b" ", floor, want) + 1 or want
        while stop < end and 0x80 <= text[stop] < 0xC0:  # not inside a character
            stop -= 1
        stop = stop if stop > start else want
        yield start, stop
        start = max(start + 1, stop - overlap)
        while start < end and 0x80 <= text[start] < 0xC0:
            start += 1
    if start < end:
        yield start, end


def chunk_spans(text: str, lang: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int, str | None, str | None]]:
    """(start, end, heading, context) in bytes; first starts at 0, last ends at the length, none lies outside."""
    raw = text.encode()
    if not raw:
        return []
    overlap = overlap if overlap < target else target // 2
    found = sections(raw, lang)
    if lang in ("markdown", "html"):
        found = _merged(found, len(raw), target)
    ends = [s.start for s in found[1:]] + [len(raw)]
    return [(a, b, s.heading, s.context) for s, end in zip(found, ends) for a, b in _windows(raw, s.start, end, max(target, 1), overlap)]


def chunks(docs: DataFrame, key: str, text: str, lang: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """key, ordinal, start, end, tokens, heading, context of all chunks; ``lang`` is text, markdown, html or code."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, i, a, b, -(-(b - a) // BYTES_PER_TOKEN), h, c) for k, t in zip(rows[key], rows[text]) for i, (a, b, h, c) in enumerate(chunk_spans(t or "", lang, target, overlap))]
            yield pd.DataFrame(out, columns=[key, "ordinal", "start", "end", "tokens", "heading", "context"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text)).mapInPandas(task, f"{key} {kind}, {SCHEMA}")


def symbol_chunks(docs: DataFrame, key: str, text: str, lang: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """key, name, kind, at, ordinal: every declaration with the byte on which its line begins and the chunks that hold that byte."""
    from lodestone.functions.code import symbols_of

    named = docs.select(key, F.split(text, "\n").alias("_l"), F.explode(symbols_of(text, lang)).alias("_s"))
    at = F.aggregate(F.slice("_l", F.lit(1), F.greatest(F.col("_s.line") - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)
    starts = named.select(key, "_s.name", "_s.kind", at.alias("at"))
    spans = chunks(docs, key, text, "code", target, overlap).select(key, "ordinal", "start", "end")
    return starts.join(spans, key).where("start <= at and at < end").select(key, "name", "kind", "at", "ordinal")
