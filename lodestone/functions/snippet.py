"""Snippets: the window with most distinct query terms, one line, ellipses where cut."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import SNIPPET_BYTES

_TERM = re.compile(rb"[A-Za-z0-9_\x80-\xff]+")
RUN_UP, NEAR_TOP = 48, 64


def snippet_of(text: str, terms: list[str], size: int = SNIPPET_BYTES) -> str:
    raw = text.encode()
    wanted = {t.encode() for t in terms}
    hits = [(m.start(), m[0].lower()) for m in _TERM.finditer(raw) if m[0].lower() in wanted]
    begin = 0
    if hits:
        # of windows with equally many distinct terms the earliest
        begin = max(hits, key=lambda h: (len({t for p, t in hits if h[0] <= p < h[0] + size}), -h[0]))[0]
        if begin < NEAR_TOP:
            begin = 0
        else:
            word = re.compile(rb"[ \n]").search(raw, begin - RUN_UP, begin)
            begin = word.end() if word else begin
    while begin < len(raw) and 0x80 <= raw[begin] < 0xC0:
        begin += 1
    body = raw[begin : begin + size].decode("utf-8", "ignore")
    line = re.sub("[\x00-\x20]+", " ", body).strip(" ")
    return ("…" if begin else "") + line + ("…" if begin + len(body.encode()) < len(raw) else "")


def _snippets(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([snippet_of(t or "", list(q) if q is not None else []) for t, q in zip(text, terms)])


def snippets(text: Column | str, terms: Column | str) -> Column:
    """The snippet of each text for its array of folded terms."""
    return F.pandas_udf(_snippets, "string")(text, terms)
