"""Terms of a text for work in Arrow batches, from its bytes: those of ``text.counted_terms``, in a small part of the time."""

from __future__ import annotations

import re
from functools import lru_cache

from lodestone.config import MAX_PARTS, MAX_TERM_BYTES
from lodestone.functions.text import BOUNDARY

#: ASCII letters in lower case, a space for every byte that no term holds.
FOLDED = bytes(ord(chr(b).lower()) if chr(b).isalnum() or chr(b) == "_" else 32 for b in range(128)) + bytes(range(128, 256))
#: ``text.COMPOUND`` where a term begins: inside one it cannot begin to match.
COMPOUND = re.compile(rb"(?<![A-Za-z0-9_\x80-\xff])(?:[A-Za-z\x80-\xff][a-z\x80-\xff]*+[A-Z0-9_]|[0-9_])[A-Za-z0-9_\x80-\xff]*+")
_BOUNDARY = re.compile(BOUNDARY)
#: So many compound terms are remembered, none of which is long.
REMEMBERED = 100_000


def clipped(term: bytes) -> bytes:
    """``text.clip_term``."""
    if len(term) <= MAX_TERM_BYTES:
        return term
    out, size = [], 0
    for x in term.decode(errors="replace"):
        n = len(raw := x.encode())
        if size + n <= MAX_TERM_BYTES:
            out.append(raw)
            size += n
        if size == MAX_TERM_BYTES:
            break
    return b"".join(out)


@lru_cache(REMEMBERED)
def _parts(term: bytes) -> tuple[bytes, ...]:
    whole = clipped(term.lower())
    parts = (clipped(p.encode().lower()) for p in _BOUNDARY.split(term.decode(errors="replace")))
    return tuple(dict.fromkeys(p for p in parts if len(p) >= 2 and p != whole))[:MAX_PARTS]


def terms(raw: bytes) -> list[bytes]:
    """Every term and its parts, folded, with repeats, in any order."""
    found = raw.translate(FOLDED).split()
    if max(map(len, found), default=0) > MAX_TERM_BYTES:
        found = [clipped(t) for t in found]
    for c in COMPOUND.findall(raw):
        found += _parts(c) if len(c) <= MAX_TERM_BYTES else _parts.__wrapped__(c)
    return found
