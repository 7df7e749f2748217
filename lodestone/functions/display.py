"""HTML for display: allowed elements and link targets only."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: elements that are shown, those that are dropped with their content, and the schemes a link may have
BLOCK = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "th", "td", "caption")
INLINE = ("a", "code", "em", "strong", "b", "i", "u", "s", "sup", "sub", "kbd", "abbr", "small")
EMPTY = ("br", "hr")
DROPPED = ("script", "style", "template", "noscript", "iframe", "object", "svg", "math", "head", "title")
SCHEMES = "(?i)^(https?|mailto):"
MOST_DEEP = 64


def safe_href(raw: Column) -> Column:
    """A relative target or one of an allowed scheme, without leading control characters; null for anything else."""
    href = F.trim(F.regexp_replace(raw, r"^[\x00-\x20]+", ""))
    return F.when((href != "") & (~href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | href.rlike(SCHEMES)), href)


class _Shown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []
        self.hidden = ""

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in DROPPED:
            self.hidden = tag
        elif tag in EMPTY:
            self.out.append(f"<{tag}>")
        elif tag in BLOCK or tag in INLINE:
            href = _href(dict(attrs).get("href")) if tag == "a" else None
            kept = sum(k for _, k in self.open) < MOST_DEEP and (tag != "a" or href is not None)
            self.open.append((tag, kept))
            if kept:
                self.out.append(f"<{tag}>" if href is None else f'<a href="{escape(href)}">')

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = "" if tag == self.hidden else self.hidden
        elif any(t == tag for t, _ in self.open):
            last = ""
            while last != tag:
                last, kept = self.open.pop()
                if kept:
                    self.out.append(f"</{last}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(escape(data, quote=False))

    def text(self, html: str) -> str:
        self.feed(html)
        self.close()
        self.hidden = ""
        while self.open:
            self.handle_endtag(self.open[-1][0])
        return "".join(self.out)


def _href(raw: str | None) -> str | None:
    href = (raw or "").lstrip("".join(map(chr, range(33)))).strip()
    scheme = href.partition(":")[0] if ":" in href.split("/")[0] else ""
    allowed = not (scheme[:1].isalpha() and scheme.isascii() and all(c.isalnum() or c in "+.-" for c in scheme)) or scheme.lower() in ("http", "https", "mailto")
    return href if href and allowed else None


def display_html(html: Column | str) -> Column:
    """Allowed elements, their text and safe link targets; attributes, scripts, comments and unknown wrappers go."""
    return F.pandas_udf(lambda s: pd.Series([None if v is None else _Shown().text(v) for v in s]), "string")(html)
