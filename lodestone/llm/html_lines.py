"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block; tags do no more than end lines and weigh them. The
weight of a line is its length without text of links. What element, role or name call a menu,
header, footer, sidebar, notice, advert, form, script, style or comment section weighs nothing and
becomes one empty line, so that it does not part the text around it. In a page that has ``article`` or
``main`` elements their lines weigh with their links, and lines outside only ``OUTSIDE`` of their
length; ``WINDOW`` empty lines stand at the edges of these elements.

Weights are summed over sliding windows of ``WINDOW`` lines, the line-block distribution. Where sums
rise from nothing a passage begins, and where they fall back to nothing is its dive point. It surges
if some sum reaches ``SURGE`` of the page's highest sum. The text is what stands in passages that surge; passages that
never do are dropped. At both ends of a passage outside articles, lines that are mainly links are cut off.

In an article the names of headings, paragraphs, list items and tables count for nothing (site generators make ids from
the text of headings), and a name of several parts counts by its last one, so that a section on related work or a
commentary stays.

In a page without articles a form, or an element dropped for its class or id, that holds nearly all of the
text wraps the page and is not dropped.

Within a block white space becomes one space and character references are decoded once; blocks, and
the lines that ``br`` makes, are joined by one newline.

Defined cases: null and empty html give an empty text; a tag, comment or reference that the page
breaks off in is dropped; elements that are never closed end with the page, but a paragraph or list
item ends with the next block; passages of equal sums are kept or dropped alike; pages of any length and depth are
read whole, in time that grows with their length; repeated rows get equal results.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A passage counts if its highest sum is this share of the page's highest; text outside articles weighs this share of its length.
SURGE, OUTSIDE = 0.05, 0.02
#: An element that holds this share of a page's text outside links, menus and the like wraps the page.
WRAPPER_SHARE = 0.8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_SELF_CLOSED = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
_DROPPED = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video map datalist".split())
_NOT_TEXT = _DROPPED - {"form"} | {"a"}
_ENDED_BY_BLOCK = frozenset("p li dt dd option td th tr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset("nav navbar menu header masthead topbar footer sidebar side aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup popover modal overlay newsletter subscribe subscription signup login search comment comments commentlist respond disqus replies discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager widget widgets toolbar skip teaser disclaimer paywall cta".split())
#: Words of one part that begin so, and last parts that end so, name such an element too.
_STARTS = ("advert", "adsby", "sidebar", "cookie", "newsletter", "navbar", "breadcrumb", "disqus", "commentlist")
_ENDS = ("nav", "menu", "sidebar", "footer", "comments", "advert", "banner")
#: A first part from ``_NAMES`` or these says what an element is only before a last part that names a mere holder: "share-buttons", not "share-price".
_FIRST = frozenset("footer comment cookie adverts navigation".split())
_HOLDERS = frozenset("list box block container wrapper wrap section area bar link links item items inner row button buttons icon icons post posts articles stories panel unit slot zone thread count form banner title heading message text holder group grid module".split())
#: Elements that are text themselves; in an article their names are those of headings and paragraphs, not of parts of the page.
_TEXT_LEVEL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figure figcaption table tr td th caption tbody thead span".split())
_OF_ARTICLE = frozenset("entry article post story".split())
#: Of several articles those count that are at least this share of the longest.
ARTICLE_SHARE = 0.5
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


def _boilerplate(name: str, attributes: str, in_content: bool, named: bool = True) -> bool:
    if name in _DROPPED or name == "header" and not in_content:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if named and key in ("class", "id"):
            if in_content and name in _TEXT_LEVEL:
                continue
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if not parts:
                    continue
                first, last = parts[0], parts[-1]
                # the last part says what it is: "page-footer" is a footer, "footer-free" is not
                named_so = last in _NAMES or last.endswith(_ENDS) or len(parts) == 1 and last.startswith(_STARTS)
                named_so = named_so or len(parts) > 1 and last in _HOLDERS and (first in _NAMES or first in _FIRST)
                heads_article = last == "header" and (in_content or first in _OF_ARTICLE)
                if named_so and not heads_article and not (last == "discussion" and in_content):
                    return True
    return False


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, within article or main) of each line; dropped parts leave one empty line, edges of articles ``WINDOW``."""
    out: list[tuple[str, int, bool]] = []
    held: list[str] = []
    at = links = content = 0
    in_link = False
    drop, depth = "", 0
    tree = elements(html)
    ends = content_places(tree)
    starts = frozenset(ends)
    wraps: frozenset[int] | None = None
    closes: dict[int, int] = {}

    def end_line(blank: int = 0) -> None:
        nonlocal links
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        if text:
            out.append((text, min(links, len(text)), content > 0))
        if blank > 1 or blank and out and out[-1][0]:
            out.extend([("", 0, content > 0)] * blank)
        held.clear()
        links = 0

    pos, n = 0, len(html)
    while pos < n:
        m = _TAG.search(html, pos)
        text = html[pos : m.start() if m else n]
        if text and not drop:
            if not m and (k := text.rfind("<")) >= 0 and re.match(r"<[A-Za-z/!]", text[k:]) and ">" not in text[k:]:
                text = text[:k]
            held.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        pos = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1))
        if not closing and name in _RAW:
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = close.end() if close else n
            continue
        if drop:
            if name == drop and name not in _SELF_CLOSED:
                depth += -1 if closing else 1
                if depth == 0:
                    drop = ""
            elif drop in _ENDED_BY_BLOCK and not closing and name in _BLOCKS and name != "br":
                drop = ""
            if drop or closing:
                continue
        if name in ("article", "main") and (closing or content or m.start() in starts):
            end_line(WINDOW if not content or closing and content == 1 else 1)
            content = max(0, content - 1) if closing else content + (not _boilerplate(name, m.group(3) or "", True))
            if not closing and _boilerplate(name, m.group(3) or "", True):
                drop, depth = name, 1
            continue
        if name == "a":
            in_link = not closing
        if name not in _BLOCKS and not (m.group(3) or "").strip():
            continue
        if name in _BLOCKS:
            end_line()
        if not closing and name not in _SELF_CLOSED and _boilerplate(name, m.group(3) or "", content > 0) and not m.group(0).endswith("/>"):
            # what holds the article, or nearly all of a page without one, is not dropped for its name
            if not ends and (name == "form" or name not in _DROPPED) and not _boilerplate("div", m.group(3) or "", True, named=False):
                wraps = _wrappers(tree) if wraps is None else wraps
                if pos in wraps:
                    continue
            if not ends or content or name == "article" or name in _DROPPED - {"form"} or not _holds(tree, closes, pos, ends):
                end_line(1)
                drop, depth = name, 1
    end_line()
    return out


class Element(NamedTuple):
    name: str
    attributes: str
    start: int
    begin: int
    end: int
    size: int
    #: Open elements of the same name around it.
    within: int


def elements(html: str) -> list[Element]:
    """The block elements of a page with their places and the length of their text outside links and dropped elements, in one pass."""
    open_: list[tuple[str, str, int, int, int, int]] = []
    count: dict[str, int] = {}
    out: list[Element] = []
    size = pos = aside = 0

    def close(end: int) -> None:
        nonlocal aside
        name, attributes, start, begin, before, within = open_.pop()
        count[name] -= 1
        aside -= name in _NOT_TEXT
        out.append(Element(name, attributes, start, begin, end, size - before, within))

    while pos < len(html):
        m = _TAG.search(html, pos)
        if not aside:
            size += len(_SPACE.sub(" ", html[pos : m.start() if m else len(html)]).strip())
        if not m:
            break
        pos, name = m.end(), (m.group(2) or "").lower()
        if name in _RAW and not m.group(1):
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = end.end() if end else len(html)
        elif m.group(1) and count.get(name):
            while open_[-1][0] != name:
                close(m.start())
            close(m.start())
        elif not m.group(1) and (name in _BLOCKS or name in _NOT_TEXT) and name not in _SELF_CLOSED | _ENDED_BY_BLOCK and not m.group(0).endswith("/>"):
            open_.append((name, m.group(3) or "", m.start(), pos, size, count.get(name, 0)))
            count[name] = count.get(name, 0) + 1
            aside += name in _NOT_TEXT
    while open_:
        close(len(html))
    return out


def content_places(tree: list[Element]) -> list[int]:
    """Where the elements begin that hold the page's text: the longest outermost articles that are not comments or teasers, else ``main``."""
    for wanted in ("article", "main"):
        outer = [(e.end - e.start, e.start) for e in tree if e.name == wanted and not e.within and not _boilerplate(wanted, e.attributes, True)]
        if outer:
            most = max(outer)[0]
            return sorted(start for size, start in outer if size >= ARTICLE_SHARE * most)
    return []


def _holds(tree: list[Element], closes: dict[int, int], begin: int, ends: list[int]) -> bool:
    """Whether the element whose contents begin here holds one of these places. ``closes``: filled with the ends of all elements."""
    if not closes:
        closes.update((e.begin, e.end) for e in tree)
    at = bisect_left(ends, begin)
    return at < len(ends) and ends[at] < closes.get(begin, begin)


def _wrappers(tree: list[Element]) -> frozenset[int]:
    """Where the contents begin of the block elements that hold ``WRAPPER_SHARE`` of the text outside links and dropped elements."""
    whole = max((e.size for e in tree), default=0)
    return frozenset(e.begin for e in tree if whole and e.size >= WRAPPER_SHARE * whole)


def weights(lines: list[tuple[str, int, bool]]) -> list[float]:
    """What each line adds to the sums of its windows."""
    articles = any(inside for text, _, inside in lines if text)
    return [len(text) if inside else (len(text) - links) * (OUTSIDE if articles else 1.0) for text, links, inside in lines]


def passages(weight: list[float]) -> list[tuple[int, int]]:
    """(begin, dive) of the passages that surge, by the sums of ``weight`` over windows of lines."""
    found, highest, top = [], 0.0, 0.0
    begin = last = None
    for i, w in enumerate(weight):
        if w > 0:
            if begin is None:
                begin, top = i, 0.0
            last = i
        elif begin is not None and i - last >= WINDOW:  # a window without weight
            found.append((begin, last + 1, top))
            begin = None
        if begin is not None:
            top = max(top, sum(weight[max(0, i - WINDOW + 1) : i + 1]))
            highest = max(highest, top)
    if begin is not None:
        found.append((begin, last + 1, top))
    return [(a, b) for a, b, t in found if t >= SURGE * highest]


def main_text(html: str | None) -> str:
    lines = lines_of(html or "")
    kept = []
    for a, b in passages(weights(lines)):
        # links beside a passage belong to it in an article only
        while a and lines[a - 1][0] and lines[a - 1][2]:
            a -= 1
        while b < len(lines) and lines[b][0] and lines[b][2]:
            b += 1
        while a < b and not lines[a][2] and 2 * lines[a][1] > len(lines[a][0]):
            a += 1
        while b > a and not lines[b - 1][2] and 2 * lines[b - 1][1] > len(lines[b - 1][0]):
            b -= 1
        size, linked = sum(len(t) for t, _, inside in lines[a:b] if not inside), sum(k for _, k, inside in lines[a:b] if not inside)
        if any(inside for _, _, inside in lines[a:b]) or 2 * linked < size:
            kept += [t for t, _, _ in lines[a:b] if t]
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long")


def op4(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
