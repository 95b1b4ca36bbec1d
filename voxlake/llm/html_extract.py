"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with the path of block elements from the root to it. Text length and
punctuation are added up for each path and divided by the number of blocks there; the ratios, laid out in page order,
are smoothed, multiplied, and cut at a threshold that follows their spread. The element that holds the chosen blocks
is the article: its other blocks (headings, short lines) stay too, but for paths of links alone. Tags of menus, headers,
footers, sidebars and forms never count; names that say so take an element away unless it holds most of the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Fixed values of HTML: elements whose content is raw text, elements without content, and inline elements.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A start tag of the first closes an open element of the second, up to the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements that are never part of an article, and words in class, id or role that say the same of an element.
_OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "head", "svg", "object", "audio", "video", "canvas", "menu"}
_OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent",
    "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "toolbar", "complementary", "contentinfo", "skip",
}
#: Words of readers' comments; an element of such a name is never the article, however long.
_COMMENT_WORDS = {"comment", "comments", "reply", "replies", "disqus"}
#: First words of class names that tell of a layout's state, not of what an element is.
_STATES = {"has", "no", "with", "without", "is", "not", "show", "hide"}
#: Share of a path's text outside links below which it is a list of links.
_LINKED = 0.2
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_WORD = re.compile(r"[a-z]+")
_MANY_BLANKS = re.compile(r"\s+")


class _Block:
    __slots__ = ("path", "chain", "named", "text", "link")

    def __init__(self, path: tuple, chain: tuple, named: tuple, text: str, link: int):
        self.path, self.chain, self.named, self.text, self.link = path, chain, named, text, link


#: What markup says of an element: nothing, that its name is one of boilerplate, that it is boilerplate.
PLAIN, NAMED, OUTSIDE = 0, 1, 2


def _names(value: str) -> set[str]:
    """Words of a class, id or role, without those of names that tell of a state (has-sidebar, no-comments)."""
    found = set()
    for name in value.split():
        words = _WORD.findall(name)
        if words and words[0] not in _STATES:
            found.update(words)
    return found


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    if tag in _OUTSIDE or tag == "header" and not in_article:
        return OUTSIDE
    kind = PLAIN
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return OUTSIDE
        if tag not in ("html", "body", "article", "main") and name in ("class", "id", "role"):
            words = _names(value)
            if not _COMMENT_WORDS.isdisjoint(words):
                return OUTSIDE
            if not _OUTSIDE_WORDS.isdisjoint(words):
                kind = NAMED
    return kind


def blocks_of(page: str) -> list[_Block]:
    """Text blocks in page order; white space is folded, references are decoded.

    Elements that are boilerplate by their tag are left out, and those by their name unless they hold most of the text
    that is left and no other element is an article by its tag: a name may lower an element's worth, but never takes the
    page's main part away.
    """
    out: list[_Block] = []
    stack: list[tuple[str, int, int]] = []  # element, its number, what markup says of it
    buf: list[str] = []
    number = outside = link = 0
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = _MANY_BLANKS.sub(" ", html.unescape("".join(buf))).strip()
            buf.clear()
            if text and not outside:
                named = tuple(n for _, n, kind in stack if kind == NAMED)
                out.append(_Block(tuple(t for t, _, _ in stack), tuple(n for _, n, _ in stack), named, text, linked))
        linked = 0

    def close(depth: int) -> None:
        nonlocal outside
        flush()
        while len(stack) > depth:
            outside -= stack.pop()[2] == OUTSIDE

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buf.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in _RAW and not end:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else n
            if tag not in ("script", "style", "template"):
                flush()
            continue
        if tag == "br":
            buf.append(" ")
        elif tag in _INLINE:
            if tag == "a":
                link = 0 if end else 1
        elif end:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                close(depth)
            else:
                flush()
        else:
            flush()
            link = 0
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in _CLOSES:
                ends, bound = _CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in bound:
                        break
                    if stack[k][0] in ends:
                        close(k)
                        break
            if tag not in _VOID and not m[3].endswith("/"):
                number += 1
                kind = _kind(tag, m[3], any(t in ("article", "main") for t, _, _ in stack))
                stack.append((tag, number, kind))
                outside += kind == OUTSIDE
    flush()
    held: dict[int, int] = {}
    for b in out:
        for n in b.named:
            held[n] = held.get(n, 0) + max(0, len(b.text) - b.link)
    most = sum(max(0, len(b.text) - b.link) for b in out) / 2
    if any(not b.named and ("article" in b.path or "main" in b.path) for b in out):
        most = np.inf  # the page says where its article is
    return [b for b in out if all(held[n] > most for n in b.named)]


def _smooth(x: np.ndarray, radius: int = 2) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 1.0) ** 2)
    w = np.convolve(np.ones(len(x)), k, "same") if len(x) >= len(k) else np.ones(len(x))
    return np.convolve(x, k, "same") / w if len(x) >= len(k) else x


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty if the page is null, empty or has no text outside boilerplate."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    size = np.array([max(0, len(b.text) - b.link) for b in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in blocks], float)
    paths = np.unique(["/".join(b.path) for b in blocks], return_inverse=True)[1]
    per = np.bincount(paths)
    ratio = (np.bincount(paths, size) / per)[paths]
    dots = (np.bincount(paths, marks) / per)[paths]
    fused = _smooth(ratio) * (1 + _smooth(dots))
    chosen = fused >= min(fused.std(), fused.max())
    if not chosen.any():
        return ""
    # the deepest element that holds nine tenths of the chosen text
    need, held = 0.9 * size[chosen].sum(), {}
    for b, s, c in zip(blocks, size, chosen, strict=True):
        if c:
            for depth, number in enumerate(b.chain):
                held[number] = (held.get(number, (0, 0))[0] + s, depth)
    fit = [(depth, number) for number, (s, depth) in held.items() if s >= need]
    if not fit:
        return "\n".join(b.text for b, c in zip(blocks, chosen, strict=True) if c)
    root = max(fit)[1]
    path, chain = next((b.path, b.chain) for b in blocks if root in b.chain)
    at = chain.index(root)
    around = [k for k in range(at + 1) if path[k] in ("article", "main")]
    keep = chain[around[-1]] if around else chain[at - 1] if path[at] == "p" and at else root
    # paths inside it that are nearly all links are menus, not text
    whole = np.bincount(paths, [len(b.text) for b in blocks])[paths]
    listed = (np.bincount(paths, size)[paths] < _LINKED * whole) & (per[paths] > 1)
    return "\n".join(b.text for b, menu in zip(blocks, listed, strict=True) if keep in b.chain and not menu)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row; null html counts as empty. Rows are handled one by one,
    so repeated rows, null ids and urls are kept, an empty table gives no row, and other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    some = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(some, run, "page_id long, url string, text string, n_chars long")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
