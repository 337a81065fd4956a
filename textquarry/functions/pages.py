"""Main text of any page, by where its prose is dense.

A page is read once from left to right into blocks, the texts between
block-level tags, each with its element and its linked characters.  From the
root the walk goes down to the container that still holds ``SHARE`` of the
prose (text that is neither linked nor in furniture) as long as there is one;
its blocks are the article.  Where it ends at the body, so that no container
marks the article off, dense blocks do: the article reaches from the first
block of ``DENSE`` words with few links to the last one, with the headings
right above the first.

Every search either moves on or shows that there is no more of what was sought,
so time and memory are linear in the page, whatever its markup.

Defined results: a null, empty or textless page has an empty text; a tag,
comment or script that never ends takes the rest of the page; references are
decoded, by the rule of browsers or, with ``decode_closed``, only those that end
with a semicolon; white space in a block is one space, blocks are joined by line
breaks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the prose that a container has to hold for the walk to enter it; words of a dense block; most linked text of a block.
SHARE, DENSE, LINKED = 0.6, 10, 0.5

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("html body div article main section center table tbody tr td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text, and elements and names that hold no article.
RAW = frozenset("script style noscript template svg iframe textarea".split())
FURNITURE = frozenset("head nav header footer aside form menu button select dialog".split())
NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header banner cookie cookies consent popup modal ad ads advert adverts advertisement sponsored promo share social related comment comments disqus discussion newsletter subscribe pagination widget".split())
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[\"'>]")
_NAMED = re.compile(r"(?i)\b(?:class|id|role)\s{0,9}=\s{0,9}(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_WORD = re.compile(r"[a-z]+")
_CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));")


def decode_closed(text: str) -> str:
    """References that end with a semicolon; ``html.unescape`` also takes old names and numbers without one (``&amp``)."""
    return _CLOSED.sub(lambda m: html5.get(f"{m[1]};", m[0]) if m[1] else html.unescape(m[0]), text)


class _Reader:
    """Where things are in a page; a search that failed is not made again."""

    def __init__(self, page: str):
        self.page, self.absent, self.quotes = page, set(), True

    def find(self, what: str, start: int) -> int:
        k = -1 if what in self.absent else self.page.find(what, start)
        if k < 0:
            self.absent.add(what)
        return k

    def tag_end(self, start: int) -> int:
        """The place of the ``>`` outside quotes, else of the first one; -1 for none."""
        first = self.find(">", start)
        if first < 0 or not self.quotes:
            return first
        mark = ""
        for m in _STOP.finditer(self.page, start):
            c = m[0]
            if c == ">" and not mark:
                return m.start()
            if c != ">":
                mark = c if not mark else "" if c == mark else mark
        self.quotes = False  # a quote stays open to the end: quotes mean nothing from here on
        return first

    def element_end(self, tag: str, start: int) -> int:
        """The place of the end tag, or -1."""
        key = f"</{tag}"
        found = None if key in self.absent else re.compile(rf"</{tag}\b", re.I).search(self.page, start)
        if not found:
            self.absent.add(key)
            return -1
        return found.start()


class Page:
    """Blocks (text, element, linked characters) and elements (parent, tag, furniture)."""

    def __init__(self, page: str, decode: Callable[[str], str] = html.unescape):
        self.decode = decode
        self.blocks: list[tuple[str, int, int]] = []
        self.parent, self.tag, self.furniture = [-1], [""], [False]
        self._read(page)

    def _open(self, tag: str, attributes: str, above: int) -> int:
        names = {w for m in _NAMED.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())} if "=" in attributes else ()
        inside = tag == "header" and self.tag[above] in ("article", "main")
        self.furniture.append(self.furniture[above] or (tag in FURNITURE and not inside) or (tag not in ("html", "body", "article", "main") and not NAMES.isdisjoint(names)))
        self.parent.append(above)
        self.tag.append(tag)
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        reader, n = _Reader(page), len(page)
        stack, open_tags = [0], {"": 1}
        parts: list[str] = []
        at = linked = links = 0

        def close() -> None:
            nonlocal parts, linked
            text = " ".join("".join(parts).split())
            if text:
                self.blocks.append((text, stack[-1], linked))
            parts, linked = [], 0

        def leave(tag: str) -> None:
            nonlocal links
            while True:
                x = self.tag[stack.pop()]
                open_tags[x] -= 1
                links -= x == "a"
                if x == tag:
                    return

        while at < n:
            k = reader.find("<", at)
            k = n if k < 0 else k
            if k > at:
                text = self.decode(page[at:k])
                parts.append(text)
                linked += len(text) if links else 0
            if k == n:
                break
            if page.startswith(("<!", "<?"), k):
                mark = "-->" if page.startswith("<!--", k) else ">"
                end = reader.find(mark, k + 2)
                at = n if end < 0 else end + len(mark)
                continue
            m = _TAG.match(page, k)
            if not m:
                parts.append("<")
                at = k + 1
                continue
            end = reader.tag_end(m.end())
            if end < 0:
                break
            at, tag, closes = end + 1, m[1].lower(), page[k + 1] == "/"
            if tag in BLOCK:
                close()
            elif tag == "br":
                close()
            if closes:
                if open_tags.get(tag):
                    leave(tag)
                continue
            if tag in RAW:
                closing = reader.element_end(tag, at)
                if closing < 0 and tag in ("script", "style"):
                    break
                if closing >= 0:
                    closing = reader.tag_end(closing)
                    at = n if closing < 0 else closing + 1
                    continue
            if tag in VOID or page[end - 1] == "/":
                continue
            if tag in BLOCK and open_tags.get("p"):
                leave("p")  # a block ends an open paragraph
            elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.tag[stack[-1]] == tag:
                leave(tag)
            stack.append(self._open(tag, page[m.end() : end], stack[-1]))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            links += tag == "a"
        close()

    def article(self) -> list[str]:
        blocks = [(t, e, min(n, len(t)) / len(t)) for t, e, n in self.blocks if not self.furniture[e]]
        held = [0] * len(self.tag)
        for text, e, share in blocks:
            held[e] += len(text) if share <= LINKED else 0
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        child = [-1] * len(held)  # the container with most prose in each element
        for e in range(1, len(held)):
            p = self.parent[e]
            if self.tag[e] in CONTAINER and (child[p] < 0 or held[e] > held[child[p]]):
                child[p] = e
        top = 0
        while child[top] >= 0 and held[top] and held[child[top]] >= SHARE * held[top]:
            top = child[top]
        inside = [False] * len(held)
        for e in range(len(held)):
            inside[e] = e == top or (e > top and inside[self.parent[e]])
        kept = [b for b in blocks if inside[b[1]]]
        if self.tag[top] in ("", "html", "body"):
            kept = self._dense(kept)
        return [t for t, _, share in kept if share <= LINKED]

    def _dense(self, blocks: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
        strong = [k for k, (t, _, share) in enumerate(blocks) if share <= LINKED / 2 and t.count(" ") + 1 >= DENSE]
        if not strong:
            return blocks
        first, last = strong[0], strong[-1]
        while first and self.tag[blocks[first - 1][1]] in HEADING:
            first -= 1
        return blocks[first : last + 1]


def page_text(page: str | None, decode: Callable[[str], str] = html.unescape) -> str:
    return "\n".join(Page(page or "", decode).article())


def main_text(page: Column, decode: Callable[[str], str] = html.unescape) -> Column:
    @F.pandas_udf(T.StringType())
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: page_text(p if isinstance(p, str) else None, decode))

    return read(page)
