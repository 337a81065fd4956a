"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks, the texts between block-level tags.  Each
block has a vector: hashed names of its tag path (tags, classes, ids, roles),
hashed words, and a few numbers, among them whether the
block stands in the container that holds most of the page's prose.  A bidirectional LSTM in numpy reads the
whole sequence and labels every block as article or not, so a block is judged
with the whole page in view.  Scripts, styles, comments in the markup and the
head are no blocks.

The labeller is trained where it is used, with a fixed seed, on ``TRAIN``
pages that ``sample_page`` composes: articles in named and unnamed containers,
or in none, among menus, headers, footers, sidebars, notices, adverts, forms and
reader comments that are named, unnamed or bare lines, some in words that no
furniture has, with headings, captions, lists and tables, and with end tags
left out.  Where names and words say nothing, place, links and the share of
the page's text in the same elements have to.

The page is read once from left to right: every search either moves on or
shows that there is no more of what was sought, so time and memory are linear
in the page, whatever its markup.

Defined results: a null or empty page has no text; broken markup is read as
far as it goes (a tag that never ends is dropped, a script that never ends
takes the rest of the page, a quote that never ends is part of its value);
pages of any length are read whole; equal rows are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, tidy

TRAIN, EPOCHS, HIDDEN, PROJECT = 1200, 6, 32, 32
#: Pages that are worked on at a time.
ROWS = 250
PATH_DIM, WORD_DIM, NUMBERS = 4096, 2048, 14
DIM = PATH_DIM + WORD_DIM + NUMBERS
#: Innermost tags of a path that are read, and numbers gathered at a time.
DEPTH, GATHER = 64, 200_000

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe".split())
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]?+[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_NAMED = frozenset("class id role itemprop aria-label".split())
_NAME = re.compile(r"[a-z]+")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul label".split()
)
#: Elements that can hold an article, and the share of a container's prose that one has to hold to be the narrower place.
HOLDERS, SHARE = frozenset("html body div article main section center table tbody tr td".split()), 0.6
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these closes an open one of the same list.
ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: A block-level tag ends an open paragraph.
_CLOSES_P = BLOCKS - {"button", "option", "select", "label", "body", "html"}


class Block:
    """A text, the names on its tag path, its linked characters, the numbers of the elements around its own, and its element.

    ``dense`` says whether it stands in the narrowest container with most of
    the page's prose, ``marked`` whether there is such a container in the body.
    """

    __slots__ = ("around", "dense", "element", "linked", "marked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int, around: tuple[int, int], element: int):
        self.text, self.path, self.linked, self.around, self.element = text, path, linked, around, element
        self.dense = self.marked = False


def find_dense(page: list[Block], parent: list[int], tag: list[str]) -> None:
    """Walk from the root to the container that holds ``SHARE`` of the prose around it, as long as there is one."""
    held = [0] * len(parent)
    for b in page:
        held[b.element] += max(0, len(b.text) - b.linked)
    for e in range(len(held) - 1, 0, -1):
        held[parent[e]] += held[e]
    widest = [0] * len(held)
    for e in range(1, len(held)):
        if tag[e] in HOLDERS and (not widest[parent[e]] or held[e] > held[widest[parent[e]]]):
            widest[parent[e]] = e
    top = 0
    while widest[top] and held[top] and held[widest[top]] >= SHARE * held[top]:
        top = widest[top]
    inside = [False] * len(held)
    for e in range(len(held)):
        inside[e] = e == top or (e > top and inside[parent[e]])
    for b in page:
        b.dense, b.marked = inside[b.element], tag[top] not in ("", "html", "body")


def tags(page: str) -> Iterator[tuple[int, int, str, bool, list[tuple[str, str]], bool]]:
    """What is no text: (begin, end, tag, whether it closes, attributes, whether it ends with a slash).

    Comments, declarations and raw elements have no tag name.
    """
    at, n, missing = 0, len(page), set()

    def find(what: str, start: int) -> int:
        k = -1 if what in missing else page.find(what, start)
        if k < 0:
            missing.add(what)
        return k

    while (at := find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            k = find(mark, at + 2)
            end = n if k < 0 else k + len(mark)
            yield at, end, "", False, [], False
            at = end
            continue
        m = _TAG.match(page, at)
        if not m:
            at += 1
            continue
        begin, tag, closes, attributes, k = at, m[1].lower(), page[at + 1] == "/", [], m.end()
        while k < n and page[k] != ">":
            x = _ATTRIBUTE.match(page, k)
            if x.end() == k:
                k += 1
                continue
            if x[1].lower() in _NAMED:
                attributes.append((x[1].lower(), x[2] or x[3] or x[4] or ""))
            k = x.end()
        if k >= n:  # the tag never ends
            yield begin, n, "", False, [], False
            return
        at = k + 1
        if not closes and (tag in RAW or tag == "head") and tag not in missing:
            found = re.compile(rf"</{tag}[\s/>]|<body[\s/>]" if tag == "head" else rf"</{tag}[\s/>]", re.I).search(page, at)
            if found or tag in ("script", "style"):
                end = n if not found else found.start() if found[0][1] != "/" else find(">", found.start()) + 1 or n
                yield begin, end, "", False, [], False
                at = end
                continue
            missing.add(tag)
        yield begin, at, tag, closes, attributes, page[k - 1] == "/"


def _names(tag: str, attributes: list[tuple[str, str]]) -> tuple[str, ...]:
    out = [tag]
    for name, value in attributes:
        found = _NAME.findall(value.lower())
        out += [f"{name[0]}.{x}" for x in found]
        out += [f".{x}" for x in found]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; text decoded, white space made single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    opened, parent, tag_of = 0, [0], [""]
    parts: list[str] = []
    open_tags: dict[str, int] = {}
    linked = 0
    in_link = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                near = stack[-DEPTH:]
                chain = [0, 0, *(k for x, _, k in near if x in BLOCKS)]
                own = next((x for x, _, _ in reversed(near) if x in BLOCKS), "")
                out.append(Block(text, tuple({f"^{own}": 0} | {n: 0 for _, ns, _ in near for n in ns}), linked, (chain[-2], chain[-3] if len(chain) > 2 else 0), stack[-1][2] if stack else 0))
        parts, linked = [], 0

    at = 0

    def say(t: str) -> None:
        nonlocal linked
        t = html.unescape(t) if "&" in t else t
        parts.append(t)
        if in_link:
            linked += len(t)

    for begin, end, tag, closes, attributes, empty in tags(page):
        if begin > at:
            say(page[at:begin])
        at = end
        if not tag:
            continue
        block = tag in BLOCKS
        if block:
            close()
        elif tag == "br":
            parts.append(" ")
        if closes:
            if open_tags.get(tag):
                while stack:
                    x, _, _ = stack.pop()
                    open_tags[x] -= 1
                    in_link -= x == "a"
                    if x == tag:
                        break
        elif tag not in VOID and not empty:
            ends = ENDS.get(tag, ())
            if tag in _CLOSES_P:
                ends = {*ends, "p"}
            if block and ends:
                for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                    x = stack[k][0]
                    if x in ends:
                        for y, _, _ in stack[k:]:
                            open_tags[y] -= 1
                            in_link -= y == "a"
                        del stack[k:]
                        break
                    if x in BLOCKS:
                        break
            opened += 1
            parent.append(stack[-1][2] if stack else 0)
            tag_of.append(tag)
            stack.append((tag, _names(tag, attributes), opened))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            in_link += tag == "a"
    if at < len(page):
        say(page[at:])
    close()
    find_dense(out, parent, tag_of)
    return out


class Slots(dict):
    """Hashed columns of names and words; holds a bounded number of them."""

    def __init__(self, size: int, offset: int):
        super().__init__()
        self.size, self.offset = size, offset

    def __missing__(self, name: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        self[name] = k = self.offset + zlib.crc32(f"{self.offset}{name}".encode()) % self.size
        return k


def slots() -> tuple[Slots, Slots]:
    return Slots(PATH_DIM, 0), Slots(WORD_DIM, PATH_DIM)


def numbers(page: list[Block]) -> np.ndarray:
    """Lengths, links, place, and the share of the page's text that stands in the same elements."""
    total, inside = 1, {}
    for b in page:
        n = len(b.text) - min(b.linked, len(b.text))
        total += n
        for k in {*b.around}:
            inside[k] = inside.get(k, 0) + n
    rows = []
    for i, b in enumerate(page):
        n = len(b.text)
        before, after = (page[k].around[0] == b.around[0] if 0 <= k < len(page) else False for k in (i - 1, i + 1))
        rows.append((min(n, 600) / 300, np.log1p(n) / 5, min(1.0, b.linked / n), i / len(page), n / total, b.text[-1] in ".!?", min(len(b.path), 40) / 10, b.text[0].isupper(), inside[b.around[0]] / total, inside[b.around[1]] / total, before, after, b.dense, b.marked))
    return np.array(rows, np.float32).reshape(len(page), NUMBERS)


class Gathered:
    """Blocks as rows of the dense layer's matrix: which rows, how much of each, and where a block starts."""

    def __init__(self, page: list[Block], hashed: tuple[Slots, Slots]):
        names, words = hashed
        which: list[int] = []
        scale: list[float] = []
        self.first: list[int] = []
        for b in page:
            own = b.text.lower().split(" ")
            path = {names[x] for x in b.path}
            self.first.append(len(which))
            which += path
            scale += [1.0] * len(path)
            which += [words[w] for w in own]
            scale += [1 / len(own)] * len(own)
        self.which, self.scale = np.array(which, np.int64), np.array(scale, np.float32)[:, None]

    def project(self, weight: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weight[self.which] * self.scale, self.first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Dense layer, LSTM in both directions, one output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, p = HIDDEN, PROJECT
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": scale(DIM, p), "b": rng.uniform(0, 1, p).astype(np.float32), "O": scale(2 * h, 1), "o": np.zeros(1, np.float32)}
        self.p["W"][: PATH_DIM + WORD_DIM] = 0  # names and words that training never met say nothing
        for d in "fb":
            self.p |= {f"X{d}": scale(p, 4 * h), f"H{d}": scale(h, 4 * h), f"c{d}": np.zeros(4 * h, np.float32)}
            self.p[f"c{d}"][h : 2 * h] = 1

    def _states(self, e: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list[tuple]]:
        """States (T, 2, N, h) over time-major inputs (T, N, p), the second direction in its own order of time.

        Both directions take a step together, and one hyperbolic tangent gives
        all gates; padding leaves the state as it is.
        """
        t_max, n, _ = e.shape
        h = HIDDEN
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        pre = np.stack([e @ (self.p["Xf"] * half) + self.p["cf"] * half, (e @ (self.p["Xb"] * half) + self.p["cb"] * half)[::-1]], 1)
        weight = np.stack([self.p["Hf"] * half, self.p["Hb"] * half])
        masks, full = np.stack([mask, mask[::-1]], 1)[..., None], (mask & mask[::-1]).all(1)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((t_max, 2, n, h), np.float32)
        tape = []
        for t in range(t_max):
            z = np.matmul(state, weight)
            z += pre[t]
            np.tanh(z, z)
            g = z[..., 3 * h :]
            gates = z[..., : 3 * h] * np.float32(0.5)
            gates += np.float32(0.5)
            c = gates[..., h : 2 * h] * cell
            c += gates[..., :h] * g
            th = np.tanh(c)
            s = gates[..., 2 * h :] * th
            if not full[t]:
                c, s = np.where(masks[t], c, cell), np.where(masks[t], s, state)
            if keep:
                tape.append((gates, g, cell, state, th))
            state, cell = s, c
            out[t] = s
        return out, tape

    def project(self, pages: list[list[Block]], hashed: tuple[Slots, Slots]) -> list[np.ndarray]:
        """The dense layer over the blocks of pages, some blocks at a time."""
        weight, all_ = self.p["W"], [b for page in pages for b in page]
        e, done, size = np.empty((len(all_), PROJECT), np.float32), 0, 0
        for i, b in enumerate(all_):
            size += len(b.path) + len(b.text) // 4
            if size >= GATHER or i == len(all_) - 1:
                e[done : i + 1] = Gathered(all_[done : i + 1], hashed).project(weight)
                done, size = i + 1, 0
        e += np.concatenate([numbers(page) for page in pages]) @ weight[PATH_DIM + WORD_DIM :] + self.p["b"]
        return np.split(np.maximum(e, 0), np.cumsum([len(page) for page in pages])[:-1])

    def read(self, e: np.ndarray, mask: np.ndarray, keep: bool = False):
        states, tape = self._states(e, mask, keep)
        s = np.concatenate([states[:, 0], states[::-1, 1]], 2)
        return (s @ self.p["O"] + self.p["o"])[..., 0], (e, s, tape)

    def gradients(self, pages: list[tuple[Gathered, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        """``pages`` has gathered rows, numbers and labels."""
        weight, fixed = self.p["W"], PATH_DIM + WORD_DIM
        rows = [np.maximum(got.project(weight) + x @ weight[fixed:] + self.p["b"], 0) for got, x, _ in pages]
        (inputs, mask), y = pad(rows), pad([y[:, None] for _, _, y in pages])[0][..., 0]
        out, (e, s, tape) = self.read(inputs, mask, True)
        h = HIDDEN
        d_out = ((_sigmoid(out) - y) * mask / mask.sum())[..., None].astype(np.float32)
        g = {"O": np.einsum("tnk,tno->ko", s, d_out), "o": d_out.sum((0, 1))}
        ds = d_out @ self.p["O"].T
        ds = np.stack([ds[..., :h], ds[::-1, :, h:]], 1)
        masks, back = np.stack([mask, mask[::-1]], 1)[..., None], np.stack([self.p["Hf"].T, self.p["Hb"].T])
        d_state, d_cell = np.zeros_like(ds[0]), np.zeros_like(ds[0])
        dzs = np.empty((*ds.shape[:3], 4 * h), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            gates, new, cell, _, th = tape[t]
            i, f, o, m = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :], masks[t]
            d_s = d_state + ds[t]
            d_c = d_cell + np.where(m, d_s * o * (1 - th * th), 0)
            dz = np.concatenate([d_c * new * i * (1 - i), d_c * cell * f * (1 - f), d_s * th * o * (1 - o), d_c * i * (1 - new * new)], -1)
            dzs[t] = np.where(m, dz, 0)
            d_state = np.where(m, np.matmul(dzs[t], back), d_s)
            d_cell = np.where(m, d_c * f, d_c)
        states = np.stack([x[3] for x in tape])
        de = np.zeros_like(e)
        for k, d in enumerate("fb"):
            own, input_ = dzs[:, k], e if d == "f" else e[::-1]
            g |= {f"X{d}": np.einsum("tnp,tnz->pz", input_, own, optimize=True), f"H{d}": np.einsum("tnh,tnz->hz", states[:, k], own, optimize=True), f"c{d}": own.sum((0, 1))}
            step = own @ self.p[f"X{d}"].T
            de += step if d == "f" else step[::-1]
        de *= e > 0
        own, which, parts = np.zeros_like(weight), np.concatenate([got.which for got, _, _ in pages]), []
        for k, (got, x, _) in enumerate(pages):
            d = de[: len(x), k]
            parts.append(np.repeat(d, np.diff([*got.first, len(got.which)]), 0) * got.scale)
            own[fixed:] += x.T @ d
        order = np.argsort(which, kind="stable")
        which = which[order]
        heads = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        own[which[heads]] += np.add.reduceat(np.concatenate(parts)[order], heads, axis=0)
        return g | {"W": own, "b": de.sum((0, 1))}

    @staticmethod
    def _batches(order: np.ndarray, sizes: list[int], batch: int) -> Iterator[np.ndarray]:
        """Batches of pages of like length, from eight batches at a time of a random order."""
        for some in np.array_split(order, max(1, len(order) // (8 * batch))):
            near = some[np.argsort([sizes[k] for k in some], kind="stable")]
            parts = np.array_split(near, max(1, len(near) // batch))
            yield from (parts[k] for k in np.random.default_rng(len(parts) + int(some[0])).permutation(len(parts)))

    def train(self, pages: list[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS, batch: int = 12, rate: float = 0.006, decay: float = 0.003) -> Labeller:
        """Adam with a falling rate; ``decay`` keeps names and words that few pages have from being learned by heart."""
        rng, hashed = np.random.default_rng(11), slots()
        ready = [(Gathered(page, hashed), numbers(page), y) for page, y in pages]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for part in self._batches(rng.permutation(len(ready)), [len(y) for _, _, y in ready], batch):
                step += 1
                for k, g in self.gradients([ready[i] for i in part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (rate * (0.5 ** (epoch / 4)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                self.p["W"][: PATH_DIM + WORD_DIM] *= 1 - decay
        return self

    def label(self, pages: list[list[Block]], hashed: tuple[Slots, Slots] | None = None) -> list[np.ndarray]:
        """For each page which blocks are article text; pages of like length go together."""
        hashed = hashed or slots()
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 256 and (n + 1) * len(pages[order[at + n]]) <= 12_000:
                n += 1
            part = order[at : at + n]
            at += n
            score = self.read(*pad(self.project([pages[k] for k in part], hashed)))[0]
            for j, k in enumerate(part):
                out[k] = score[: len(pages[k]), j] > 0
        return out


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Time-major array of sequences, and where they have values."""
    t = max(len(r) for r in rows)
    x = np.zeros((t, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((t, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


#: Words of the sample's furniture, and the names its layouts use.
_FURNITURE = {
    "nav": "home about contact news sport shop login search menu archive blog products services help next previous".split(),
    "note": "we use cookies to improve your experience accept all settings privacy policy subscribe newsletter sign up now offer free trial".split(),
    "foot": "copyright all rights reserved terms of use imprint privacy sitemap follow us contact".split(),
    "comment": "great post thanks i disagree with this reply report says wrote anonymous ago likes you my agree lol share".split(),
    "ad": "advertisement sponsored buy now best deal discount order today click here".split(),
    "side": "related popular most read more stories trending latest tags recommended also".split(),
}
#: Kind of furniture: elements, and names of classes or ids.
_CONTAINERS = {
    "nav": ("nav div ul menu", "menu nav navbar navigation topnav breadcrumbs main-nav links"),
    "head": ("header div", "header site-header masthead top-bar banner branding"),
    "foot": ("footer div", "footer site-footer copyright colophon bottom"),
    "side": ("aside div section", "sidebar related widget related-posts more-stories rail"),
    "note": ("div section p", "cookie-notice cookie-banner notice banner popup consent newsletter alert"),
    "ad": ("div section p aside", "ad ads advert advertisement sponsored promo ad-slot adbox"),
    "form": ("form", "search-form subscribe login contact-form"),
    "comment": ("section div ol ul", "comments comment-list comment-section reader-comments discussion replies responses"),
    "main": ("article main div section", "content post post-content article-body entry-content story text main body-text"),
}
_ROLES = {"nav": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "note": "dialog", "main": "main"}


def sample_page(seed: int) -> str:
    """A composed page; furniture blocks start with ``\\x01``, article blocks with ``\\x02``."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    draw, some_letters = rng.random, letters[: 12 + seed % 14]
    own = ["".join(rng.choices(some_letters, k=rng.randrange(2, 9))) for _ in range(120)]
    everyday = [w for ws in _FURNITURE.values() for w in ws]
    sloppy, foreign, bare = draw() < 0.3, draw() < 0.25, draw() < 0.12

    def one(options):
        return options[int(draw() * len(options))]

    def words(n: int, more: list[str] | None = None) -> str:
        out = [one(more) if more and draw() < 0.5 else one(own) for _ in range(n)]
        out = [w + ("," if draw() < 0.06 else "") for w in out]
        return " ".join(out).capitalize() + one([".", ".", ".", "", "?"])

    def tag(name: str, inner: str, attributes: str = "") -> str:
        loose = sloppy and name in ("p", "li", "td", "b", "em", "dd", "dt") and draw() < 0.5
        return f"<{name}{attributes}>{inner}" + ("" if loose else f"</{name}>")

    def made_up() -> str:
        return "".join(rng.choices(letters, k=5)) + one(["", str(rng.randrange(100))])

    def container(kind: str, unnamed: float) -> tuple[str, str]:
        elements, names = _CONTAINERS[kind]
        element, r = one(elements.split()), draw()
        if element in ("nav", "header", "footer", "aside", "form", "article", "main", "menu") and r < 0.4:
            return element, ""
        if draw() < unnamed:
            return element if kind == "comment" else one(["div", "section"]), one(["", f' class="{made_up()}"', f" id='{made_up()}'"])
        if kind in _ROLES and r > 0.92:
            return element, f' role="{_ROLES[kind]}"'
        name = one(names.split())
        return element, one([f' class="{name}"', f" class={name}", f' id="{name}"', f' class="{made_up()} {name}"'])

    def line(kind: str) -> str:
        """A line of furniture that no container marks."""
        more = own if foreign else _FURNITURE.get(kind)
        name = lambda: words(rng.randrange(1, 4), more).rstrip(".?,")
        links = [f"<a href='/{k}'>{name()}</a>" for k in range(rng.randrange(1, 5))]
        text = {"nav": one([" | ", " · ", " "]).join(one([links, [name(), name()]])), "foot": one(["&copy; ", "(c) ", "Copyright "]) + f"{rng.randrange(1999, 2030)} {name()}", "comment": one([name(), f"{name()}: {rng.randrange(90)}", links[0]])}
        return tag(one(["p", "p", "div", "center", "h4", "small", "b"]), "\x01" + text.get(kind, one([name(), links[0], " ".join(links)])))

    def furniture(kind: str, inside: bool = False) -> str:
        """Inside an article its names tell it apart, outside its place does too."""
        if not inside and draw() < (0.6 if bare else 0.08):
            return line(kind)
        element, attributes = container(kind, (0.25 if kind == "comment" else 0.0) if inside else 0.6 if foreign else 0.25)
        as_table = draw() < 0.25
        more, n = own if foreign else _FURNITURE.get(kind), int(rng.randrange(1, 7))
        if kind == "form":
            inner = tag("label", "\x01" + words(2, _FURNITURE["note"])) + "<input name=q>" + tag("p", "\x01" + words(int(rng.randrange(2, 14)))) + f"<select><option>\x01{words(1)}<option>\x01{words(1)}</select><button>\x01{words(1)}</button>"
        elif kind == "comment":
            def remark() -> str:
                name = one([tag("b", "\x01" + words(2)), tag("div", "\x01" + words(1) + f" {rng.randrange(2, 30)} days ago"), tag("cite", "\x01" + words(2)), ""])
                end = one(["", "", tag("div", "<a href='#'>\x01reply</a> <a href='#'>report</a>")])
                return name + tag("p", "\x01" + words(int(rng.randrange(3, 40)), more)) + end
            head = tag(one(["h2", "h3", "h4"]), "\x01" + one([f"{rng.randrange(2, 90)} comments", "Comments", words(2, more)])) if draw() < 0.7 else ""
            item = "li" if element in ("ol", "ul") else one(["div", "div", "article"])
            if as_table:
                return f"<table{attributes}>{head}" + "".join(f"<tr><td>\x01{words(2)}</td><td>{one(['', '<p>'])}\x01{words(rng.randrange(3, 40), more)}</td></tr>" for _ in range(n)) + "</table>"
            inner = head + "".join(tag(item, remark(), one(["", ' class="comment"', f' class="{made_up()}"'])) for _ in range(n))
        elif element == "p" or (kind in ("foot", "ad", "note", "side") and draw() < 0.35):
            sign = one(["", "&copy; ", f"&copy; {made_up()}.com ", "&#169; 2020 "]) if kind == "foot" else ""
            inner = "\x01" + sign + words(int(rng.randrange(3, 25)), one([more, own]))
        elif kind in ("nav", "head") or draw() < 0.3:
            cells = "".join(tag("li", f"<a href='/{k}'>\x01{words(int(rng.randrange(1, 4)), more)}</a>") for k in range(n + 1))
            inner = cells if element in ("ul", "menu") else tag("ul", cells) if draw() < 0.7 else "".join(f"<a href='/{k}'>\x01{words(2, more)}</a> " for k in range(n))
            if kind == "head" and draw() < 0.6:
                inner = tag(one(["h1", "div", "p"]), "\x01" + words(3)) + inner
        else:
            inner = (tag("h3", "\x01" + words(2, more)) if draw() < 0.4 else "") + "".join(tag("p", "\x01" + words(int(rng.randrange(2, 35)), more)) for _ in range(n))
        return f"<{element}{attributes}>{inner}</{element}>"

    def paragraph() -> str:
        t = "\x02" + words(one([1, 3, 8, 20, 50, 90]), everyday if draw() < 0.3 else None)
        kind = one(["p"] * 8 + ["h2", "h3", "b", "ul", "ol", "quote", "link", "table", "div", "pre", "figure", "dl", "em"])
        if kind in ("h2", "h3", "p", "div", "pre"):
            return tag(kind, t)
        if kind in ("b", "em"):
            return tag("p", tag(kind, t) + one(["", "<br>", "<br/>" + words(8)]))
        if kind in ("ul", "ol"):
            return tag(kind, tag("li", t) + tag("li", "\x02" + words(6)))
        if kind == "quote":
            return tag("blockquote", one([t, tag("p", t)]))
        if kind == "link":
            return tag("p", f"{t} <a href='/x'>{words(2)}</a> {words(4)}")
        if kind == "figure":
            return tag("figure", "<img src=a.png>" + tag("figcaption", t))
        if kind == "dl":
            return tag("dl", tag("dt", "\x02" + words(2)) + tag("dd", t))
        return f"<table><tr><td>{t}</td><td>\x02{words(3)}</td></tr></table>"

    def some(kinds: list[str], most: int) -> str:
        return "".join(furniture(one(kinds)) for _ in range(int(rng.randrange(0, most + 1))))

    element, attributes = container("main", 0.6 if foreign else 0.35)
    title = tag("h1", "\x02" + words(5))
    title = one([title, title, title, tag("header", title), tag("div", title), title + tag("p", "\x02" + words(3), ' class="byline"'), ""])
    before = not bare and draw() < 0.12
    body = "" if before else title
    for _ in range(int(rng.randrange(1, 14))):
        body += paragraph()
        if draw() < 0.08 and not bare:
            body += furniture(one(["ad", "note", "form", "side"]), True)
    if bare:  # nothing but the text itself says where it ends
        body += tag("p", "\x02" + words(rng.randrange(12, 60)).rstrip("?.") + ".")
    elif draw() < 0.25:
        body += furniture("comment", True)
    inner = body if bare else f"<{element}{attributes}>{body}</{element}>"
    if not bare and draw() < 0.2:
        inner = tag(one(["main", "div", "div", "section"]), inner, one(["", f' class="{made_up()}"', ' class="wrap"']))
    page = some(["head", "nav", "ad", "note"], 4) + some(["side", "ad", "nav", "form"], 2) + (title if before else "")
    tail = some(["comment", "side", "ad", "form", "note"], 3) + some(["foot", "nav"], 2)
    return f"<html><head><title>{words(4)}</title></head><body>{page}{inner}{tail}</body></html>"


def labelled_pages(n: int, start: int = 0) -> list[tuple[list[Block], np.ndarray]]:
    out = []
    for seed in range(start, start + n):
        page = blocks(sample_page(seed))
        y = np.array(["\x02" in b.text for b in page], np.float32)
        for b in page:
            b.text = b.text.replace("\x01", "").replace("\x02", "") or "-"
        out.append((page, y))
    return out


@lru_cache(maxsize=1)
def default_labeller() -> Labeller:
    return Labeller().train(labelled_pages(TRAIN))


def extract(pages: list[str | None], labeller: Labeller, hashed: tuple[Slots, Slots] | None = None) -> list[str]:
    got = [blocks(p) if p else [] for p in pages]
    return ["\n".join(b.text for b, take in zip(bs, keep, strict=True) if take) for bs, keep in zip(got, labeller.label(got, hashed), strict=True)]


def page_texts(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Columns page_id, url, text, n_chars."""
    lean(pages.sparkSession)
    model = labeller or default_labeller()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed = slots()
        try:
            for column in batches:
                out: list[str] = []
                for lo in range(0, len(column), ROWS):
                    out += extract(column[lo : lo + ROWS].to_pylist(), model, hashed)
                yield pa.array(out, pa.string())
        finally:
            tidy()

    got = pages.select("page_id", "url", text(F.col("html")).alias("text"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
