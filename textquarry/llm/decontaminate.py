"""Benchmark decontamination with an FM-index per training shard.

A benchmark item gives its windows of ten consecutive words (an item of fewer
words is one window).  A task takes its documents in shards of
``SHARD_BYTES`` of text and indexes each: suffix array, Burrows-Wheeler
transform in a wavelet matrix, sampled suffix positions.  All windows are
searched backwards at once, word by word; the occurrences are located by
walking to the next sampled position, and the word ranges are merged.

A window holds benchmark words only, so only runs of benchmark words that are
as long as the shortest window go into the index.  This loses nothing and
keeps the index small.

Benchmarks are read in blocks of ``BLOCK_BYTES`` of text, one pass over the
documents per block, so what is broadcast is bounded whatever their size.

Defined results: a null or empty text has no words and no hits; null or empty
items have no windows; the windows of an item without an id are hit like
others, but there is no id to list or count; items with one id are one item;
an empty benchmark hits nothing; equal rows, and rows without a doc_id, are
kept; a text of any length is one document of its shard and is read whole; in
``remove_hits`` all other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, release, scratch, tidied, with_new_text

WINDOW = 10
SHARD_BYTES, BLOCK_BYTES = 8_000_000, 4_000_000
#: Words: runs of bytes that are none of these, after A-Z are lower-cased.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Symbols of the index: end of the sequence, end of a run; words follow.
END, BREAK, FIRST = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


class WaveletMatrix:
    """Rank and access over a sequence of small integers, for arrays of arguments."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            b = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])
        symbols = np.arange(1 << bits)
        self.first = self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][i]
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        return self._down(c, i) - self.first[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            ones = self.ones[k][i]
            bit = self.ones[k][i + 1] - ones
            c = 2 * c + bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return c, i - self.first[c]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the only least one."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = new
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class FMIndex:
    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        sa = suffix_array(seq)
        self.n = len(seq)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.bwt = WaveletMatrix(seq[sa - 1].astype(np.int64), max(1, int(n_symbols - 1).bit_length()))
        marked = sa % sample == 0
        self.marked = marked
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of patterns of one length (rows): (pattern number, low, high), without empty ones."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, j]
            lo, hi = self.starts[c] + self.bwt.rank(c, lo), self.starts[c] + self.bwt.rank(c, hi)
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the suffix array."""
        out = np.empty(len(rows), np.int64)
        at = np.arange(len(rows))
        steps = 0
        while len(rows):
            known = self.marked[rows]
            out[at[known]] = self.sampled[self.marks[rows[known]]] + steps
            rows, at = rows[~known], at[~known]
            if len(rows):
                c, r = self.bwt.access_rank(rows)
                rows = self.starts[c] + r
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, by length, in arrays."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST) for w in words_of(text)], np.int32)
            if len(ids):
                n = min(window, len(ids))
                rows = np.lib.stride_tricks.sliding_window_view(ids, n)
                owner = -1 if item_id is None else names.setdefault(str(item_id), len(names))
                found.setdefault(n, []).append((rows, np.full(len(rows), owner)))
        self.names = list(names)
        #: For each length the distinct windows, and where their items start in the list of items.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(found):
            patterns, which = np.unique(np.concatenate([r for r, _ in found[n]]), axis=0, return_inverse=True)
            owner = np.concatenate([o for _, o in found[n]])
            pairs = np.unique(np.stack([which.reshape(-1), owner], 1)[owner >= 0], axis=0).astype(np.int32)
            self.by_length[n] = (patterns, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1])

    def encode(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(BREAK)), np.int32, len(words))

    def hits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(begin, end) word ranges over the encoded documents, one BREAK after each, and each document's items."""
        none, no_items = np.zeros(0, np.int64), [[] for _ in docs]
        if not self.by_length or not docs:
            return none, none, no_items
        gap = np.full(1, BREAK, np.int32)
        seq = np.concatenate([x for d in docs for x in (d, gap)])
        ends = np.cumsum([len(d) + 1 for d in docs])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (seq != BREAK).view(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= min(self.by_length)
        begin, end = begin[long], end[long]
        if not len(begin):
            return none, none, no_items
        length = end - begin + 1  # with the BREAK that follows
        source = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        index = FMIndex(np.concatenate([seq[source], [END]]), len(self.vocabulary) + FIRST)
        lows, highs, owned = [none], [none], [none]
        for n, (patterns, first, owners) in self.by_length.items():
            which, lo, hi = index.search(patterns)
            size = hi - lo
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            place = source[index.locate(rows)]
            doc = np.searchsorted(ends, place, side="right")
            pairs = np.unique(doc * len(patterns) + np.repeat(which, size))
            doc, which = pairs // len(patterns), pairs % len(patterns)
            count = first[which + 1] - first[which]
            item = owners[np.repeat(first[which] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())]
            lows.append(place)
            highs.append(place + n)
            owned.append(np.repeat(doc, count) * max(len(self.names), 1) + item)
        for x in np.unique(np.concatenate(owned)).tolist():
            no_items[x // len(self.names)].append(self.names[x % len(self.names)])
        return np.concatenate(lows), np.concatenate(highs), no_items


def benchmark_blocks(benchmark: DataFrame, block_bytes: int | None = None) -> Iterator[Phrases]:
    """The benchmark's windows, from at most about ``block_bytes`` of its text at a time."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_bytes or BLOCK_BYTES)))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Phrases([(r["item_id"], r["text"]) for r in part.collect()])


HITS = [
    T.StructField("__n_words", T.LongType()),
    T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("__items", T.ArrayType(T.StringType())),
]


def find_hits(docs: DataFrame, benchmark: DataFrame, cut: bool = False) -> DataFrame:
    """Columns row (the columns of ``docs`` but the text), text, __n_words, __spans (merged ranges of hit words), __items.

    With ``cut`` the text comes without the hit passages, else it is null.
    One block of the benchmark is in memory at a time; what the blocks before
    the last one hit is kept in a written table.
    """
    lean(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    out = docs.select((F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("row"), "text")
    held, last = None, None
    for phrases in benchmark_blocks(benchmark):
        if last is not None:  # there is one more block
            step = scratch(_pass(out, last, cut=False, first=held is None), "hits")
            last.destroy()
            if held is not None:
                release(held)
            out = held = step
        last = docs.sparkSession.sparkContext.broadcast(phrases)
        del phrases
    return _pass(out, last, cut, first=held is None, final=True)


def _pass(docs: DataFrame, shared: Broadcast, cut: bool, first: bool, final: bool = False) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = [docs.schema["row"], docs.schema["text"], *HITS]

    def shard(batches: list[pa.RecordBatch], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lows, highs, items = shared.value.hits(words)
        counts = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        if not first:
            before = [x for b in batches for x in b.column("__spans").to_pylist()]
            lows = np.concatenate([lows, np.array([s["start"] + starts[k] for k, x in enumerate(before) for s in x], np.int64)])
            highs = np.concatenate([highs, np.array([s["end"] + starts[k] for k, x in enumerate(before) for s in x], np.int64)])
            items = [sorted({*own, *x}) for own, x in zip(items, (x for b in batches for x in b.column("__items").to_pylist()), strict=True)]
        cover = np.zeros(starts[-1] + 1, np.int32)
        np.add.at(cover, lows, 1)
        np.add.at(cover, highs, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8), [0]])))
        spans: list[list[dict[str, int]]] = [[] for _ in counts]
        for a, b, d in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(starts, edge[::2], side="right") - 1).tolist(), strict=True):
            spans[d].append({"start": a - int(starts[d]), "end": b - int(starts[d])})
        at = 0
        for b in batches:
            part = slice(at, at + b.num_rows)
            at += b.num_rows
            text = b.column("text")
            if cut:
                text = pa.array([cut_words(t, s) if s else t for t, s in zip(text.to_pylist(), spans[part], strict=True)], text.type)
            elif final:
                text = pa.nulls(b.num_rows, text.type)
            yield pa.RecordBatch.from_arrays([b.column("row"), text, pa.array(counts[part]), pa.array(spans[part], span), pa.array([sorted(x) for x in items[part]], pa.list_(pa.string()))], [f.name for f in fields])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size = [], [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                held.append(batch)
                words += map(shared.value.encode, batch.column("text").to_pylist())
                size += batch.column("text").nbytes
                if size >= SHARD_BYTES:
                    yield from shard(held, words)
                    held, words, size = [], [], 0
        if held:
            yield from shard(held, words)

    return docs.mapInArrow(run, T.StructType(fields))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "row.doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[dict[str, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with benchmark passages cut out of ``text``; ``n_chars``, if there, follows."""
    found = find_hits(docs, benchmark, cut=True).select("row", "text", (F.size("__spans") == 0).alias("clean"))
    return found.select(*with_new_text(docs, "row", F.col("text"), F.col("clean")))
