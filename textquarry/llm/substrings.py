"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of ``WIDTH`` bytes that also starts elsewhere,
in the same document or another one, is removed.

1. *Anchors.*  Each window of ``WIDTH`` bytes has an anchor: the gram of least
   hash in it.  Equal windows have equal anchors, so windows can repeat only
   among the places that share an anchor hash.  A run of windows with one
   anchor is a row: hash, place, and a 128-bit digest (BLAKE2) of its bytes.
2. Runs whose hash is unique are dropped.  Runs of one anchor and one digest
   are equal and repeat as a whole; exact copies and the inside of shared
   passages end here, in counts that combine before the shuffle.
3. The bytes of one run of each remaining kind are fetched.  A task takes the
   runs of many anchors in blocks of ``BLOCK_BYTES``, builds the transform of
   a block and expands its intervals breadth first: intervals of strings of
   length l give the common prefixes of length l, for l from 0 up to
   ``WIDTH``, and there the expansion stops.  Neighbours whose common prefix
   is not set by then share a window.
4. An anchor has to be in one block with all its runs.  Where they are more
   bytes than a block holds, the windows of its runs get anchors of longer
   grams, and steps 1 to 3 deal with these finer runs.  ``GRAMS`` ends with the
   window itself, whose runs are equal, so every group comes to fit a block.

A document is known by two 64-bit hashes of the SHA-256 of its text.  Rows of
one text have one set of spans: all of it, if it is as long as a window.  Texts
that more than a thousandth of all rows have are handled by broadcast, so no
task gets all rows of one text.

Defined results: a null text is an empty one; texts shorter than a window keep
all bytes; equal texts repeat each other and lose all bytes if they are as long
as a window, whatever their doc_ids; rows without a doc_id, or of one doc_id
with different texts, are documents of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, hot_join, lean, release, scratch, tidied

WIDTH = 200
#: Lengths of anchors; the next one is for groups that the one before leaves larger than a block.
GRAMS = (48, 120, 160, 190, WIDTH)
BLOCK_BYTES = 1_000_000
#: Text bytes that are hashed at a time, and runs in a file where there are as many.
CHUNK_BYTES, ROWS_PER_FILE = 2_000_000, 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, b in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(2 * n, b, np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p))
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text number, first window, windows, anchor hash, two halves of the run's digest)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return (none,) * 6
    h = Hasher(data)
    grams = _mix((h.sums[gram:] - h.sums[:-gram]) * h.down[: len(data) - gram + 1])
    best = np.arange(len(grams), dtype=np.int32)
    span, want = 1, width - gram + 1
    while span < want:
        step = min(span, want - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        span += step
    # windows of one text only
    fits = np.flatnonzero(sizes >= width)
    counts = sizes[fits] - width + 1
    window = np.repeat(starts[fits] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    text = np.repeat(fits, counts)
    at = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(window)]]))
    begin = window[first]
    whole, digest = data.tobytes(), hashlib.blake2b
    c = np.frombuffer(b"".join(digest(whole[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), (begin + length - 1 + width).tolist(), strict=True)), np.int64).reshape(-1, 2)
    return text[first], begin - starts[text[first]], length, grams[at[first]].view(np.int64), c[:, 0], c[:, 1]


def transform(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` symbols (under 512, the last the only 0), and the transform."""
    n = len(seq)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        if k < n:
            key[: n - k] += seq[k:]
    known = 7
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if known >= depth or rank[order[-1]] == n - 1:
            return order, seq[order - 1]
        key = rank * (n + 1)
        if known < n:
            key[: n - known] += rank[known:] + 1
        known *= 2


def unset_prefixes(bwt: np.ndarray, width: int) -> np.ndarray:
    """For each row but the first whether it shares ``width`` symbols with the row before."""
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by_symbol] = np.arange(n)
    change = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    run = np.cumsum(np.concatenate([[0], (bwt[1:] != bwt[:-1]).astype(np.int64)]))
    ends = np.concatenate([change[1:], [n]])
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(width):
        if not len(low):
            break
        # the runs of equal symbols inside each interval
        a = run[low]
        pieces = run[high - 1] - a + 1
        total = int(pieces.sum())
        owner = np.repeat(np.arange(len(low)), pieces)
        r = np.repeat(a - np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces) + np.arange(total)
        s, e = np.maximum(change[r], low[owner]), np.minimum(ends[r], high[owner])
        to, size, symbol = forward[s], e - s, bwt[s]
        if total > len(low):
            o = np.argsort(to)
            to, size, symbol, owner = to[o], size[o], symbol[o], owner[o]
            joined = np.concatenate([[False], (owner[1:] == owner[:-1]) & (symbol[1:] == symbol[:-1]) & (to[1:] == to[:-1] + size[:-1])])
            head = np.flatnonzero(~joined)
            last = np.concatenate([head[1:], [total]]) - 1
            low, high = to[head], to[last] + size[last]
        else:
            low, high = to, to + size
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
    return unset[1:n]


def repeated_windows(runs: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each byte string which of its windows occurs at another place of the strings."""
    sizes = np.array([len(r) for r in runs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    seq = np.ones(int(starts[-1]) + 1, np.int64)  # 1 ends a string, 0 the sequence
    seq[-1] = 0
    for r, s in zip(runs, starts.tolist(), strict=False):
        seq[s : s + len(r)] = np.frombuffer(r, np.uint8)
        seq[s : s + len(r)] += 2
    order, bwt = transform(seq, width)
    shared = unset_prefixes(bwt, width)
    hit = np.zeros(len(seq), bool)
    hit[order[1:][shared]] = True
    hit[order[:-1][shared]] = True
    return [hit[s : s + max(0, n - width + 1)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=False)]


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _id(text: Column) -> list[Column]:
    """The key of a text: two hashes of its SHA-256."""
    digest = F.sha2(text, 256)
    return [F.xxhash64(digest).alias("k1"), F.xxhash64(digest, F.lit(1)).alias("k2")]


_KEY = ["k1", "k2"]
_RUN = "k1 long, k2 long, first long, windows long, h long, c1 long, c2 long"
_RUN_NAMES = [x.split(" ")[0] for x in _RUN.split(", ")]
_FETCHED = "k1 long, k2 long, first long, h long, single boolean, bytes binary"
_SPANS = "k1 long, k2 long, start long, end long"


@tidied
def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        text, *columns = anchors([(t or "").encode() for t in part.column(2).to_pylist()])
        take = pa.array(text)
        return pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *map(pa.array, columns)], _RUN_NAMES)

    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            n = 200
            while n > 1 and batch.column(2).slice(lo, n).nbytes > CHUNK_BYTES:
                n //= 2
            yield rows(batch.slice(lo, n))
            lo += n


def _finer(gram: int):
    """Runs by anchors of ``gram`` bytes, each with its bytes, of runs that have theirs."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                data = part.column("bytes").to_pylist()
                of, first, windows, *hashes = anchors(data, gram=gram)
                take = pa.array(of)
                pieces = [data[k][a : a + n - 1 + WIDTH] for k, a, n in zip(of.tolist(), first.tolist(), windows.tolist(), strict=True)]
                at = part.column("first").to_numpy(zero_copy_only=False)[of] + first
                columns = [part.column("k1").take(take), part.column("k2").take(take), pa.array(at, pa.int64()), pa.array(windows), *map(pa.array, hashes), part.column("single").take(take), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*_RUN_NAMES, "single", "bytes"])

    return run


@tidied
def _fetch_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text; of rows with one text, which are in one task, the first is read."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            columns: list[list] = [[] for _ in types]
            for k1, k2, text, wanted in zip(*(part.column(n).to_pylist() for n in ("k1", "k2", "text", "wanted")), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                data = text.encode()
                for w in wanted:
                    values = (k1, k2, w["first"], w["h"], w["single"], w["fits"], data[w["first"] : w["first"] + w["windows"] - 1 + WIDTH])
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k1", "k2", "first", "h", "single", "fits", "bytes"])


@tidied
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole anchors (rows come sorted by h): ranges of bytes to remove."""
    held: list[tuple] = []
    size = 0
    last = None

    def block() -> pa.RecordBatch:
        columns: list[list[int]] = [[] for _ in range(4)]
        for (k1, k2, first, _, single, _), hit in zip(held, repeated_windows([x[5] for x in held]), strict=True):
            if single and hit.any():
                for a, b in zip(*(x.tolist() for x in _ranges(hit)), strict=True):
                    for c, v in zip(columns, (k1, k2, first + a, first + b - 1 + WIDTH), strict=True):
                        c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "start", "end"])

    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "first", "h", "single", "bytes")), strict=True)
        for row in rows:
            if size >= BLOCK_BYTES and row[3] != last:
                yield block()
                held, size = [], 0
            held.append(row)
            size += len(row[5])
            last = row[3]
    if held:
        yield block()


@tidied
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            out: list[list] = [[] for _ in range(4)]
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                keep = np.ones(len(data), bool)
                for s in spans or ():
                    keep[s["start"] : s["end"]] = False
                kept = np.frombuffer(data, np.uint8)[keep].tobytes()
                for c, v in zip(out, (len(data), len(data) - len(kept), len(_ranges(~keep)[0]), kept), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array([hashlib.sha256(k).hexdigest() for k in out[3]]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _hot_texts(texts: DataFrame) -> DataFrame:
    """Keys of texts with more than a small share of all rows; under HOT_SHARE of them."""
    counts = scratch(texts.select(*_KEY).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    limit = max(1000, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    return counts.where(F.col("n") > limit).select(*_KEY, F.lit(True).alias("hot"))


def _level(runs: DataFrame, total: int, carried: list[str], single) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of runs that repeat as a whole, and one run of each kind whose anchor needs a comparison.

    ``carried`` are columns besides place that a run brings along, and
    ``single`` says whether a kind of one run may be a run found nowhere else yet.
    """
    common = scratch(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common", total, ROWS_PER_FILE)
    again = scratch(hot_join(runs, common, ["h"], "n", total).drop("n"), "again", total, ROWS_PER_FILE)
    release(common)
    key = ["h", "c1", "c2", "windows"]
    kinds = scratch(again.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(*_KEY, "first", *carried)).alias("one")), "kinds", total, ROWS_PER_FILE)
    spans = [*map(F.col, _KEY), F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + WIDTH).alias("end")]
    whole = scratch(hot_join(again, kinds.where("m > 1").select(*key, "m"), key, "m", total).select(*spans).distinct(), "whole", total, ROWS_PER_FILE)
    release(again)
    open_ = (F.col("m") == 1) & single
    size = F.col("windows") + WIDTH - 1
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max(open_.cast("int")).alias("open"), (F.sum(size) <= BLOCK_BYTES).alias("fits")).where("kinds > 1 and open = 1").drop("open")
    wanted = hot_join(kinds, groups, ["h"], "kinds", total).select("one.*", "windows", "h", "fits", open_.alias("__single"))
    return whole, wanted.drop("single").withColumnRenamed("__single", "single"), kinds


def removal_spans(docs: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Byte ranges to remove, overlapping ones not yet merged: k1, k2 (the text's key), start, end."""
    lean(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text")).where(F.octet_length("text") >= WIDTH).select(*_id(F.col("text")), "text")
    hot = _hot_texts(texts) if hot is None else hot
    runs = scratch(texts.mapInArrow(_anchor_rows, _RUN), "anchors")
    whole, wanted, kinds = _level(runs, runs.count(), [], F.lit(True))
    release(runs)
    wanted = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("h", "first", "windows", "single", "fits")).alias("wanted"))
    marked = texts.join(F.broadcast(hot), _KEY, "left")
    few = marked.where("hot").groupBy(*_KEY).agg(F.first("text").alias("text"))  # of a text with very many rows one is enough
    cold = marked.where("hot is null").drop("hot").join(wanted.hint("shuffle_hash"), _KEY).select(*_KEY, "text", "wanted")
    fetched = cold.unionByName(few.join(wanted, _KEY).select(*_KEY, "text", "wanted"))
    fetched = scratch(fetched.mapInArrow(_fetch_runs, _FETCHED.replace("single boolean", "single boolean, fits boolean")), "runs")
    release(kinds)
    tables, found = [whole, fetched], [whole]
    for gram in GRAMS[1:]:
        found.append(scratch(_compared(fetched.where("fits").drop("fits")), "compared"))
        large = fetched.where("not fits")
        if large.isEmpty():
            break
        finer = scratch(large.drop("h", "fits").mapInArrow(_finer(gram), f"{_RUN}, single boolean, bytes binary"), "finer")
        whole, wanted, kinds = _level(finer, finer.count(), ["single", "bytes"], F.col("one.single"))
        fetched = scratch(wanted.select(*_KEY, "first", "h", "single", (F.col("fits") | F.lit(gram == WIDTH)).alias("fits"), "bytes"), "runs")
        release(finer, kinds)
        tables += [whole, fetched]
        found.append(whole)
    else:
        found.append(scratch(_compared(fetched.drop("fits")), "compared"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = scratch(out, "spans")
    release(*{id(t): t for t in [*tables, *found]}.values())
    return out


def _compared(runs: DataFrame) -> DataFrame:
    return runs.repartition("h").sortWithinPartitions("h").mapInArrow(_compare, _SPANS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *_id(F.col("text")))
    hot = _hot_texts(rows.where(F.octet_length("text") >= WIDTH))
    spans = removal_spans(docs, hot).distinct().groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = rows.join(F.broadcast(hot), _KEY, "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    copies = marked.where("hot").select("doc_id", "text", all_of_it.alias("spans"))
    cold = marked.where("hot is null").drop("hot").join(spans.hint("shuffle_hash"), _KEY, "left").select("doc_id", "text", "spans")
    return cold.unionByName(copies).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("kept")
