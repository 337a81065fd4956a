"""Near-duplicate detection by min-max hashing.

Each permutation gives two signature values, the least and the largest hash of
a document's shingles, so a signature of ``2 * PERMUTATIONS`` values takes half
the hash evaluations.  ``ROWS`` values make a band.  At a similarity of 0.8 a
pair shares none of the 50 bands with a probability below 1e-6.

1. Documents with equal shingle sets are one node, known by a 64-bit hash of
   the set; groups of exact copies end here, whatever their size.
2. Nodes meet in buckets (equal bands).  A bucket never emits its pairs: its
   members go to one of them, the hub, which is the member of most buckets and
   so near the middle of its group; all buckets of one hub are one group.
3. A group is read in blocks of bounded size.  A task holds one block and the
   hub, compares the hub with every member and then the members of the block
   that are not connected yet, and emits links only.  This is linear in the
   group and connects nearly all of it.
4. In groups of several blocks that are still not one component, the nodes
   outside the group's largest component meet all members, block by block.
   Pairs of one component are never compared.
5. Candidates of a comparison are pairs whose signatures (one byte a value)
   agree in at least ``AGREE`` places, which a pair at 0.8 misses with a
   probability below 1e-9; a link is confirmed on the full sets.
6. Components follow from repeated minimum over neighbours and pointer
   jumping, as joins of tables; nothing is collected.

Defined results: documents without words (or without text) have no shingles
and are linked with nothing; fewer words than a shingle has are one shingle;
equal rows are linked; rows with one doc_id and different texts are linked
only if their sets are; a null doc_id is linked with nothing, has a null
component and is kept; an empty table gives an empty result; other columns
are ignored, and pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCS_PER_TASK, ROWS_PER_FILE, bounded, compact, hot_join, lean, release, scratch, tidied

PERMUTATIONS, ROWS = 150, 6
N_BANDS = 2 * PERMUTATIONS // ROWS
#: Members and shingles of a group in one block (about), and places in which the signatures of candidates agree.
BLOCK_NODES, BLOCK_SHINGLES, AGREE = 512, 1_000_000, 195
#: Words whose hashes a task holds.
HELD_WORDS = 100_000

_rng = np.random.default_rng(20240917)
_MULTIPLY = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, (PERMUTATIONS, 1), dtype=np.uint32)
_BAND = _rng.integers(0, 2**63, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, the same on every machine; holds a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, words_each: int, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = WordHashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(words_each, len(words))
    n = len(h) - k + 1
    out = _mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        out = _mix(out * np.uint64(31) + h[j : j + n])
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """Least and largest value of one set under each permutation, one after the other."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    most = np.zeros(PERMUTATIONS, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 1024):
        v = np.multiply.outer(_MULTIPLY, x[lo : lo + 1024])
        v += _ADD
        np.minimum(least, v.min(1), out=least)
        np.maximum(most, v.max(1), out=most)
    return np.stack([least, most], 1).reshape(-1)


def bands(values: np.ndarray) -> np.ndarray:
    """Hashes of the bands of one signature."""
    rows = _mix(values.astype(np.uint64)).reshape(-1, ROWS)
    out = np.arange(len(rows), dtype=np.uint64) * _BAND[ROWS]
    for k in range(ROWS):
        out = _mix(out + rows[:, k] * _BAND[k])
    return out.view(np.int64)


def short(values: np.ndarray) -> bytes:
    """One byte of each value of a signature."""
    return (_mix(values.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def _node(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def _sketch(words_each: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _slices(batches):
            sizes, nodes, found = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingles(t, words_each, hashes)
                sizes.append(len(s))
                nodes.append(_node(s))
                found.append(bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "node", "bands"])

    return run


def _sets(words_each: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _slices(batches):
            found = [shingles(t, words_each, hashes) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([short(signature(s)) for s in found], pa.binary())], ["node", "set", "sig"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Held:
    """Nodes in one task: sets, signatures and what is connected."""

    def __init__(self, rows: list[tuple]):
        self.nodes = [r[0] for r in rows]
        self.sets = [r[1] for r in rows]
        self.sigs = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        self.sizes = np.array([len(s) for s in self.sets])
        _, self.label = np.unique([r[3] for r in rows], return_inverse=True)

    def meet(self, i: int, others: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """Links of row i to those of the others that it is not connected with yet, likely ones first."""
        others = others[self.label[others] != self.label[i]]
        n = self.sizes[others]
        others = others[(100 * np.minimum(n, self.sizes[i]) >= percent * np.maximum(n, self.sizes[i]))]
        agree = (self.sigs[others] == self.sigs[i]).sum(1)
        near = agree >= AGREE
        for j in others[near][np.argsort(-agree[near], kind="stable")].tolist():
            if self.label[j] != self.label[i] and linked(self.sets[i], self.sets[j], percent):
                self.label[self.label == self.label[j]] = self.label[i]
                yield self.nodes[i], self.nodes[j]


def _in_block(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """The hub (the first row, part 0) with all others, then the others of one block."""
    held = Held(rows)
    for i in range(len(rows) - 1):
        yield from held.meet(i, np.arange(i + 1, len(rows)), percent)


def _across(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Rows of part 0 with those of part 1."""
    held = Held(rows)
    part = np.array([r[4] for r in rows])
    other = np.flatnonzero(part == 1)
    for i in np.flatnonzero(part == 0).tolist():
        yield from held.meet(i, other, percent)


def _by_block(compare: Callable, percent: int):
    """Rows come sorted by (hub, block, part); each block is compared when it is complete."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        found: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            nonlocal found
            got, found = found, []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in _slices(batches, 500):
            sets = batch.column("set")
            flat = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = sets.offsets.to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("hub", "block", "part", "node", "sig", "label")]
            for k, (hub, block, part, node, sig, label) in enumerate(zip(*columns, strict=True)):
                if key != (hub, block):
                    if len(held) > 1:
                        found += compare(held, percent)
                    held, key = [], (hub, block)
                    if len(found) > 10_000:
                        yield out()
                held.append((node, flat[offsets[k] : offsets[k + 1]].copy(), sig, label, part))
        if len(held) > 1:
            found += compare(held, percent)
        yield out()

    return run


def _blocks(nodes: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(nodes / BLOCK_NODES, shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(rows: DataFrame, sets: DataFrame, compare: Callable, percent: int, most: int) -> DataFrame:
    """Links, at most ``most``, from rows (hub, block, part, node, label)."""
    full = rows.join(sets, "node").repartition("hub", "block").sortWithinPartitions("hub", "block", "part", "node")
    return scratch(full.mapInArrow(_by_block(compare, percent), "a long, b long").distinct(), "links", most)


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the blocks of each hub; ``pairs`` has hub, node, n (shingles) and blocks."""
    members = pairs.select("hub", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("part"))
    hubs = pairs.groupBy("hub").agg(F.max("blocks").alias("blocks")).select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("part"))
    return _dealt(members.unionByName(hubs).withColumn("label", F.col("node")), sets, _in_block, percent, pairs.count())


def block_links(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links across the blocks of groups that are not one component yet; None if there is no such group."""
    members = _label_of(pairs.where("blocks > 1"), labels, "node", "label")
    per = members.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    hubs = per.groupBy("hub").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("m"), F.max("m").alias("in_main"), F.sum("t").alias("t"), F.max_by("t", F.struct("m", "label")).alias("t_main"))
    hubs = hubs.where("m > in_main").select("hub", "main", _blocks(F.col("m"), F.col("t")).alias("across"), F.greatest(_blocks(F.col("m") - F.col("in_main"), F.col("t") - F.col("t_main")), F.lit(1)).alias("down"))
    members = scratch(members.select("hub", "node", "label").join(hubs, "hub"), "members", pairs.count())
    if not members.limit(1).count():
        return None
    number = F.pmod(F.xxhash64("node", F.lit(1)), F.col("across")), F.pmod(F.xxhash64("node", F.lit(2)), F.col("down"))
    # the block in row i and column k is i * across + k
    odd = members.where("label <> main").select("hub", "node", "label", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("k"), "across", number[1].alias("i"), F.lit(0).alias("part"))
    all_ = members.select("hub", "node", "label", number[0].alias("k"), "across", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.lit(1).alias("part"))
    rows = odd.unionByName(all_).select("hub", (F.col("i") * F.col("across") + F.col("k")).alias("block"), "part", "node", "label")
    links = _dealt(rows, sets, _across, percent, pairs.count())
    release(members)
    return links


def choose_hubs(buckets: DataFrame) -> DataFrame:
    """(bucket, hub): the member of most buckets."""
    rank = buckets.groupBy("node").agg((-F.count(F.lit(1))).alias("rank"))
    return buckets.join(rank, "node").groupBy("bucket").agg(F.min(F.struct("rank", "node")).alias("h")).select("bucket", F.col("h.node").alias("hub"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of a link (a, b) can reach."""
    n = 2 * links.count()
    both = scratch(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", n)
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels", n)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = scratch(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels", n)
        moved = step.where("label < old").limit(1).count()
        release(labels)
        labels = step.drop("old")
        labels._scratch = step._scratch
        if not moved:
            release(both)
            return labels


def _label_of(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the label of a node; a node without links is its own."""
    return df.join(labels.select(F.col("node").alias(node), F.col("label").alias("__l")), node, "left").withColumn(name, F.coalesce("__l", node)).drop("__l")


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the labels they join, then of the nodes."""
    ends = _label_of(_label_of(links.withColumnsRenamed({"a": "x", "b": "y"}), labels, "x", "a"), labels, "y", "b")
    across = scratch(ends.where("a <> b").select("a", "b"), "across", links.count())
    over = components(across)
    release(across)
    moved = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = over.join(labels.select("node"), "node", "left_anti")
    out = scratch(moved.unionByName(fresh), "labels", labels.count() + over.count())
    release(labels, over)
    return out


def _known(docs: DataFrame) -> DataFrame:
    """Rows by doc_id and a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")


def groups(docs: DataFrame, words_each: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n_shingles, node), and per node its rows and the first row (doc_id, h) of its component."""
    lean(docs.sparkSession)
    texts = _known(docs)
    total = docs.count()
    rows = scratch(compact(texts, total, DOCS_PER_TASK).mapInArrow(_sketch(words_each), "doc_id long, h long, n_shingles long, node long, bands array<long>"), "sketches")
    linkable = rows.where("node is not null and doc_id is not null")
    copies = scratch(linkable.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "h")).alias("first"), F.min("n_shingles").alias("n")), "copies", total)
    one = copies.select("node", "first.doc_id", "first.h")
    exploded = linkable.select("node", "doc_id", "h", "bands").join(one, ["node", "doc_id", "h"]).select("node", F.explode("bands").alias("bucket"))
    full = exploded.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket")
    buckets = scratch(exploded.join(full, "bucket").select("bucket", "node").distinct(), "buckets", total * N_BANDS, 5 * ROWS_PER_FILE)
    wanted = scratch(buckets.select("node").distinct().join(one, "node").select("doc_id", "h"), "wanted", total)
    once = texts.join(bounded(wanted), ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    sets = scratch(compact(once.select("text"), wanted.count(), DOCS_PER_TASK).mapInArrow(_sets(words_each), "node long, set array<long>, sig binary"), "sets")
    pairs = buckets.join(choose_hubs(buckets), "bucket").where("node <> hub").select("hub", "node").distinct()
    pairs = pairs.join(copies.select("node", "n"), "node")
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    pairs = scratch(pairs.join(sizes.select("hub", F.greatest(_blocks(F.col("m"), F.col("t")), F.lit(1)).alias("blocks")), "hub"), "pairs", buckets.count())
    links = hub_links(pairs, sets, percent)
    labels = components(links)
    more = block_links(pairs, labels, sets, percent)
    if more is not None:
        labels = merge_labels(labels, more)
        release(more)
    first = copies.join(labels, "node").groupBy("label").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("m"))
    least = hot_join(labels, first, ["label"], "m", labels.count()).select("node", "least")
    placed = scratch(copies.select("node", "rows", "first").join(least, "node", "left").select("node", "rows", F.coalesce("least", "first").alias("least")), "placed", total)
    release(copies, buckets, wanted, sets, pairs, links, labels)
    return rows.drop("bands"), placed


def find_components(docs: DataFrame, words_each: int = 2, percent: int = 80) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept; one row per input row."""
    rows, placed = groups(docs, words_each, percent)
    linkable = "node is not null and doc_id is not null"
    found = rows.where(linkable)
    found = hot_join(found, placed, ["node"], "rows", found.count()).select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"))
    alone = rows.where(f"not ({linkable})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The first row, by doc_id and a hash of the text, of each component.

    Rows without words or without a doc_id stay.  Of rows that are equal in
    doc_id and text one stays, whatever their other columns.
    """
    rows, placed = groups(docs, words_each, percent)
    known = rows.where("node is not null and doc_id is not null")
    first = placed.select("least.doc_id", "least.h", F.lit(True).alias("stays")).distinct()
    times = known.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")).join(first, ["doc_id", "h"], "left")
    marked = scratch(times.where("stays is null or times > 1").select("doc_id", "h", "times", F.coalesce("stays", F.lit(False)).alias("stays")), "marked", rows.count())
    wordy = F.length(F.trim(F.translate("text", "\t\n\r\x0b\x0c", "     "))) > 0
    held = docs.select(F.struct(*docs.columns).alias("row"), F.when(wordy, F.col("doc_id").cast("long")).alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    held = held.join(bounded(marked), ["doc_id", "h"], "left")
    once = held.where("times is null").select("row.*")
    if not marked.where("stays and times > 1").limit(1).count():
        return once
    again = held.where("stays and times > 1").groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))
