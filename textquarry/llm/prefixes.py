"""Prefix trie of conversations by Patricia construction.

A conversation is a sequence of turns; every distinct sequence of first turns
is a node, and what the members of a node share has to be computed once only.

1. A turn becomes a 128-bit digest of role and text and a number of words.
   A conversation is the string of its digests, so the order of bytes is an
   order of sequences, with a prefix before what it begins.
2. Equal conversations become one row with a count.
3. The distinct ones are sorted in ranges.  A task goes through its range once
   and makes a point only where a conversation ends or two part; between points
   are edges.  Members, leaves and word sums are added up on the points.
4. When a point is done, the nodes of its edge are written out: their numbers
   are the point's, their word sums come from suffix sums over the edge.
5. Only prefixes of the first and the last sequence of a range can have parts
   in other ranges.  These nodes are added up by key, after each border between
   ranges has taken off what both of its sides counted.

A task holds the path it is on, so memory is bounded by the longest
conversation (some 100 bytes a turn) and the children of nodes that are not
done.  The hash over the ids that end in a node reads them in order; ids of
sequences that occur more than once are sorted in ranges and joined to strings
of ``IDS`` ids there, so the one task that hashes a large group reads few rows.

Defined results: rows without a conv_id belong to no conversation and are left
out; a null role or text is empty, a null turn comes first; equal turn numbers
stand in the order of role, then digest, so repeated rows stay next to each
other and count as turns of their own; texts of any length are read whole;
a conversation without turns ends in the root; an empty table has no nodes;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, lean, partitions, release, scratch, tidied

DIGEST = 16
#: Ids in one string, distinct conversations in a range and in a file where there are as many, rows written at a time.
IDS, PER_RANGE, PER_FILE, ROWS = 4000, 50_000, 5000, 10_000
NOBODY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def sequences(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order, as (turn, role, digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def share_heads(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of the first conversation of their group of ids.

    h is the CRC-32 of the id modulo ``most``; a conversation keeps its own
    turns from the one after its h-th.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    own = convs.select("conv_id", base, "turns", h.cast("int").alias("h"))
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    got = own.join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return got.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high:  # the first ``low`` are equal, the first ``high + 1`` are not
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_keys(seq: bytes, low: int, high: int) -> list[bytes]:
    """Keys of the prefixes of ``low`` to ``high`` turns."""
    h = hashlib.md5(seq[: low * DIGEST], usedforsecurity=False)
    out = [h.digest()]
    for d in range(low, high):
        h.update(seq[d * DIGEST : (d + 1) * DIGEST])
        out.append(h.copy().digest())
    return out


def word_sums(words: list[int]) -> list[int]:
    """Words of the first 0, 1, ... turns."""
    out = [0]
    for w in words:
        out.append(out[-1] + w)
    return out


class Point:
    """A node that ends or branches: what is known of its members and of the nodes below it."""

    __slots__ = ("below", "children", "conv", "depth", "distinct", "first", "leaves", "n", "sha", "waiting")

    def __init__(self, depth: int, first: bool):
        self.depth, self.first = depth, first
        self.n = self.children = self.leaves = self.below = self.distinct = 0
        self.conv: int | None = None
        self.sha: str | None = None
        self.waiting: list[tuple] = []

    def end(self, conv: int, n: int, sha: str) -> Point:
        self.n, self.conv, self.sha = self.n + n, conv if self.conv is None else min(conv, self.conv), sha
        return self


#: A node in one range (parent_conv_id known, or parent_key one of the range's borders), or a part of a node on the range's borders (key).
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, words long, distinct_words long, ends_sha256 string, key binary, parent_key binary"
_NODE_TYPES = [pa.int64()] * 8 + [pa.string(), pa.binary(), pa.binary()]
#: First and last sequence of a range.
EDGE = "part int, first_seq binary, last_seq binary, last_words array<int>"
_EDGE_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]


class Range:
    """The nodes of one range of sorted distinct sequences."""

    def __init__(self):
        root = Point(0, True)
        self.stack, self.seq, self.words = [root], b"", [0]
        self.rows: list[tuple] = []
        self.first: bytes | None = None

    def add(self, seq: bytes, words: list[int], conv: int, n: int, sha: str) -> None:
        shared = common_turns(self.seq, seq)
        self.close(shared, False)
        first = self.first is None
        if first:
            self.first = seq
        self.seq, self.words = seq, word_sums(words)
        if seq:
            self.stack.append(Point(len(seq) // DIGEST, first).end(conv, n, sha))
        else:
            self.stack[0].end(conv, n, sha)

    def close(self, depth: int, last: bool) -> None:
        """Write out the edges below ``depth``; a point is made there if none is."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, point.first))
            self.edge(point, self.stack[-1], last)

    def edge(self, point: Point, above: Point, last: bool) -> None:
        """The nodes from below ``above`` down to ``point``, and their share in ``above``."""
        point.leaves = point.leaves or 1
        a, b, sums = above.depth, point.depth, self.words
        shared = point.first or last
        keys = prefix_keys(self.seq, a, b) if shared else None
        above_key = keys[0] if keys else prefix_keys(self.seq, a, a)[0] if above.first else None
        for d in range(b, a, -1):
            tail = sums[b] - sums[d - 1]
            row = (point.conv, d, point.conv, point.n, point.children if d == b else 1, point.leaves, point.n * tail + point.below, tail + point.distinct, point.sha if d == b else None)
            if shared:
                self.rows.append((*row[:2], None, *row[3:], keys[d - a], keys[d - a - 1]))
            elif d > a + 1:
                self.rows.append((*row, None, None))
            elif above_key is not None:
                self.rows.append((*row[:2], None, *row[3:], None, above_key))
            else:
                above.waiting.append(row)
        self.settle(point, keys[-1] if shared else None)
        edge = sums[b] - sums[a]
        above.n, above.children, above.leaves = above.n + point.n, above.children + 1, above.leaves + point.leaves
        above.below, above.distinct = above.below + point.n * edge + point.below, above.distinct + edge + point.distinct
        above.conv = point.conv if above.conv is None else min(above.conv, point.conv)

    def settle(self, point: Point, key: bytes | None) -> None:
        """Write out the children that waited for their parent."""
        for row in point.waiting:
            self.rows.append((*row[:2], None if key else point.conv, *row[3:], None, key))
        point.waiting = []

    def finish(self) -> tuple[bytes, bytes, list[int]]:
        """All that is left is a path of the last sequence; gives the range's borders."""
        words = [b - a for a, b in zip(self.words, self.words[1:], strict=False)]
        self.close(0, True)
        root = self.stack[0]
        root.leaves = root.leaves or 1
        key = prefix_keys(b"", 0, 0)[0]
        self.rows.append((root.conv, 0, None, root.n, root.children, root.leaves, root.below, root.distinct, root.sha, key, None))
        return self.first or b"", self.seq, words


@tidied
def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each range (rows come sorted by range, then sequence); the borders have no depth."""
    names = [x.split(" ")[0] for x in f"{NODE}, {EDGE}".split(", ")]
    types = _NODE_TYPES + _EDGE_TYPES

    def out(rows: list[tuple], part: int, edge: tuple | None = None) -> pa.RecordBatch:
        table = [(*r, part, None, None, None) for r in rows] + ([(None,) * len(_NODE_TYPES) + (part, *edge)] if edge else [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table, strict=True), types, strict=True)], names)

    def drain(trie: Range, part: int) -> Iterator[pa.RecordBatch]:
        while len(trie.rows) >= ROWS:
            yield out(trie.rows[:ROWS], part)
            del trie.rows[:ROWS]

    trie, now = None, None
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "words", "conv_id", "n", "sha")), strict=True):
            if part != now and trie:
                edge = trie.finish()
                yield from drain(trie, now)
                yield out(trie.rows, now, edge)
            if part != now:
                trie, now = Range(), part
            trie.add(*row)
        if trie:
            yield from drain(trie, now)
    if trie:
        edge = trie.finish()
        yield from drain(trie, now)
        yield out(trie.rows, now, edge)


@tidied
def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What both sides of a border counted, as parts of nodes with negative numbers."""
    names = [x.split(" ")[0] for x in NODE.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for before, words, after in zip(*(batch.column(c).to_pylist() for c in ("before", "before_words", "first_seq")), strict=True):
            shared = common_turns(before, after)
            sums, keys = word_sums(words), prefix_keys(before, 0, shared)
            leaf = -1 if len(before) == shared * DIGEST else 0  # it goes on behind the border
            for d in range(shared + 1):
                rows.append((None, d, None, 0, -1 if d < shared else 0, leaf, 0, sums[max(d - 1, 0)] - sums[shared], None, keys[d], None))
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES, strict=True)], names)


@tidied
def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of sorted ids with one key; rows come sorted."""
    names, types = ["key", "part", "at", "ids"], [pa.binary(), pa.int32(), pa.int64(), pa.string()]
    held: list[str] = []
    now, of, at = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, of, at, ",".join(held)), types, strict=True)], names)

    for batch in batches:
        for key, part, conv in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "conv_id")), strict=True):
            if held and (key != now or len(held) >= IDS):
                yield out()
                at, held = at + 1, []
            now, of = key, part
            held.append(str(conv))
    if held:
        yield out()


@tidied
def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over the strings of a key, which come in order."""
    now, h = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["key", "sha"])

    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if h:
                    yield out()
                now, h = key, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
    if h:
        yield out()


def _ends(members: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Key and hash of the ids of each group of more than one member."""
    several = groups.where("n > 1").select("key", "n")
    rows = hot_join(members.select("key", "conv_id"), several, ["key"], "n", total).select("key", "conv_id")
    n = max(partitions(members.sparkSession), -(-total // 200_000))
    sorted_ids = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    strings = sorted_ids.mapInArrow(_joined_ids, "key binary, part int, at long, ids string")
    return strings.repartition("key").sortWithinPartitions("key", "part", "at").mapInArrow(_hashed_ids, "key binary, sha string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row per node of conversations (conv_id, turns as of ``sequences``).

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = convs.sparkSession
    lean(spark)
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    words = F.transform("turns", lambda t: t["words"].cast("int"))
    members = scratch(convs.select("conv_id", seq.alias("seq"), words.alias("words")).withColumn("key", F.unhex(F.md5("seq"))), "conversations")
    total = members.count()
    groups = members.groupBy("key", "seq", "words").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    groups = scratch(groups, "distinct", total, PER_FILE)
    ends = scratch(_ends(members, groups, total), "ends", total, PER_FILE)
    release(members)
    named = groups.join(ends, "key", "left").withColumn("sha", F.coalesce("sha", F.sha2(F.col("conv_id").cast("string"), 256))).drop("key")
    ranges = max(partitions(spark), -(-total // PER_RANGE))
    dealt = named.repartitionByRange(ranges, "seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id())
    built = scratch(dealt.select("part", "seq", "words", "conv_id", "n", "sha").mapInArrow(_build, f"{NODE}, {EDGE}"), "nodes")
    release(groups, ends)
    return _shape(*_across_ranges(built))


def _across_ranges(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes with their parents: those of one range, and those that several may have parts of."""
    columns = [x.split(" ")[0] for x in NODE.split(", ")]
    last = Window.orderBy("part")  # a row per range
    edges = built.where("depth is null").select("part", "first_seq", F.lag("last_seq").over(last).alias("before"), F.lag("last_words").over(last).alias("before_words"))
    twice = edges.where("before is not null").select("before", "before_words", "first_seq").mapInArrow(_borders, NODE)
    parts = built.where("key is not null")
    sums = ["n_convs", "n_children", "n_leaves", "words", "distinct_words"]
    whole = parts.select(*columns).unionByName(twice).groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends_sha256").alias("ends_sha256"), F.max("parent_key").alias("parent_key"))
    whole = scratch(whole, "border-nodes")
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    on_borders = whole.join(parents, "parent_key", "left")
    # a parent by range and key: a node with very many children is spread over the ranges that have them
    near = parts.select("part", F.col("key").alias("parent_key")).join(parents, "parent_key")
    inside = built.where("depth is not null and key is null")
    known = inside.where("parent_key is null")
    found = inside.where("parent_key is not null").drop("parent_conv_id").join(near, ["part", "parent_key"])
    return known.unionByName(found.select(*known.columns)), on_borders


def _shape(inside: DataFrame, on_borders: DataFrame) -> DataFrame:
    def nodes(df: DataFrame) -> DataFrame:
        saved: Column = F.col("words") - F.col("distinct_words")
        return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"))

    return nodes(inside).unionByName(nodes(on_borders))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose heads are shared within groups of 20 ids."""
    return prefix_trie(share_heads(sequences(conversations)))
