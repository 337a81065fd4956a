"""Sum-of-squares packing of token documents into sequences of fixed length.

Every document becomes its whole windows (sequences of their own) and a
remainder.  Remainders are placed online, in the order of arrival: of all fill
levels that leave room, and an empty window, the one is chosen that makes the
sum of the squared numbers of partly filled windows per level least.  The
numbers are held in an array by level.  When a task's documents are placed,
its partly filled windows are cut and poured together, which the contract
allows, so that at most one of them per task stays partly filled.

Tasks are independent; a sequence's number is its task's offset plus its rank
there.  A null text is an empty one: one piece with the end id alone.  Rows
with the same doc_id are documents of their own; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, scratch, tidied
from .tokens import Encoder, default_vocabulary, slices

Piece = tuple[int, int, int]  # document, start, length


class Levels:
    """Partly filled windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece in a window; the window, if it is full then.

        Moving a window from level h to h + s changes the sum of squares by
        2 * (count[h + s] - count[h] + 1) with h empty counted as 0 - and
        filling one up takes 2 * count[h] - 1 off it.
        """
        s, w = piece[2], self.window
        if s == w:
            return [piece]
        change = np.empty(w - s + 1, np.int64)
        change[1:-1] = 2 * (self.count[s + 1 : w] - self.count[1 : w - s] + 1)
        change[0] = 2 * self.count[s] + 1
        change[-1] = 1 - 2 * self.count[w - s]
        free = self.count[: w - s + 1] > 0
        free[0] = True
        change[~free] = np.iinfo(np.int64).max
        h = int(change[::-1].argmin())
        h = w - s - h  # of equal levels the fullest
        bin_ = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        bin_.append(piece)
        if h + s == w:
            return bin_
        self.open[h + s].append(bin_)
        self.count[h + s] += 1
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """The partly filled windows, cut and poured together; the last may stay partly filled."""
        now: list[Piece] = []
        used = 0
        for level in range(self.window - 1, 0, -1):
            for bin_ in self.open[level]:
                for doc, start, length in bin_:
                    while length:
                        take = min(length, self.window - used)
                        now.append((doc, start, take))
                        start, length, used = start + take, length - take, used + take
                        if used == self.window:
                            yield now
                            now, used = [], 0
        if now:
            yield now


def pack_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    lean(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, __task long, __rank long, offset long"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = Encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        levels, rank, seen = Levels(window), 0, 0
        held: dict[int, tuple[int, bytes, int, int]] = {}  # document: id, ids of its remainder, their start, tokens
        columns: list[list[int]] = [[] for _ in range(8)]

        def put(pieces: list[Piece]) -> None:
            nonlocal rank
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids, at, total = held[doc]
                crc = zlib.crc32(ids[4 * (start - at) : 4 * (start - at + length)])
                for c, v in zip(columns, (doc_id, start, length, crc, total, task, rank, offset), strict=True):
                    c.append(v)
                offset += length
                if start + length == total:
                    done.append(doc)
            rank += 1

        def flush() -> pa.RecordBatch:
            nonlocal columns
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__task", "__rank", "offset"])
            columns = [[] for _ in range(8)]
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                done: list[int] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids = ids.tobytes() + end
                    total, seen = len(ids) // 4, seen + 1
                    held[seen] = (doc_id, ids, 0, total)
                    whole = total // window * window
                    for start in range(0, whole, window):
                        put([(seen, start, window)])
                    if whole < total:
                        held[seen] = (doc_id, ids[4 * whole :], whole, total)
                        if full := levels.place((seen, whole, total - whole)):
                            put(full)
                for doc in done:
                    held.pop(doc, None)
                if columns[0]:
                    yield flush()
        done = []
        for pieces in levels.rest():
            put(pieces)
        if columns[0]:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = scratch(texts.mapInArrow(run, schema), "packed")
    per = placed.groupBy("__task").agg((F.max("__rank") + 1).alias("n"))
    offsets = _offsets(per)
    out = placed.join(bounded(offsets), "__task")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("__rank") + F.col("__first")).alias("sequence_id"), "offset")


def _offsets(per: DataFrame) -> DataFrame:
    """First sequence number of each task; one row per task of the scan."""
    from pyspark.sql.window import Window

    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
