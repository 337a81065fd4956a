"""Token ids of whole texts, and a fixed-width bit-packed file format for them.

Encoding.  A pre-token of a byte-level BPE surely starts at some places (white
space, letters next to digits or signs).  ``Encoder`` cuts the texts there with
numpy, has Arrow number the distinct parts, encodes each of those once with the
tokenizers library and gathers the ids; the result is the same as encoding the
whole text.  A worker keeps the library's tokenizer; the cache lives as long as
its task and holds two generations of ``CACHE_PARTS`` parts, so its memory is
bounded.

File format.  One image per run of documents, little-endian:

====================  ====================================================
8 bytes               magic ``TQTOKEN1``
5 x uint64            bits per id, ids per block, documents, ids, blocks
documents x int64     document ids, ascending (0 for a null id)
documents bytes       1 for a null id, else 0
(documents+1) uint64  first id of each document, then the number of ids
blocks x uint64       byte offset of each block from the start of the image
blocks                ids, most significant bit first, ``bits`` bits each,
                      every block padded to whole bytes
====================  ====================================================

``bits`` is the least width that holds the vocabulary.  Blocks start on bytes,
so any range of ids is read by unpacking its own blocks only (``read_ids``).
An image is one value of a binary column; Spark's writer puts it in the shared
folder, so commits are atomic and any file system works.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, running_total, scratch, tidied

VOCABULARY = "byte_bpe_50k.json"
#: Parts (of about 200 bytes each) in one of the two generations of the encoder's cache.
CACHE_PARTS = 120_000
#: Parts that the library gets end to end.
JOINED = 64
#: Text bytes from which an image is closed, and ids in one block.
IMAGE_BYTES, BLOCK_IDS = 4_000_000, 4096
#: Text bytes that are encoded at a time.
SLICE_BYTES = 4_000_000
MAGIC = b"TQTOKEN1"


def _byte_classes() -> np.ndarray:
    """Class of each ASCII byte: white space, letter, digit or other; bytes from 0x80 are unknown at first."""
    c = np.full(256, UNKNOWN, np.uint8)
    c[:128] = OTHER
    c[[9, 10, 11, 12, 13, 32]] = WHITE
    c[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    c[0x30:0x3A] = DIGIT
    return c


UNKNOWN, WHITE, LETTER, DIGIT, OTHER = range(5)
_CLASS = _byte_classes()
#: Bytes after a space that surely open no white space: ASCII signs, and the letters of U+00C0 to U+00FF.
_SIGNS = frozenset([*(k for k in range(128) if _CLASS[k] != WHITE), 0xC3])
#: UTF-8 of the white space outside ASCII.
_WIDE_WHITE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def pretoken_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted byte places where a pre-token surely starts; ``starts`` are those of the texts in ``data``.

    Pre-tokens of a byte-level BPE begin at a run of white space, at the last
    character of such a run if something follows it in the text, after that
    character unless it is a space, and wherever letters, digits and other
    signs meet, but not behind an apostrophe, which may open a contraction.
    Characters outside ASCII are unknown, and nothing is cut next to them,
    but for white space and the letters of U+00C0 to U+00FF.
    """
    n = len(data)
    cls = _CLASS[data]
    follows = np.zeros(n + 1, bool)  # bytes that continue a character
    follows[:n] = (data & 0xC0) == 0x80
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    cls[lead] = LETTER
    cls[lead + 1] = LETTER
    for first in {w[0] for w in _WIDE_WHITE}:
        at = np.flatnonzero(data == first)
        if len(at):
            for w in (w for w in _WIDE_WHITE if w[0] == first):
                fits = at[at + len(w) <= n]
                for k in range(1, len(w)):
                    fits = fits[data[fits + k] == w[k]]
                for k in range(len(w)):
                    cls[fits + k] = WHITE
    cut = np.zeros(n + 1, bool)
    before, now = cls[:-1], cls[1:]
    cut[1:n] = (before != now) & (before != UNKNOWN) & (now != UNKNOWN) & (data[:-1] != 0x27)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    # white space: a run starts, and its last character if the text goes on
    white = np.append(cls == WHITE, False)
    cut[1:n] &= ~white[1:n] & ~white[: n - 1]
    opens = white[:n].copy()
    opens[1:] &= ~white[: n - 1] | first[1:n]
    last = np.flatnonzero(white[:n] & ~white[1:] & ~first[1:])
    last = last[last + 1 < n]
    begin = last.copy()  # where the last character begins
    while True:
        inside = follows[begin]
        if not inside.any():
            break
        begin -= inside
    cut[:n] |= opens
    cut[begin] = True
    cut[last[data[last] != 0x20] + 1] = True
    cut[starts] = True
    cut[n] = False
    return np.flatnonzero(cut)


@lru_cache(maxsize=8)
def _build(path: str) -> tuple[bool, tuple[bytes, ...]]:
    """Whether a vocabulary file is a plain byte-level BPE, and the strings of its added tokens."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, pre = made["model"], made.get("pre_tokenizer") or {}
    others = [made.get("normalizer"), made.get("truncation"), made.get("padding"), model.get("dropout")]
    whole = sum(len(t) == 1 for t in model["vocab"]) >= 256 if isinstance(model.get("vocab"), dict) else False
    plain = model.get("type") == "BPE" and whole and not any(others) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain, tuple(t["content"].encode() for t in made.get("added_tokens", ()))


@lru_cache(maxsize=1)
def _loaded(path: str) -> tuple[Any, int, np.ndarray]:
    """The library's tokenizer, which a worker keeps, its size, and the bytes of each id where a character stands for a byte."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    widths = np.zeros(size, np.int64)
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        widths[k] = len(token)
    return tokenizer, size, widths


class Encoder:
    """Encodes texts with one vocabulary file; equal to the library's ``encode`` without special tokens added.

    For a byte-level BPE the texts are cut where a pre-token surely starts
    (``pretoken_cuts``).  Each distinct part goes through the library once per
    slice, or is taken from a cache, and the ids are gathered with numpy.
    Texts that hold the string of an added token, and all texts of a
    vocabulary of another build, go through the library as they are.
    """

    def __init__(self, path: str):
        self.tokenizer, self.size, self.widths = _loaded(path)
        self.cuts, self.added = _build(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _joined(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that can stand end to end: each starts with a space and a sign."""
        runs = [b"".join(parts[k : k + JOINED]).decode() for k in range(0, len(parts), JOINED)]
        ids = np.frombuffer(b"".join(self._library(runs)), "<u4")
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))) + 1
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        young, old = self.young, self.old
        missing = [p for p in parts if p not in young]
        if old:
            young.update({p: old[p] for p in missing if p in old})
            missing = [p for p in missing if p not in old]
        single = [p for p in missing if len(p) < 2 or p[0] != 0x20 or p[1] not in _SIGNS]
        missing = [p for p in missing if len(p) > 1 and p[0] == 0x20 and p[1] in _SIGNS]
        for lo in range(0, len(missing), 20_000):
            some = missing[lo : lo + 20_000]
            young.update(zip(some, self._joined(some), strict=True))
        young.update(zip(single, self._library([p.decode() for p in single]), strict=True))
        out = list(map(young.__getitem__, parts))
        if len(young) > CACHE_PARTS:
            self.old, self.young = young, {}
        return out

    def _cut(self, data: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that stand end to end, and the number of ids of each."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        places = pretoken_cuts(np.frombuffer(data, np.uint8), starts)
        offsets = np.append(places, len(data)).astype(np.int32)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which = parts.indices.to_numpy(zero_copy_only=True)
        found = self._parts(parts.dictionary.to_pylist())
        per = np.fromiter(map(len, found), np.int32, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(per) - per
        count = per[which]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = flat[np.repeat(first[which] - total[:-1], count) + np.arange(total[-1])]
        edge = total[np.searchsorted(places, np.append(starts, len(data)))]
        return ids, np.diff(edge)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held: list[bytes] = []
        owner: list[int] = []
        got: list[list[np.ndarray]] = [[] for _ in texts]
        size = 0

        def flush() -> None:
            nonlocal held, owner, size
            if held:
                ids, counts = self._cut(b"".join(held), list(map(len, held)))
                end = np.cumsum(counts)
                for k, a, b in zip(owner, (end - counts).tolist(), end.tolist(), strict=True):
                    got[k].append(ids[a:b])
            held, owner, size = [], [], 0

        whole = []
        for k, t in enumerate(texts):
            data = t.encode()
            if not data:
                out[k] = np.zeros(0, "<u4")
            elif not self.cuts or any(a in data for a in self.added):
                whole.append(k)
            else:
                for part in chunks(data):
                    held.append(part)
                    owner.append(k)
                    size += len(part)
                    if size >= SLICE_BYTES:
                        flush()
        flush()
        for k, ids in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = np.frombuffer(ids, "<u4")
        return [x if x is not None else g[0] if len(g) == 1 else np.concatenate(g) for x, g in zip(out, got, strict=True)]


_SAFE = re.compile(rb"[!-~] (?=[!-~])")


def chunks(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """Parts of a text that encode on their own: each starts at a space between two signs."""
    size = size or SLICE_BYTES
    at = 0
    while len(data) - at > 2 * size:
        m = _SAFE.search(data, at + size)
        if not m:
            break
        yield data[at : m.start() + 1]
        at = m.start() + 1
    yield data[at:]


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bits of the ids one after another, padded to whole bytes."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype("<u4")
    got = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return (got.astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(1, dtype=np.uint32)


def image(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype("<u8")
    parts = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    head = 8 + 5 * 8 + 9 * len(doc_ids) + 8 * len(starts) + 8 * len(parts)
    offsets = head + np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])[:-1] if parts else np.zeros(0)
    sizes = np.array([bits, block, len(doc_ids), len(flat), len(parts)], "<u8")
    known = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join([MAGIC, sizes.tobytes(), known, starts.tobytes(), np.asarray(offsets).astype("<u8").tobytes(), *parts])


class Image:
    """Random access to the ids of one image."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token image")
        self.data = data
        self.bits, self.block, docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
        self.doc_ids = pa.array(np.frombuffer(data, "<i8", docs, 48), mask=np.frombuffer(data, np.uint8, docs, 48 + 8 * docs) == 1)
        self.starts = np.frombuffer(data, "<u8", docs + 1, 48 + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks, 48 + 17 * docs + 8).astype(np.int64)

    def read_ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            at = int(self.offsets[b])
            parts.append(unpack(self.data[at : at + (n * self.bits + 7) // 8], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read_ids(int(self.starts[k]), int(self.starts[k + 1]))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of the column, or one row, each."""
    lo = 0
    while lo < batch.num_rows:
        n = batch.num_rows - lo
        while n > 1 and batch.column(column).slice(lo, n).nbytes > size:
            n = -(-n // 2)
        yield batch.slice(lo, n)
        lo += n


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def write_images(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """The written files: (__block, image_no, n_ids, image), in ascending doc_id order.

    A null text is an empty one: its ids are the end id alone.  Null ids come
    first.  Rows with one doc_id follow each other in the order of a hash of
    their texts; equal rows are dealt by their place in the input as well, so
    no doc_id needs one task.  No rows give no images; other columns are
    ignored.
    """
    lean(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "__h", "__at"]
    placed = texts.withColumns({"__h": F.xxhash64("text"), "__at": F.monotonically_increasing_id()})
    ranged = placed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("__block"))

    @tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        bits = bits_for(encoder.size)
        end = np.array([end_id], "<u4")
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        used = no = block = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, ids, used, no
            data = image(doc_ids, ids, bits)
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([no], pa.int32()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([data], pa.binary())], ["__block", "image_no", "n_ids", "image"])
            doc_ids, ids, used, no = [], [], 0, no + 1
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                block = part.column(2)[0].as_py()
                got = part.column(1).to_pylist()
                for d, t, e in zip(part.column(0).to_pylist(), got, encoder.encode(got), strict=True):
                    doc_ids.append(d)
                    ids.append(np.concatenate([e, end]))
                    used += len(t)
                    if used >= IMAGE_BYTES:
                        yield close()
        if doc_ids:
            yield close()

    return scratch(ranged.mapInArrow(encode, "__block int, image_no int, n_ids long, image binary"), "token-images")


def token_report(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32, read back from the written images."""
    images = write_images(docs, end_id, vocabulary)
    placed = running_total(images.select("__block", "image_no", "n_ids"), ["image_no"], {"first": "n_ids"}, "__block").drop("n_ids")

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                img = Image(batch.column("image")[k].as_py())
                ids = img.read_ids(0, img.n_ids).tobytes()
                starts = img.starts.tolist()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = len(crc)
                take = pa.array([k] * n, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("__block").take(take), batch.column("image_no").take(take), img.doc_ids, pa.array(starts[:-1], pa.int64()), pa.array(np.diff(img.starts)), pa.array(crc, pa.int64())], ["__block", "image_no", "doc_id", "local", "n_tokens", "ids_crc32"])

    # the places of the images are joined to the documents' rows, so that no image is shuffled
    found = images.select("__block", "image_no", "image").mapInArrow(read, "__block int, image_no int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(placed, ["__block", "image_no"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
