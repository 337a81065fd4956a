"""Quality rules: fixed counts per text, and distribution divergence.

The divergence rule compares two histograms of a document with the references
of a language: character classes and common words.  The distance is that of
Jensen and Shannon (square root of the divergence, base 2, so 0 to 1).  Of all
references the one with the least sum of both distances is taken, and a
document fails when either distance to it is over its limit; a histogram with
fewer characters or words than its guard says nothing, so short texts pass.

References are sums over all documents that pass the fixed counts, by
``lang``, for each language that has at least one row in ``LANGUAGES``, so
there are no more than that many, and ``LEAST`` rows, for fewer texts say
nothing of a language.  The common words are those that most
documents of a language hold, ``COMMON`` for each.  A document of another
language, or of none, is compared like all others with the nearest reference;
only the guards keep a document from having a verdict.

Defined results: a null or blank text has no words and fails the base rule;
texts of any length are read whole; equal rows, and rows without a doc_id, are
kept apart and judged alike; an empty table gives an empty result; other
columns pass through ``filter_documents`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOCS_PER_TASK, compact, lean, tidied, tidy

#: Common words of a language and their most bytes; rows of which a language needs one, and rows it needs at least, to have a reference.
COMMON, WORD_BYTES, LANGUAGES, LEAST = 32, 64, 200, 20
#: Bytes of each character class; what is in none is "other ASCII", bytes from 0x80 up are letters of other alphabets.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:!?", "quote": b"'\"()-"}
#: Guards (characters, words), and the limit of each distance: a floor plus the noise of n counts, c / sqrt(n).
MIN_CHARS, MIN_WORDS = 200, 40
CHARS_LIMIT, WORDS_LIMIT = (0.13, 3.2), (0.17, 2.0)
SYMBOLS = b"#*$%&|<>"
#: Rows that are worked on at a time.
ROWS = 500

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v)] = _k
_CLASS[0x80:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
PUNCTUATION = ".,;:!?\"()|#*$%&<>"
_PUNCT = bytes.maketrans(PUNCTUATION.encode(), b" " * len(PUNCTUATION))
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = ids[:n].copy()
    for k in range(1, window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        h ^= h >> np.uint64(32)
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    hit = np.isin(h, again)
    cover = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = (text or "").encode()
    words = data.split()
    chars = len(text or "") - (len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def histograms(text: str | None, at: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by character class, and of the common words, whose places are ``at``, with all others last."""
    data = (text or "").encode()
    classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=N_CLASSES)
    words = data.lower().translate(_PUNCT).split()
    got = list(map(at.get, words))
    known = np.fromiter((k for k in got if k is not None), np.int64)
    counts = np.bincount(known, minlength=len(at) + 1)
    counts[-1] = len(words) - len(known)
    return classes, counts


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``p`` (n, k) to the rows of ``q`` (m, k), as (n, m)."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1)

    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(-1)

    own = entropy(p)
    out = [entropy((p + one) / 2) - (own + entropy(one)) / 2 for one in q]  # one at a time, for there may be many
    return np.sqrt(np.maximum(np.array(out).reshape(len(q), len(p)).T, 0))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def languages(docs: DataFrame, least: int = LEAST) -> list[str]:
    """Languages with a row in ``LANGUAGES`` or more, and ``least`` rows."""
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row a language
    some = counts.withColumn("total", total).where(f"lang is not null and n >= {least} and n * {LANGUAGES} >= total")
    return sorted(r["lang"] for r in some.select("lang").collect())  # at most LANGUAGES


def common_words(docs: DataFrame, langs: list[str], each: int = COMMON) -> list[str]:
    """Words that most documents of a language hold, of all languages together."""
    plain = F.translate(F.col("text"), _CAPITALS + PUNCTUATION, _SMALL + " " * len(PUNCTUATION))
    words = docs.where(F.col("lang").isin(langs)).select("lang", F.explode(F.array_distinct(F.split(plain, r"[\x20\x09-\x0D]+"))).alias("word"))
    counts = words.where(F.octet_length("word").between(1, WORD_BYTES)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("r", rank).where(F.col("r") <= each).select("word").distinct()
    return sorted(r["word"] for r in top.collect())  # at most LANGUAGES * each


class References:
    """Common words, and of each language the sums of both histograms."""

    def __init__(self, words: list[str], sums: dict[str, np.ndarray]):
        self.words, self.langs = words, sorted(sums)
        self.chars = np.array([sums[k][:N_CLASSES] for k in self.langs]).reshape(len(sums), N_CLASSES)
        self.word_sums = np.array([sums[k][N_CLASSES:] for k in self.langs]).reshape(len(sums), len(words) + 1)


def references(docs: DataFrame) -> References:
    """Reference histograms by language, summed over all documents."""
    lean(docs.sparkSession)
    langs = languages(docs)
    words = common_words(docs, langs) if langs else []
    size = N_CLASSES + len(words) + 1

    @tidied
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        at = {w.encode(): k for k, w in enumerate(words)}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = (text or "").encode().split()
                    if not base_failed(len(own), repeated_words(own)):
                        sums[lang] = sums.get(lang, 0) + np.concatenate(histograms(text, at))
        names = [k for k in sums for _ in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(range(size)) * len(sums), pa.int32()), pa.array(np.concatenate([*sums.values(), np.zeros(0)]).astype(np.int64))], ["lang", "k", "n"])

    known = docs.select("text", "lang").where(F.col("lang").isin(langs))
    rows = known.mapInArrow(partial, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).collect() if langs else []  # languages x size
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(size))[r["k"]] = r["n"]
    return References(words, out)


def beyond(distance: np.ndarray, n: np.ndarray, least: int, limit: tuple[float, float]) -> np.ndarray:
    """Whether a histogram of ``n`` counts, no fewer than ``least``, is too far away."""
    return (n >= least) & (distance > limit[0] + limit[1] / np.sqrt(np.maximum(n, 1)))


SCHEMA = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,chars_js:double,words_js:double>"


def judge(refs: References, chars_limit: tuple[float, float] = CHARS_LIMIT, words_limit: tuple[float, float] = WORDS_LIMIT) -> Callable:
    """A column function of the text: all counts, the distances (null without any reference) and the verdict."""

    def some(texts: list[str | None], at: dict[bytes, int]) -> pa.StructArray:
        n = len(texts)
        base = np.array([base_counts(t) for t in texts], np.int64).reshape(n, 5)
        both = [histograms(t, at) for t in texts]
        classes, words = np.array([c for c, _ in both]).reshape(n, N_CLASSES), np.array([w for _, w in both]).reshape(n, len(at) + 1)
        failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
        chars_js, words_js = np.zeros(n), np.zeros(n)
        if refs.langs:
            by_chars, by_words = jensen_shannon(classes, refs.chars), jensen_shannon(words, refs.word_sums)
            nearest = (by_chars + by_words).argmin(1)
            chars_js, words_js = by_chars[np.arange(n), nearest], by_words[np.arange(n), nearest]
        far = beyond(chars_js, classes.sum(1), MIN_CHARS, chars_limit) | beyond(words_js, words.sum(1), MIN_WORDS, words_limit)
        none = np.full(n, not refs.langs)
        columns = [*(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & ~far), pa.array(chars_js, mask=none), pa.array(words_js, mask=none)]
        return pa.StructArray.from_arrays(columns, [*COUNTS, "base_failed", "kept", "chars_js", "words_js"])

    @F.arrow_udf(SCHEMA)
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at = {w.encode(): k for k, w in enumerate(refs.words)}
        try:
            for texts in batches:
                yield pa.concat_arrays([some(texts[lo : lo + ROWS].to_pylist(), at) for lo in range(0, max(len(texts), 1), ROWS)])
        finally:
            tidy()

    return verdict


def quality_report(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_js, words_js."""
    verdict = judge(references(docs))
    return docs.select("doc_id", verdict("text").alias("__v")).select("doc_id", "__v.*")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    verdict = judge(references(docs))
    rows = compact(docs, docs.count(), DOCS_PER_TASK).select(F.struct(*docs.columns).alias("row"))
    return rows.where(verdict(F.col("row.text"))["kept"]).select("row.*")
