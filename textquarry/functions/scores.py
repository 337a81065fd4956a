"""Overlap scores of generated and reference texts: ROUGE and corpus chrF."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[a-z0-9]+")
ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def _f1(hits: int, guess: int, truth: int) -> float:
    return 2 * hits / (guess + truth) if hits else 0.0


def _places(words: list[str]) -> dict[str, int]:
    """For each word the bits of its places."""
    out: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(w, []).append(k)
    size = len(words) // 8 + 1
    bits: dict[str, int] = {}
    for w, at in out.items():
        mask = bytearray(size)
        for k in at:
            mask[k >> 3] |= 1 << (k & 7)
        bits[w] = int.from_bytes(mask, "little")
    return bits


def _rows(a: list[str], places: dict[str, int], size: int, row: int = 0) -> Iterator[int]:
    """Bit-parallel rows: after each word of ``a`` the places of ``b`` at which its beginnings' common subsequence grows.

    ``places`` are those of the ``size`` words of ``b``; ``row`` is the row to go on from.
    """
    full = (1 << size) - 1
    free = full ^ row
    for w in a:
        hit = free & places.get(w, 0)
        free = ((free + hit) | (free - hit)) & full
        yield full ^ free


def _common(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence; only one row of bits is in memory."""
    row = 0
    for row in _rows(a, _places(b), len(b)):  # noqa: B007
        pass
    return row.bit_count()


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence.

    A walk from the front moves on in ``a`` unless that loses a match.  It
    needs the rows of the ends of ``a``, which are bits; every ``step``-th is
    kept and those between are found again when the walk gets there.
    """
    n, m = len(a), len(b)
    back, places, step = a[::-1], _places(b[::-1]), max(1, math.isqrt(len(a)))
    kept = {0: 0}
    for i, row in enumerate(_rows(back, places, m), 1):  # of the last i words of a
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def row_of(i: int) -> int:
        """The row of a[i:], bit k for the k-th place from the end of b."""
        left = n - i
        if left not in rows:
            base = max(left - 1, 0) // step * step
            rows.clear()
            rows[base] = kept[base]
            for k, row in enumerate(_rows(back[base : min(base + step, n)], places, m, kept[base]), base + 1):
                rows[k] = row
        return rows[left]

    def reach(row: int, j: int) -> int:
        """Length of the common subsequence with b[j:]."""
        return (row & ((1 << (m - j)) - 1)).bit_count()

    out: list[tuple[int, int]] = []
    i = j = 0
    if not n or not m:
        return out
    here = row_of(0)
    length = here.bit_count()
    while i < n and j < m and length:
        if a[i] == b[j]:
            out.append((i, j))
            i, j, length = i + 1, j + 1, length - 1
            here = row_of(i) if i < n else 0
        elif (here >> (m - 1 - j)) & 1 or reach(below := row_of(i + 1) if i + 1 < n else 0, j) == length:
            i += 1  # without a[i] no match is lost
            here = row_of(i) if i < n else 0
        else:
            j += 1
    return out


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[k:] for k in range(n)), strict=False))


def _overlap(guess: list[str], truth: list[str], n: int) -> float:
    g, t = _grams(guess, n), _grams(truth, n)
    return _f1((g & t).total(), g.total(), t.total())


def _summary_level(guess: str, truth: str) -> float:
    """Union of the matches of each reference line with all guessed lines."""
    g = [_TOKEN.findall(x.lower()) for x in guess.split("\n")]
    t = [_TOKEN.findall(x.lower()) for x in truth.split("\n")]
    left_g, left_t = Counter(w for x in g for w in x), Counter(w for x in t for w in x)
    total_g, total_t = left_g.total(), left_t.total()
    hits = 0
    for line in t:
        union = sorted({i for x in g for i, _ in _matches(line, x)})
        for i in union:
            w = line[i]
            if left_g[w] > 0 and left_t[w] > 0:
                left_g[w] -= 1
                left_t[w] -= 1
                hits += 1
    return _f1(hits, total_g, total_t)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ROUGE]))
def rouge(guess: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """F-measures of one pair; a null counts as an empty text."""
    rows = []
    for a, b in zip(guess.fillna(""), truth.fillna(""), strict=True):
        x, y = _TOKEN.findall(a.lower()), _TOKEN.findall(b.lower())
        rows.append((_overlap(x, y, 1), _overlap(x, y, 2), _f1(_common(x, y), len(x), len(y)), _summary_level(a, b)))
    return pd.DataFrame(rows, columns=list(ROUGE))


def rouge_means(pairs: DataFrame, guess: str, truth: str) -> DataFrame:
    got = pairs.select(rouge(guess, truth).alias("r"))
    return got.agg(*[F.avg(f"r.{n}").alias(n) for n in ROUGE])


ORDER = 6


@F.pandas_udf(T.ArrayType(T.LongType()))
def gram_counts(guess: pd.Series, truth: pd.Series) -> pd.Series:
    """For each order up to 6 the guessed, the true and the common character n-grams of a pair."""

    def counts(text: object, n: int) -> Counter:
        bare = "".join(text.split()) if isinstance(text, str) else ""
        return Counter(bare[k : k + n] for k in range(len(bare) - n + 1))

    def pair(a: object, b: object) -> list[int]:
        both = [(counts(a, n), counts(b, n)) for n in range(1, ORDER + 1)]
        return [x for g, t in both for x in (g.total(), t.total(), (g & t).total())]

    return pd.Series([pair(a, b) for a, b in zip(guess, truth, strict=True)])


def chrf(pairs: DataFrame, guess: str, truth: str, beta: float = 2.0) -> DataFrame:
    """One row, ``chrf`` from 0 to 100, over the whole corpus.

    Counts are taken per pair and summed over all pairs; only then precision
    and recall of each order are averaged and joined to the F-score.  No
    n-gram is shuffled, only sums.
    """
    counted = pairs.select(gram_counts(guess, truth).alias("c"))
    sums = counted.agg(*[F.sum(F.col("c")[k]).alias(f"s{k}") for k in range(3 * ORDER)])
    orders = F.array(*[F.struct(F.col(f"s{3 * n}").alias("g"), F.col(f"s{3 * n + 1}").alias("t"), F.col(f"s{3 * n + 2}").alias("m")) for n in range(ORDER)])
    per = sums.select(F.explode(orders).alias("o")).select("o.*").where("g > 0 and t > 0")
    mean = per.agg(F.avg(F.col("m") / F.col("g")).alias("p"), F.avg(F.col("m") / F.col("t")).alias("r"))
    b = beta * beta
    f = F.when(b * F.col("p") + F.col("r") > 0, 100 * (1 + b) * F.col("p") * F.col("r") / (b * F.col("p") + F.col("r")))
    return mean.select(F.coalesce(f, F.lit(0.0)).alias("chrf"))
