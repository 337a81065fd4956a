"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  One binary classifier per bit, a
logistic regression on hashed letter trigrams, predicts that bit; the decoder
adds the logistic loss of all bits for every codeword and takes the language
of the least loss.  ``ambiguous`` flags texts whose two best losses are close.

The models are fitted on a bounded sample: ``SAMPLE`` labelled training texts
in all, shared evenly by the languages but at least ``LEAST`` each, the
distinct texts with the smallest hashes of their language.  A hot text is
drawn once at most, every language is learned however few or long its texts
are, and what reaches the driver is one vector of ``FEATURES`` numbers a text.
Prediction reads whole texts; language, source and id are no inputs of it.

Defined results: a null text, and a text without any letter, is ``und`` with
score 0; without training labels every text is ``und``; with one label only,
every text with a letter gets it with score 1; a null doc_id is not held out;
equal rows are kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import lean, tidy

SAMPLE, LEAST, FEATURES = 3000, 50, 4096
#: Rows that are worked on at a time.
ROWS = 256
#: Difference of the mean losses under which a decision is ambiguous.
MARGIN = 0.1
UNDETERMINED = "und"
#: Everything but letters becomes a space; bytes from 0x80 belong to letters.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed trigrams, scaled to length 1."""
    b = np.frombuffer(b" ".join([b"", *text.lower().encode().translate(_LETTERS).split(), b""]), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(FEATURES, np.float32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = np.sqrt(np.bincount(h >> np.uint32(20), minlength=FEATURES)).astype(np.float32)
    return x / np.linalg.norm(x)


def codewords(n: int) -> np.ndarray:
    """Codewords (+1, -1) of n languages: all splits for up to 5, else the best of random codes."""
    if n <= 5:
        columns = [[1 if (m >> k) & 1 else -1 for k in range(n - 1)] + [1] for m in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.float32).T.reshape(n, -1)
    rng = np.random.default_rng(n)
    bits = int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        d = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if d > distance and (np.abs(code.sum(0)) < n).all():
            best, distance = code, d
    return best


class CodeModel:
    def __init__(self, x: np.ndarray, langs: list[str], rounds: int = 150, rate: float = 8.0, decay: float = 1e-4):
        """``x`` has the features of one text a row."""
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs)) if len(self.langs) > 1 else np.zeros((len(self.langs), 0), np.float32)
        y = self.code[[self.langs.index(k) for k in langs]] if langs else np.zeros((0, 0), np.float32)
        self.bias = np.zeros(self.code.shape[1], np.float32)
        self.weights = np.zeros((FEATURES, self.code.shape[1]), np.float32)
        speed = np.zeros_like(self.weights)
        for _ in range(rounds if self.code.shape[1] else 0):
            grad = -y / (1 + np.exp(y * (x @ self.weights + self.bias))) / len(x)
            speed = 0.9 * speed - rate * (x.T @ grad + decay * self.weights)
            self.weights += speed
            self.bias -= rate * grad.sum(0)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (number), its score and whether it is ambiguous, for each row."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(2)
        order = np.argsort(loss, axis=1)
        p = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        two = np.take_along_axis(loss, order[:, :2], 1)
        return order[:, 0], p.max(1) / p.sum(1), two[:, 1] - two[:, 0] < MARGIN


@F.arrow_udf(T.BinaryType())
def _vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Features of each text in half precision; null for a text without a letter."""
    for texts in batches:
        yield pa.array([features(t).astype(np.float16).tobytes() if has_letter(t) else None for t in texts.to_pylist()], pa.binary())


def fit(labelled: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> CodeModel:
    """A model from columns text and lang; reads all rows and learns from the sample.

    Of each language the texts are taken whose hash is under a bound that lets
    twice its share pass, so only these are brought together.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", "lang").bitwiseAND((1 << 62) - 1).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    if not sizes:
        return CodeModel(np.zeros((0, FEATURES), np.float32), [])
    share = max(least, sample // len(sizes))
    bound = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, (2 * share + 20) / max(n, 1)) * (1 << 62)))])
    drawn = rows.where(F.col("h") <= bound[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    got = drawn.select("lang", "h", _vectors("text").alias("x")).where("x is not null")
    rank = Window.partitionBy("lang").orderBy("h")
    kept = got.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= share).collect()  # at most ``share`` rows a language
    kept.sort(key=lambda r: (r["lang"], r["h"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in kept], np.float32).reshape(len(kept), FEATURES)
    return CodeModel(x, [r["lang"] for r in kept])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predictor(model: CodeModel):
    """A column function of the text: struct of lang, score and ambiguous."""

    def some(texts: list[str | None]) -> pa.StructArray:
        langs, scores, flags = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        at = [k for k, t in enumerate(texts) if has_letter(t)] if model.langs else []
        if at:
            best, score, unsure = model.decode(np.array([features(texts[k]) for k in at]))
            scores[at], flags[at] = score, unsure
            for k, b in zip(at, best.tolist(), strict=True):
                langs[k] = model.langs[b]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(flags)], ["lang", "score", "ambiguous"])

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.concat_arrays([some(texts[lo : lo + ROWS].to_pylist()) for lo in range(0, max(len(texts), 1), ROWS)])
        finally:
            tidy()

    return predict


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score, ambiguous; fitted on rows that are not held out."""
    lean(docs.sparkSession)
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    found = docs.select("doc_id", predictor(model)("text").alias("__p"))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score"), F.col("__p.ambiguous").alias("ambiguous"))
