"""Toxicity by non-negative learning from positive and unlabelled texts.

Confirmed toxic texts (P) and texts of any kind (U) train a logistic model;
no text is taken for harmless because nobody marked it.  With the share
``prior`` of toxic texts the risk on harmless ones is what is left of U's when
the toxic part is taken out, ``R_U(-) - prior * R_P(-)``.  It cannot be under 0,
so a step in which it is, which means that the model only learns P by heart,
goes back up that part instead of down the sum.

A text has the features it contains: words in lower case, and beginnings of
``STEM`` bytes of longer words, each known by a 64-bit hash.  The model weighs
``FEATURES`` of them at most, those whose number in P exceeds that in U most
(log-likelihood ratio over ``MARKS``); an L1 penalty leaves most weights at
zero, so the length of a harmless text adds nothing to its score.

The fit is bounded: ``POSITIVE`` confirmed and ``UNLABELLED`` other texts at
most, those with the smallest hashes, and the driver gets one vector of bits a
text.  Scores need no labels, languages, sources or ids.

Defined results: a text without a word, empty or null, has the score of the
intercept alone; without a confirmed toxic text, or without a text that is not
confirmed, every score is the prior (0 without labels); of several labels of a
document the highest counts; a null doc_id is not held out and has no label;
of several texts of one labelled document one is learned; texts of any length
are read whole; equal rows are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, release, scratch, tidy
from .substrings import Hasher

POSITIVE, UNLABELLED, FEATURES = 3000, 6000, 2048
#: Texts that a feature has to be in, and bytes of a word's beginning.
LEAST, STEM = 3, 6
#: Log-likelihood ratio from which a feature may mark toxic texts.
MARKS = 2.0
THRESHOLD = 0.7
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1_000_000
_STEM_SALT = np.uint64(0x5851F42D4C957F2D)
_IN_WORD = np.array([c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A for c in range(256)])


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and lower-cased bytes of texts, some at a time; a long text comes in pieces that end between words."""
    owners: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        data = (text or "").lower().encode()
        at = 0
        while at < len(data):
            end = min(len(data), at + CHUNK_BYTES)
            while at < end < len(data) and _IN_WORD[data[end]]:
                end -= 1
            end = end if end > at else min(len(data), at + CHUNK_BYTES)  # a word longer than a piece
            owners.append(k)
            held.append(data[at:end])
            size += end - at
            at = end
            if size >= CHUNK_BYTES:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a text's number and a feature's hash, in parts; a pair may come again."""
    for owners, held in _pieces(texts):
        data = np.frombuffer(b" ".join(held), np.uint8)
        inside = np.concatenate([[False], _IN_WORD[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])])
        owner = np.array(owners)[np.searchsorted(begins, start, "right") - 1]
        h = Hasher(data)
        long = end - start > STEM
        yield np.concatenate([owner, owner[long]]), np.concatenate([h.of(start, end), h.of(start[long], start[long] + STEM) ^ _STEM_SALT])


class PuModel:
    """A logistic model on features that a text contains."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def contained(self, texts: list[str | None]) -> np.ndarray:
        """Which of the model's features each text has."""
        out = np.zeros((len(texts), len(self.keys)), bool)
        if len(self.keys):
            for owner, h in features(texts):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                out[owner[hit], at[hit]] = True
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.contained(texts) @ self.weights + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def constant(prior: float) -> PuModel:
    """The model that knows no feature."""
    p = min(max(prior, 0.0), 1.0)
    return PuModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))) if 0 < p < 1 else np.inf if p else -np.inf)


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 200, rate: float = 0.1, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk of logistic loss.

    ``p`` and ``u`` have the features of a text a row, as 0 and 1.  The risk is
    that of all texts, since on small batches its corrected part falls under 0
    by chance.  Steps are Adam's; the L1 penalty is a step towards zero after each.
    """
    n, prior = p.shape[1], np.float32(prior)
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float32) for x in (p, u))
    theta, first, second = (np.zeros(n + 1, np.float32) for _ in range(3))
    theta[n] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        gp, gu = sigmoid(p @ theta), sigmoid(u @ theta)
        risk = prior * np.log(np.maximum(1 - gp, 1e-17)).mean() - np.log(np.maximum(1 - gu, 1e-17)).mean()
        harmless = u.T @ gu / len(u) - prior * (p.T @ gp) / len(p)
        toxic = prior * (p.T @ (gp - 1)) / len(p)
        grad = -harmless if risk < 0 else toxic + harmless
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        scale = rate * 0.5 ** (4 * step / steps) / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
        theta -= scale * first / (1 - 0.9**step)
        theta[:n] = np.sign(theta[:n]) * np.maximum(np.abs(theta[:n]) - l1 * scale[:n], 0)
        theta = theta.astype(np.float32)
    return theta[:n], float(theta[n])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The features of each text, each once."""
    for texts in batches:
        out: list[np.ndarray] = []
        for text in texts.to_pylist():
            out.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in features([text]))])).view(np.int64))
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))


def smallest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` distinct texts of ``df`` with the smallest hashes; hashes under a bound that lets about twice as many pass are ranked, texts are not brought together."""
    rows = df.where("text is not null").select("text", F.xxhash64("text").bitwiseAND((1 << 62) - 1).alias("h"))
    about = rows.agg(F.approx_count_distinct("h")).first()[0]
    bound = int(min(1.0, (2 * n + 50) / max(about, 1)) * (1 << 62))
    last = rows.where(F.col("h") <= bound).select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positive: int = POSITIVE, unlabelled: int = UNLABELLED, n_features: int = FEATURES) -> PuModel:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    ``prior`` is the share of toxic texts; without one it is that of the labels.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    prior = (toxic / n if n else 0.0) if prior is None else prior
    if not toxic or not 0 < prior < 1:
        return constant(prior)
    chosen = marked.where("toxic > 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positive)
    # ``positive`` ids at most; of the texts of one document that with the smallest hash
    known = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    drawn = known.select("text", F.lit(True).alias("p")).unionByName(smallest(docs, unlabelled).select("text", F.lit(False).alias("p")))
    sample = scratch(drawn.select("p", _features("text").alias("f")), "toxic-sample", positive + unlabelled, 1000)
    try:
        sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
        n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
        if not n_p or not n_u:
            return constant(prior)
        counts = sample.select("p", F.explode("f").alias("k")).groupBy("k").agg(F.count_if("p").alias("in_p"), F.count_if(~F.col("p")).alias("in_u"))
        usual = n_p * (F.col("in_u") + 0.5) / n_u
        marks = F.col("in_p") * F.log(F.col("in_p") / usual) - (F.col("in_p") - usual)
        found = counts.where((F.col("in_p") >= LEAST) & (F.col("in_p") > usual)).select("k", marks.alias("marks")).where(F.col("marks") > MARKS)
        best = found.orderBy(F.desc("marks"), "k").limit(n_features).collect()  # ``n_features`` hashes
        keys = np.sort(np.array([r["k"] for r in best], np.int64).view(np.uint64))
        if not len(keys):
            return constant(prior)

        @F.arrow_udf("binary")
        def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                yield pa.array([np.packbits(np.isin(keys, x.values.to_numpy(zero_copy_only=False).view(np.uint64))).tobytes() for x in lists], pa.binary())

        got = sample.select("p", vector("f").alias("x")).collect()  # a vector of bits a text
    finally:
        release(sample)
    rows = {p: np.array([np.unpackbits(np.frombuffer(r["x"], np.uint8), count=len(keys)) for r in sorted(got, key=lambda r: r["x"]) if r["p"] == p]) for p in (True, False)}
    weights, bias = nn_pu(rows[True], rows[False], prior)
    used = np.flatnonzero(weights)
    return PuModel(keys[used], weights[used], bias)


def scorer(model: PuModel):
    """A column function of the text: its score."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array(np.concatenate([model.scores(texts[lo : lo + 200].to_pylist()) for lo in range(0, max(len(texts), 1), 200)]))
        finally:
            tidy()

    return score


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, score, predicted; fitted on documents and labels that are not held out."""
    lean(docs.sparkSession)
    learn = lambda df: df.where(~is_held_out(F.col("doc_id")))
    model = fit(learn(docs).select("doc_id", "text"), learn(labels).select("doc_id", "toxic"))
    got = docs.select("doc_id", scorer(model)("text").alias("score"))
    return got.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
