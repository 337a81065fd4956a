"""Parallel pairs: filters, samples, splits, settings, and calls of a model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from .dedup import exact

#: Spellings of the output column that are one column.
SPELLINGS = ("text_simplified", "simplified")
LEVELS, VARIANTS, RATIOS, BEAMS = ("conservative", "balanced", "aggressive"), ("small", "basic"), (0.3, 1.0), (1, 8)
DEFAULTS = {"aggressiveness": "balanced", "model_variant": "basic", "max_length_ratio": 0.75, "num_beams": 8, "drop_dates": False, "drop_law_refs": False, "drop_stats": False, "hotkey_combo": "ctrl+alt+s"}


def aligned(df: DataFrame, columns: tuple[str, str] = ("text", "simplified_text")) -> DataFrame:
    for old in SPELLINGS:
        if old in df.columns and columns[1] not in df.columns:
            df = df.withColumnRenamed(old, columns[1])
    return df.select(*columns)


def present(df: DataFrame, not_null: list[str], not_blank: list[str]) -> DataFrame:
    out = df.dropna(subset=not_null)
    for c in not_blank:
        out = out.where(X.strip(F.col(c)) != "")
    return out


def at_most(df: DataFrame, columns: list[str], limit: int = 3000) -> DataFrame:
    for c in columns:
        df = df.where(F.length(c) <= limit)
    return df


def ratio_between(df: DataFrame, source: str, output: str, low: float, high: float) -> DataFrame:
    return df.where(X.compression(F.col(source), F.col(output)).between(low, high))


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """A user turn and the next assistant turn of the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    got = turns.withColumn("__role", F.lead("role").over(w)).withColumn("simplified_text", F.lead("text").over(w))
    return got.where("role = 'user' and __role = 'assistant'").select("conv_id", "turn", "text", "simplified_text")


def draw(keys: list[Column], seed: int) -> Column:
    """A number from 0 to 1 that follows from the keys and the seed (md5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sample_rows(df: DataFrame, keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """``k`` rows, or all there are: those of the smallest draws."""
    return df.orderBy(draw([F.col(c) for c in keys], seed), *keys).limit(k)


def smallest_draws(df: DataFrame, keys: list[str], k: int, seed: int = 42, cells: int = 1 << 16) -> DataFrame:
    """The same rows as ``sample_rows`` for a ``k`` of any size.

    Draws are even, so the number of rows in each of ``cells`` equal ranges
    shows in which range the cut lies; only that range is sorted.
    """
    drawn = df.withColumn("__u", draw([F.col(c) for c in keys], seed)).withColumn("__cell", F.floor(F.col("__u") * cells).cast("int"))
    edge, left = cells, k
    for cell, n in sorted(tuple(r) for r in drawn.groupBy("__cell").agg(F.count(F.lit(1))).collect()):  # one row a cell
        if n > left:
            edge = cell
            break
        left -= n
    below = drawn.where(F.col("__cell") < edge)
    return below.unionByName(drawn.where(F.col("__cell") == edge).orderBy("__u", *keys).limit(left)).drop("__u", "__cell")


def mix_in(new: DataFrame, old: DataFrame, keys: list[str], text: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """All new rows and a sample of old ones, ``share`` of the new count; new rows win over equal texts."""
    k = int(share * new.count())
    both = new.withColumn("__p", F.lit(0)).unionByName(smallest_draws(old, keys, k, seed).withColumn("__p", F.lit(1)))
    return exact(both, [text], ["__p", *keys]).drop("__p")


def random_split(df: DataFrame, keys: list[str], train: float = 0.95, seed: int = 42) -> DataFrame:
    return df.withColumn("split", F.when(draw([F.col(c) for c in keys], seed) < train, "train").otherwise("validation"))


def stratified_split(df: DataFrame, keys: list[str], stratum: str, test: float = 0.05, seed: int = 42, cells: int = 1 << 16) -> DataFrame:
    """In each stratum the draws up to the ``test`` quantile are for validation.

    Counts per stratum and range of draws show where the quantile lies; only
    the rows of that one range are ranked, whatever the size of a stratum.
    """
    drawn = df.withColumn("__u", draw([F.col(c) for c in keys], seed)).withColumn("__cell", F.floor(F.col("__u") * cells).cast("int"))
    counts = drawn.groupBy(F.col(stratum).alias("__s"), "__cell").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__s")
    counts = counts.withColumn("__upto", F.sum("__n").over(whole.orderBy("__cell"))).withColumn("__want", F.floor((F.sum("__n").over(whole) - 1) * test) + 1)
    edges = counts.where("__upto >= __want and __upto - __n < __want").select("__s", F.col("__cell").alias("__edge"), (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__left"))
    placed = drawn.join(edges, F.col(stratum).eqNullSafe(F.col("__s")))
    at_edge = placed.where("__cell = __edge").withColumn("__rank", F.rank().over(Window.partitionBy("__s").orderBy("__u")))
    chosen = lambda rows, is_test: rows.select(*df.columns, F.when(is_test, "validation").otherwise("train").alias("split"))
    return chosen(placed.where("__cell <> __edge"), F.col("__cell") < F.col("__edge")).unionByName(chosen(at_edge, F.col("__rank") <= F.col("__left")))


def valid_settings(raw: DataFrame) -> DataFrame:
    """Each setting, or its default where it is missing, of another type or out of range.

    ``raw`` has all settings as strings, as a JSON file gives them.
    """
    known = {f: F.col(f) if f in raw.columns else F.lit(None).cast("string") for f in DEFAULTS}
    number = lambda c, t, lo, hi: F.when(c.try_cast(t).between(lo, hi), c.try_cast(t))
    good = {
        "aggressiveness": F.when(known["aggressiveness"].isin(*LEVELS), known["aggressiveness"]),
        "model_variant": F.when(known["model_variant"].isin(*VARIANTS), known["model_variant"]),
        "max_length_ratio": number(known["max_length_ratio"], "double", *RATIOS),
        "num_beams": number(F.when(known["num_beams"].rlike(r"^-?\d+$"), known["num_beams"]), "int", *BEAMS),
        **{f: F.when(F.lower(known[f]).isin("true", "false"), F.lower(known[f]) == "true") for f in ("drop_dates", "drop_law_refs", "drop_stats")},
        "hotkey_combo": F.when(X.strip(known["hotkey_combo"]) != "", known["hotkey_combo"]),
    }
    return raw.select(*[F.coalesce(c, F.lit(DEFAULTS[f])).alias(f) for f, c in good.items()])


def conditioned(df: DataFrame, settings: DataFrame, text: str = "text") -> DataFrame:
    """Every text under every setting: prefix, prompt and generation limits."""
    prefix = X.flag_prefix(*[F.col(c) for c in ("aggressiveness", "max_length_ratio", "drop_dates", "drop_law_refs", "drop_stats")])
    rows = df.crossJoin(settings).withColumn("prefix", prefix)
    return rows.withColumn("prompt", F.concat("prefix", text)).withColumn("repetition_penalty", X.penalty(F.col("aggressiveness"), X.REPETITION_PENALTY)).withColumn("length_penalty", X.penalty(F.col("aggressiveness"), X.LENGTH_PENALTY))


def under_all_prefixes(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return rows.crossJoin(pairs.select("prefix").distinct())


def with_retries(call: Callable[[str], str], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """Call again after an error or an empty answer; null after the last attempt."""

    def run(part: str) -> str | None:
        for n in range(1, attempts + 1):
            try:
                answer = call(part)
                if answer:
                    return answer
            except Exception:  # noqa: BLE001  whatever the model raises is a failed attempt
                pass
            if n < attempts:
                sleep(wait * n)
        return None

    return run


def echo_model(part: str) -> str:
    """A stand-in for a model: the first two fifths of the words."""
    words = part.split()
    return " ".join(words[: max(1, len(words) * 2 // 5)])


def simplify(pending: DataFrame, key: str, text: str, make_model: Callable[[], Callable[[str], str]] = lambda: echo_model, limit: int = 16_803) -> DataFrame:
    """Clean, split to the budget, call the model per part, join; (key, simplified_text).

    The model is made once per task.  Rows without text give an empty answer,
    a failed part gives null, so that the row stays pending.  One worker splits
    and calls, and holds the parts of ``X.SLICE`` rows beside the Arrow batch.
    """
    clean = pending.select(key, X.clean_for_model(F.col(text)).alias("__t"))
    schema = T.StructType([clean.schema[0], T.StructField("__n", T.IntegerType()), T.StructField("simplified_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = with_retries(make_model())
        for batch in batches:
            for at in range(0, batch.num_rows, X.SLICE):
                keys, texts = batch.slice(at, X.SLICE).columns
                parts = [(i, n, p) for i, t in enumerate(texts.to_pylist()) for n, p in enumerate(X.fit_budget(t, limit) or [""])]
                rows, places, bodies = zip(*parts, strict=True)
                answers = [model(p) if p.strip() else "" for p in bodies]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(places, pa.int32()), pa.array(answers, pa.string())], names=schema.names)

    from .chunking import rejoin

    return rejoin(clean.mapInArrow(run, schema), key, "__n", "simplified_text")


def ensure_ready(models: Callable[[], list[str]], name: str) -> bool:
    """Before a run: fails if the model server does not answer, else says whether it has the model."""
    try:
        found = models()
    except OSError as e:
        raise RuntimeError("the model server cannot be reached") from e
    return any(name in m for m in found)


def timed(call: Callable[[str], str], clock: Callable[[], float] = time.perf_counter) -> Callable[[str], tuple[str, float]]:
    """The answer of a call, and the milliseconds it took."""

    def run(part: str) -> tuple[str, float]:
        began = clock()
        answer = call(part)
        return answer, (clock() - began) * 1000

    return run


def generate(df: DataFrame, text: str, output: str, make_model: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32) -> DataFrame:
    """Add what a model makes of the texts, which it gets ``batch`` at a time; it is made once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            frame[output] = [x for k in range(0, len(texts), batch) for x in model(texts[k : k + batch])]
            yield frame

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(output, T.StringType())]))


def translate(df: DataFrame, text: str, make_translator: Callable[[str], Callable[[str], str] | None], langs: tuple[str, ...] = ("ru", "en"), missing: str = "[no key, not translated]") -> DataFrame:
    """Add a translation for each language: a fixed note without a translator, an empty text after an error."""

    def attempt(call: Callable[[str], str] | None, value: object) -> str:
        if call is None:
            return missing
        try:
            return call(value if isinstance(value, str) else "").strip()
        except (OSError, LookupError, ValueError):
            return ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = {k: make_translator(k) for k in langs}
        for frame in frames:
            for k, call in calls.items():
                frame[f"text_{k}"] = [attempt(call, v) for v in frame[text]]
            yield frame

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *(T.StructField(f"text_{k}", T.StringType()) for k in langs)]))


def pending_rows(df: DataFrame, done: DataFrame | None, key: str, value: str) -> DataFrame:
    """Rows that need work and were not finished by an earlier run."""
    out = df.where(X.needs_work(F.col(value))) if value in df.columns else df
    return out.join(done.select(key), key, "left_anti") if done is not None else out


def accepted(df: DataFrame, source: str, output: str, words: Column, version: int) -> DataFrame:
    """Length rules of the two prompts: keep 85 to 95 %, or cut 40 to 60 % of longer texts."""
    r = X.compression(F.col(source), F.col(output))
    return df.where(r.between(0.85, 0.95) if version == 1 else (words < 80) | r.between(0.4, 0.6))
