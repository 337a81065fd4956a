"""Exact, prioritised and normalised de-duplication, and membership joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .storage import durable


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; of rows that are equal in key and order any one.

    Keys and orders decide, rows do not move: counts by key and order combine
    before the shuffle, and what is kept of them are the keys of several rows
    (``durable``).  A row of no such key passes, one of such a key if its order
    is the least.  A row is the winner of its key at most once unless rows tie;
    only then, and only winners, are brought together.
    """
    ks, names = [f"__k{i}" for i in range(len(key))], [f"__o{i}" for i in range(len(order))]
    slim = df.select(*[k.alias(n) for k, n in zip(key, ks, strict=True)], F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)]).alias("__order"))
    ties = slim.groupBy(*ks, "__order").agg(F.count(F.lit(1)).alias("n"))
    first = ties.groupBy(*ks).agg(F.sum("n").alias("__n"), F.min(F.struct("__order", "n")).alias("__f")).where("__n > 1")
    first = durable(first.select(*[F.col(k).alias(f"{k}f") for k in ks], F.col("__f.__order").alias("__least"), F.col("__f.n").alias("__ties")), "first")
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[k.alias(n) for k, n in zip(key, ks, strict=True)], F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)]).alias("__order"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}f")) for k in ks]
    joined = keyed.join(first, same, "left")
    won = F.col("__order").eqNullSafe(F.col("__least"))
    out = joined.where(F.col("__ties").isNull() | (won & (F.col("__ties") == 1))).select("__row.*")
    if first.where("__ties > 1").isEmpty():
        return out
    again = joined.where(won & (F.col("__ties") > 1)).groupBy(*ks).agg(F.first("__row").alias("__row"))
    return out.unionByName(again.select("__row.*"))


def _keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as keys; a string stands for itself by its SHA-256, so that no text is moved twice."""
    return [F.sha2(F.col(c), 256) if t == "string" else F.col(c) for c, t in df.select(*columns).dtypes]


def exact(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, _keys(df, columns), [F.col(c) for c in order])


def by_priority(df: DataFrame, columns: list[str], priority: Column, order: list[str]) -> DataFrame:
    return keep_first(df, _keys(df, columns), [priority, *[F.col(c) for c in order]])


def fewest_artefacts(df: DataFrame, columns: list[str], text: str, order: list[str]) -> DataFrame:
    return keep_first(df, _keys(df, columns), [X.artefacts(F.col(text)), *[F.col(c) for c in order]])


def normalised(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per text, white space and case apart."""
    return keep_first(df, [F.sha2(F.lower(X.squeeze(F.col(text))), 256)], [F.col(c) for c in order])


def changed(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not blank and differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    marked = df.withColumn("__before", before)
    return marked.where((X.strip(F.col(value)) != "") & ~F.col(value).eqNullSafe(F.col("__before"))).drop("__before")


def not_seen(candidates: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    return candidates.join(seen.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def per_group_cap(df: DataFrame, group: list[str], order: list[str], cap: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def first_rows(df: DataFrame, order: list[str], target: int) -> DataFrame:
    """The first ``target`` rows of the order: a limit, not a global window."""
    return df.orderBy(*order).limit(target)


def with_fallback(primary: DataFrame, fallback: DataFrame, on: str, order: list[str], target: int) -> DataFrame:
    """Rows of ``primary``, filled up to ``target`` from ``fallback``; no key twice."""
    both = primary.withColumn("__p", F.lit(0)).unionByName(fallback.withColumn("__p", F.lit(1)))
    once = keep_first(both, [F.col(on)], [F.col("__p"), *[F.col(c) for c in order]])
    return first_rows(once, ["__p", *order], target).drop("__p")


def until_two_empty(pages: DataFrame, group: str, page: str, n_found: str) -> DataFrame:
    """Pages up to the second of two empty ones in a row."""
    w = Window.partitionBy(group).orderBy(page)
    empty = F.col(n_found) == 0
    twice = F.coalesce(F.lag(empty).over(w), F.lit(False)) & empty
    marked = pages.withColumn("__twice", twice)
    stopped = F.coalesce(F.sum(F.col("__twice").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__stopped", stopped).where("__stopped = 0").drop("__twice", "__stopped")
