"""Corpus merge with filled columns, and the reports on a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def union_filled(parts: dict[str, DataFrame], fill: dict[str, object] | None = None) -> DataFrame:
    """All rows of all parts; missing columns are null (or filled), ``origin_file`` names the part."""
    tagged = [df.withColumn("origin_file", F.lit(name)) for name, df in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out.fillna(fill) if fill else out


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def stats_by(df: DataFrame, column: str, words: Column) -> DataFrame:
    """Rows, words and share of all rows of each value."""
    got = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(words).alias("n_words"))
    return got.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def survivors(files: DataFrame, kept: DataFrame, file: str) -> DataFrame:
    """Rows left of each input file, with 0 for none."""
    return files.join(counts_by(kept, file), file, "left").select(file, F.coalesce("n", F.lit(0)).alias("n"))


def quality_audit(df: DataFrame, text: str, words: Column) -> DataFrame:
    """One row: empty and duplicate texts, rows with a null, word counts."""
    any_null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in df.columns])
    per_text = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.trim(F.coalesce(F.col(text), F.lit(""))) == "").cast("int")).alias("empty"), F.sum(any_null.cast("int")).alias("nulls"), F.min(words).alias("lo"), F.max(words).alias("hi"), F.sum(words).alias("sum")
    )
    return per_text.agg(
        F.sum("n").alias("n_rows"), F.sum("empty").alias("n_empty"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("nulls").alias("n_nulls"), F.min("lo").alias("min_words"), F.max("hi").alias("max_words"), (F.sum("sum") / F.sum("n")).alias("mean_words")
    )


def clean_report(df: DataFrame, before: Column, after: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(before != after).alias("changed"), F.count_if((before != "") & (after == "")).alias("emptied"))


def autofilled(df: DataFrame, domain: str, filled: str) -> DataFrame:
    """Rows of each domain among those whose domain was filled in, and their share."""
    got = counts_by(df.where(F.col(filled)), domain)
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def short_texts(df: DataFrame, text: str, order: list[str], words: int = 25, most: int = 3) -> DataFrame:
    """The first rows of at most ``words`` words."""
    return df.where(X.word_count(F.col(text)) <= words).orderBy(*order).limit(most)


def balance(df: DataFrame, column: str, low: int = 150, good: int = 300) -> DataFrame:
    """One row: number of values, the rarest and its count, and a verdict."""
    got = counts_by(df, column).agg(F.count(F.lit(1)).alias("n_values"), F.min("n").alias("least"), F.min_by(column, F.struct("n", column)).alias("rarest"))
    return got.withColumn("verdict", F.when(F.col("least") < low, "too few").when(F.col("least") < good, "borderline").otherwise("enough"))


def _place(df: DataFrame, column: str, low: float, high: float, rank: int, cells: int = 4096, few: int = 100_000) -> float:
    """The value at a place of the sorted column, from counts in ever narrower cells between ``low`` and ``high``."""
    v = F.col(column)
    while True:
        width = (high - low) / cells
        inside = df.where(v.between(low, high))
        if width <= 0 or low + width == low:
            return low
        cell = F.least(F.floor((v - low) / width), F.lit(cells - 1))
        got = sorted(tuple(r) for r in inside.groupBy(cell.alias("k")).agg(F.count(v), F.min(v), F.max(v)).collect())  # one row a cell
        for _, n, least, most in got:
            if rank < n:
                low, high = least, most
                break
            rank -= n
        if low == high:
            return low
        if n <= few:
            return sorted(r[0] for r in df.where(v.between(low, high)).select(v).collect())[rank]  # at most ``few`` numbers


def latency_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, median (the mean of the middle two), least and most; nothing is sorted as a whole."""
    v = F.col(column).cast("double")
    clean = df.select(v.alias("v")).where("v is not null and not isnan(v)")
    n, mean, low, high = clean.agg(F.count("v"), F.avg("v"), F.min("v"), F.max("v")).first()
    median = sum(_place(clean, "v", low, high, k) for k in ((n - 1) // 2, n // 2)) / 2 if n else None
    return df.sparkSession.createDataFrame([(mean, median, low, high)], "mean double, median double, least double, most double")


def vector_moments(df: DataFrame, vector: str) -> DataFrame:
    """Mean and sample deviation over all components of all vectors."""
    values = df.select(F.explode(vector).alias("v"))
    return values.agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_samp(F.col("v").cast("double")).alias("std"))


def progress(df: DataFrame, name: str, done: Column) -> DataFrame:
    """Counters that Spark reports while the rows pass (``Observation``)."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("done"))


def excess(df: DataFrame, column: str, factor: float = 1.0) -> DataFrame:
    """For each value the fraction to keep so that none exceeds ``factor`` times the mean."""
    got = counts_by(df, column)
    mean = F.avg("n").over(Window.partitionBy())
    return got.withColumn("keep", F.least(F.lit(1.0), mean * factor / F.col("n")))
