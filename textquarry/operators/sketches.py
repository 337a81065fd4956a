"""Mergeable sketches per group: distinct values and heavy hitters.

A run keeps one row of sketches per group; runs are merged without their rows.

* Distinct values: HyperLogLog of ``2 ** precision`` registers, a relative
  standard error of about ``1.04 / sqrt(2 ** precision)``.
* Heavy hitters: a run keeps the ``size`` largest counts of a group, each less
  the next one, and so does a merge of runs (Misra and Gries).  A kept
  count is at most the true one and at least that minus ``lost``, and ``lost``
  is at most ``n / (size + 1)``, also after merging.  Every value with more
  rows than that is among them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRECISION, SIZE = 12, 100
COUNTS = "array<struct<n:bigint,value:string>>"


def _cut(counts: Column, size: int, before: Column | None = None) -> Column:
    """The largest ``size`` counts less what is lost: the next count, or what was ``before``, if that is more."""
    ordered = F.sort_array(counts, False)
    least = F.coalesce(F.try_element_at(ordered, F.lit(size + 1))["n"], F.lit(0)).cast("long")
    lost = least if before is None else F.greatest(least, before)
    kept = F.filter(F.transform(F.slice(ordered, 1, size), lambda c: F.struct((c["n"] - lost).alias("n"), c["value"].alias("value"))), lambda c: c["n"] > 0)
    return F.struct(kept.alias("kept"), lost.alias("lost"))


def _add(a: Column, b: Column) -> Column:
    """Counts of two sketches of one group, by value."""
    both = F.concat(a, b)
    values = F.array_distinct(F.transform(both, lambda c: c["value"]))
    return F.transform(values, lambda v: F.struct(F.aggregate(both, F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["value"].eqNullSafe(v), c["n"]).otherwise(0)).alias("n"), v.alias("value")))


def sketch(df: DataFrame, group: str, value: str, precision: int = PRECISION, size: int = SIZE, spread: int = 64) -> DataFrame:
    """One row per group: n, values (HyperLogLog), kept (counts), lost.

    The largest counts are ranked in ``spread`` parts of each group, so that a
    group with a large part of all values is no hot task; a part passes on
    ``size`` counts, and the next one as what it lost.
    """
    rows = df.select(F.col(group).alias("__g"), F.col(value).cast("string").alias("__v")).where("__v is not null")
    counted = rows.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("__v", F.lit(precision)).alias("values"))
    rank = F.row_number().over(Window.partitionBy("__g", "__part").orderBy(F.desc("n"), "__v"))
    top = counted.withColumn("__part", F.pmod(F.xxhash64("__v"), F.lit(spread))).withColumn("__r", rank).where(F.col("__r") <= size + 1)
    # values of different parts are different, so counts need no adding up
    kept = F.collect_list(F.when(F.col("__r") <= size, F.struct("n", F.col("__v").alias("value"))))
    whole = top.groupBy("__g").agg(kept.alias("counts"), F.coalesce(F.max(F.when(F.col("__r") > size, F.col("n"))), F.lit(0)).cast("long").alias("before"))
    cut = whole.withColumn("c", _cut(F.col("counts"), size, F.col("before"))).select(F.col("__g").alias("__h"), "c")
    joined = totals.join(cut, F.col("__g").eqNullSafe(F.col("__h")))
    return joined.select(F.col("__g").alias(group), "n", "values", F.col("c.kept").alias("kept"), F.col("c.lost").alias("lost"))


def merge(runs: list[DataFrame], group: str, size: int = SIZE) -> DataFrame:
    """Sketches of several runs as one row per group."""
    rows = reduce(lambda a, b: a.unionByName(b), runs)
    got = rows.groupBy(group).agg(F.sum("n").alias("n"), F.hll_union_agg("values").alias("values"), F.collect_list("kept").alias("lists"), F.sum("lost").alias("before"))
    added = F.aggregate("lists", F.array().cast(COUNTS), _add)
    return got.withColumn("c", _cut(added, size)).select(group, "n", "values", F.col("c.kept").alias("kept"), (F.col("before") + F.col("c.lost")).alias("lost"))


def report(sketches: DataFrame, group: str, most: int = 10) -> DataFrame:
    """One row per group: n_rows, n_values (estimate), heavy (value and least count), error (most that a count lacks)."""
    return sketches.select(group, F.col("n").alias("n_rows"), F.hll_sketch_estimate("values").alias("n_values"), F.slice("kept", 1, most).alias("heavy"), F.col("lost").alias("error"))
