"""Sharding by a minimax contiguous partition.

Rows with equal text form one atomic group.  Groups stand in the order of
their first ``doc_id``; the smallest capacity for which a greedy fill of the
groups, in that order, needs at most ``n_shards`` shards is found by binary
search, and the groups are cut there.  Everything on the main path is
DataFrame operations.

Many partitions keep to that capacity, and the law asks for near equal sizes.
If the capacity is the size of a single group, that group is a shard of its
own, and what stands on either side of it is shared out by the same rule.
Otherwise each cut is made next to an even share of what is left, as far as
the rest still fits the capacity.

The search never brings groups to the driver.  It works on the prefix sums of
the sizes: a greedy check needs, for each shard, the last prefix that is not
over a target.  Many capacities are checked in one pass (one conditional
maximum each), so a pass narrows the search by a factor of ``PROBES``.  The
first bounds are ``max(total / n, largest group)`` and that plus the largest
group, and every checked capacity moves them further: a feasible one down to
the fullest shard it led to, an infeasible one up by one.

Defined results: a null text has size 1 (no bytes plus 1), its crc is 0 and
all nulls are one group; an empty table gives an empty result; equal rows get
slots of their own; null ids come first; more shards than groups leave shards
empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, by_range, hot_join, partitions, running_total, scratch, text_bytes

#: Capacities that one pass checks.
PROBES = 64


class Prefix:
    """Group ends of a table of (__start, __end), as sums of all sizes before them."""

    def __init__(self, groups: DataFrame):
        self.groups = groups.select("__start", "__end")

    def last(self, targets: list[int]) -> list[int]:
        """For each target the largest end that is not over it, or 0."""
        row = self.groups.agg(*[F.max(F.when(F.col("__end") <= t, F.col("__end"))).alias(f"t{i}") for i, t in enumerate(targets)]).first()
        return [int(x) if x is not None else 0 for x in row]

    def first(self, target: int) -> int:
        """The smallest end, or 0, that is not under the target, which some end reaches."""
        return int(self.groups.agg(F.min(F.when(F.col("__end") >= target, F.col("__end")))).first()[0]) if target > 0 else 0

    def largest(self, start: int, end: int) -> tuple[int, int]:
        """Start and end of the first largest group in a range."""
        row = self.groups.where((F.col("__start") >= start) & (F.col("__end") <= end)).agg(F.max(F.struct(F.col("__end") - F.col("__start"), -F.col("__start"))).alias("m")).first()["m"]
        return -int(row[1]), int(row[0]) - int(row[1])

    def fill(self, start: int, end: int, capacity: int) -> list[int]:
        """Ends of the greedy shards of a range."""
        cuts = [start]
        while cuts[-1] < end:
            cuts.append(min(self.last([cuts[-1] + capacity])[0], end))
        return cuts[1:]


def smallest_capacity(prefix: Prefix, start: int, end: int, largest: int, n_shards: int) -> int:
    """The smallest capacity with which a greedy fill of a range takes ``n_shards`` shards at most."""
    low = max(-(-(end - start) // n_shards), largest)
    high, best = low + largest, None
    while best is None or low < best:
        top = high if best is None else best - 1
        step = max(1, -(-(top - low + 1) // PROBES))
        probes = sorted({*range(low, top + 1, step), top})
        at, full = [start] * len(probes), [0] * len(probes)
        for _ in range(n_shards):
            live = [i for i in range(len(probes)) if at[i] < end]
            if not live:
                break
            for i, to in zip(live, prefix.last([at[i] + probes[i] for i in live]), strict=True):
                to = max(at[i], min(to, end))
                full[i], at[i] = max(full[i], to - at[i]), to
        fits = [i for i in range(len(probes)) if at[i] >= end]
        if not fits:  # the first bounds always fit, so a best one is known
            break
        i = fits[0]
        best = full[i]
        if i:
            low = max(low, probes[i - 1] + 1)
    return best


def cuts_of(prefix: Prefix, start: int, end: int, n_shards: int) -> list[int]:
    """Ends of ``n_shards`` shards of a range, near equal and none over the smallest capacity."""
    if n_shards <= 1 or start >= end:
        return [end] * n_shards
    a, b = prefix.largest(start, end)
    capacity = smallest_capacity(prefix, start, end, b - a, n_shards)
    if capacity == b - a > -(-(end - start) // n_shards):
        left, right = len(prefix.fill(start, a, capacity)), len(prefix.fill(b, end, capacity))
        fair = round((n_shards - 1) * (a - start) / max(1, a - start + end - b))
        k = 0 if a == start else n_shards - 1 if b == end else min(max(fair, left), n_shards - 1 - right)
        return [*cuts_of(prefix, start, a, k), b, *cuts_of(prefix, b, end, n_shards - 1 - k)]
    latest = [end]  # the first place from which that many shards reach the end
    for _ in range(n_shards - 1):
        latest.append(max(start, prefix.first(latest[-1] - capacity)))
    cuts = [start]
    for i in range(1, n_shards):
        even = cuts[-1] + (end - cuts[-1]) // (n_shards - i + 1)
        low, high = prefix.last([even, cuts[-1] + capacity])
        low = max(low, cuts[-1])
        above = prefix.first(even + 1) if even < end else end
        near = low if even - low <= above - even else above
        cuts.append(min(max(near, latest[n_shards - i]), max(high, cuts[-1]), end))
    return [*cuts[1:], end]


def shard_rows(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shard sizes are near equal.  ``slot`` counts the rows of a
    shard from 0 without gaps.
    """
    text = F.col(text_col)
    rows = scratch(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (text_bytes(text) + 1).alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("__group"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("__group").agg(F.min("doc_id").alias("__first"), F.sum("size").alias("__size"), F.count(F.lit(1)).alias("__n"))
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return _shape(rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0)))
    order = ["__first", "__group"]
    groups = by_range(groups, order, count)
    groups = scratch(running_total(groups, order, {"__start": "__size"}, "__block").withColumn("__end", F.col("__start") + F.col("__size")), "shard-groups")
    cuts = cuts_of(Prefix(groups), 0, int(total), n_shards)
    shard = sum(((F.col("__start") >= F.lit(c)).cast("int") for c in cuts[:-1]), F.lit(0))
    placed = groups.select("__group", "__n", shard.alias("shard"))
    out = hot_join(rows, placed, ["__group"], "__n", count).drop("__n", "__group")
    bins = max(partitions(docs.sparkSession), -(-count // 200_000))
    out = out.withColumn("__bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)).cast("int"))
    out = scratch(out.withColumn("__part", F.spark_partition_id()), "shard-placed")
    return _shape(_slots(out, count))


def _slots(out: DataFrame, count: int) -> DataFrame:
    """Number the rows of each shard.

    Rows that stand very often, under HOT_SHARE of them, come after all others
    of their shard, each with a range of numbers that its parts share out.
    """
    key = ["shard", "doc_id", "text_crc32"]
    often = out.groupBy(*key).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > max(1000, count // HOT_SHARE))
    before = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    often = scratch(often.withColumn("__first", F.coalesce(F.sum("__m").over(before), F.lit(0))).select(*[F.col(k).alias(f"__{k}") for k in key], "__first"), "shard-often")
    same = F.col("shard").eqNullSafe(F.col("__shard")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("text_crc32").eqNullSafe(F.col("__text_crc32"))
    marked = out.join(F.broadcast(often), same, "left").drop("__shard", "__doc_id", "__text_crc32")
    few = marked.where("__first is null").drop("__first")
    if often.isEmpty():
        return _ranked(few)
    hot = marked.where("__first is not null")
    per = hot.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__m"))
    upto = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per.withColumn("__offset", F.coalesce(F.sum("__m").over(upto), F.lit(0))).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__part").alias("__p"), "__offset")
    ranked = hot.withColumn("__rank", F.row_number().over(Window.partitionBy("__part", *key).orderBy("size")) - 1)
    ranked = ranked.join(parts, same & (F.col("__part") == F.col("__p")))
    cold = few.groupBy("shard").agg(F.count(F.lit(1)).alias("__cold")).withColumnRenamed("shard", "__s")
    ranked = ranked.join(F.broadcast(cold), F.col("shard") == F.col("__s"), "left")  # a row a shard
    ranked = ranked.withColumn("slot", F.coalesce("__cold", F.lit(0)) + F.col("__first") + F.col("__offset") + F.col("__rank"))
    return _ranked(few).unionByName(ranked, allowMissingColumns=True)


def _ranked(out: DataFrame) -> DataFrame:
    """An offset per (shard, bin), then a rank in it."""
    per = out.groupBy("shard", "__bin").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("shard", "__bin", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__bin").orderBy("doc_id", "text_crc32")
    ranked = out.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["shard", "__bin"]).withColumn("slot", F.col("__rank") + F.col("__offset"))


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
