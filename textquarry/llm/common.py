"""Shared plumbing of the training-data operators.

* ``scratch`` writes an intermediate table to the folder the cluster shares
  (``spark.checkpoint.dir``) and reads it back.  The lineage is cut, so a lost
  executor costs a re-read of files and never a recomputation of the plan.
* ``hot_join`` joins rows to one row per key when a few keys may hold a large
  part of all rows.
* ``running_total`` is a prefix sum over a table of any size.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are
#: fewer than HOT_SHARE hot keys whatever the size of the input.
HOT_SHARE = 1000

#: Rows of a few numbers in a file, and documents in a task of Python code, at least where there are as many.
ROWS_PER_FILE, DOCS_PER_TASK = 200_000, 2000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is already gone
            return


def compact(df: DataFrame, rows: int, per_task: int = ROWS_PER_FILE) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more partitions than give each ``per_task`` rows or more."""
    return df.coalesce(max(1, -(-rows // per_task)))


def scratch(df: DataFrame, name: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage ends here).

    A bound on its ``rows``, if known, keeps a small table from being written
    as many tiny files.  The files stay until ``release``, or until the
    driver's Python ends, because the result that is built on them is lazy.
    """
    spark = df.sparkSession
    df = df if rows is None else compact(df, rows, per_file)
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``scratch`` that no result still to be computed reads."""
    for df in tables:
        remove(df.sparkSession, df._scratch)
        _written.remove((df.sparkSession, df._scratch))


def lean(spark: SparkSession) -> None:
    """Batches of 1000 rows for Python workers, unless the session asks for fewer; with whole texts the default of 10 000 takes hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows, which should be a few numbers each."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, keyed: DataFrame, key: Sequence[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``keyed`` (one row per key) without a skewed task.

    ``keyed[count]`` is the number of rows of the key.  Keys with more than
    ``total / HOT_SHARE`` rows (under HOT_SHARE of them, so a bounded
    broadcast) are joined by broadcast, all others by their hash; no task gets
    more than a small share of the rows of one key.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot = keyed.where(F.col(count) > limit)
    cold = keyed.where(F.col(count) <= limit)
    marks = F.broadcast(hot.select(*key).withColumn("__hot", F.lit(True)))
    marked = rows.join(marks, list(key), "left")
    a = marked.where("__hot").drop("__hot").join(F.broadcast(hot), list(key), how)
    b = marked.where("__hot is null").drop("__hot").join(cold, list(key), how)
    return b.unionByName(a)


def running_total(df: DataFrame, order: Sequence[str], values: dict[str, str], block: str) -> DataFrame:
    """Add exclusive prefix sums of ``values`` (new name: column) in ``order``.

    ``df`` must be materialised and have a column ``block`` whose blocks are
    contiguous ranges of ``order``.  Only one row per block meets in one task;
    within the blocks the sums are windows over a block each.
    """
    per = df.groupBy(block).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in values.items()])
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(block, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values])
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, block)  # dealt by block, as the window needs it
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__o_{n}")).alias(n) for n, c in values.items()])


def by_range(df: DataFrame, order: Sequence[str], rows: int, per_block: int = 200_000) -> DataFrame:
    """Materialise ``df`` in contiguous ranges of ``order``, numbered in ``__block``."""
    n = max(partitions(df.sparkSession), -(-rows // per_block))
    return scratch(df.repartitionByRange(n, *order).withColumn("__block", F.spark_partition_id()), "ranges")


def tidy() -> None:
    """Give the memory that a Python worker no longer needs back to the machine, since workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and ``tidy`` when it ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def with_new_text(docs: DataFrame, row: str, text: Column, same: Column) -> list[Column]:
    """The columns of ``docs``, held in the struct ``row``, with another text.

    ``n_chars``, if there, follows the text unless it is the same.  Columns in
    a struct cannot clash with an operator's own.
    """
    out = []
    for c, t in docs.dtypes:
        old = F.col(row).getField(c)
        new = text if c == "text" else F.when(same, old).otherwise(F.length(text)).cast(t) if c == "n_chars" else old
        out.append(new.alias(c))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
