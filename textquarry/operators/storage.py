"""Tables that several steps read: computed once, kept in the folder the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without one gets a temporary folder, a cluster without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back, so that a lost executor costs a read and each step reads its columns only.

    The files stay until ``release``, or until the driver's Python ends, since
    what is built on them is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._durable = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that no result still to be computed reads."""
    for df in tables:
        delete(_written.pop(df._durable), df._durable)


@atexit.register
def _sweep() -> None:
    for path, spark in _written.items():
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is already gone
            return
