"""Incremental runs over landed files, the streaming form of resume and checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents


def landed(spark: SparkSession, folder: str, schema: str, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``step`` of every new batch once; a restart goes on where the checkpoint ends."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Chunking needs no state, so it streams as it is."""
    return chunk_documents(stream, keys)


def word_counts(stream: DataFrame, time: str, words, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Word counts per window, with a watermark for late rows."""
    rows = stream.withWatermark(time, late).select(time, F.explode(words).alias("word"))
    return rows.groupBy(F.window(time, window), "word").agg(F.count(F.lit(1)).alias("n"))
