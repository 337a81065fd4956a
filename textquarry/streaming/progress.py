"""Progress of streaming queries, published as rows."""

from __future__ import annotations

import json
import queue
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

SCHEMA = "event string, id string, run_id string, name string, batch long, at string, n_rows long, rows_per_second double, seconds double, problem string"


class ProgressTable(StreamingQueryListener):
    """Writes a row per start, batch and end of every query of a session to a folder of JSON lines.

    A listener must not hold the queries up, so events go to a queue and one
    thread writes them, a file per event; a subscriber reads the folder as a
    stream of its own (``subscribe``).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.number = spark, folder.rstrip("/"), 0
        self.events: queue.Queue = queue.Queue()
        self.thread = threading.Thread(target=self._write, daemon=True)
        self.thread.start()

    def _write(self) -> None:
        jvm, configuration = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while (row := self.events.get()) is not None:
            self.number += 1
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{row['run_id']}-{self.number:09d}.json")
            part = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_{row['run_id']}-{self.number:09d}.tmp")
            system = path.getFileSystem(configuration)
            out = system.create(part, True)
            out.write(bytearray((json.dumps(row) + "\n").encode()))
            out.close()
            system.rename(part, path)  # a reader sees whole files only
            self.events.task_done()
        self.events.task_done()

    def _put(self, event: str, source: object, **more: object) -> None:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        row = dict.fromkeys(names) | {"event": event, "id": str(source.id), "run_id": str(source.runId)} | more
        self.events.put(row)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self._put("started", event, name=event.name, at=event.timestamp)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        self._put("progress", p, name=p.name, batch=p.batchId, at=p.timestamp, n_rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, seconds=p.batchDuration / 1000)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        self._put("idle", event, at=event.timestamp)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self._put("terminated", event, problem=event.exception)

    def close(self) -> None:
        """Write what is left and stop."""
        self.events.put(None)
        self.thread.join()


def publish(spark: SparkSession, folder: str) -> ProgressTable:
    listener = ProgressTable(spark, folder)
    spark.streams.addListener(listener)
    return listener


def withdraw(spark: SparkSession, listener: ProgressTable) -> None:
    spark.streams.removeListener(listener)
    listener.close()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that were published."""
    return spark.read.schema(SCHEMA).json(folder)


def subscribe(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as a stream, in the order in which they were written."""
    return spark.readStream.schema(SCHEMA).json(folder)
