"""Keys that were seen before, kept as state that outlives a run.

Each key has one value of state: when it was first emitted.  The state is in
the checkpoint (RocksDB), split by key over the tasks, so no run reads what
earlier runs wrote, and a query that starts again goes on with what it knows.
With ``ttl_days`` a key is forgotten that long after it was first emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Emits the first row of a key, by the order columns, unless the key is known."""

    def __init__(self, order: list[str], columns: list[str], ttl_days: int | None):
        self.order, self.columns, self.ttl = order, columns, ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("at", T.LongType())])
        self.known = handle.getValueState("known", schema, *([self.ttl * 86_400_000] if self.ttl else []))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        known = self.known.exists()
        for part in rows:  # the least of each part, so that a key with very many rows is never held as a whole
            if not known and len(part):
                least = part.sort_values(self.order, kind="stable").head(1)
                first = least if first is None else pd.concat([first, least]).sort_values(self.order, kind="stable").head(1)
        if first is not None:
            self.known.update((pd.Timestamp.now().value // 1_000_000,))
            yield first[self.columns]

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: list[str], order: list[str], ttl_days: int | None = None) -> DataFrame:
    """The rows of a stream whose key no earlier batch or run emitted; of several in a batch the first by ``order``.

    Rows with a null in the key have no key and are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = stream.dropna(subset=key)
    mode = "ProcessingTime" if ttl_days else "None"
    return keyed.groupBy(*key).transformWithStateInPandas(FirstSeen(order, stream.columns, ttl_days), outputStructType=stream.schema, outputMode="Append", timeMode=mode)


def deduplicated(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The same rule on a table: the first row of each key that has one."""
    from ..operators.dedup import keep_first

    return keep_first(batch.dropna(subset=key), [F.col(k) for k in key], [F.col(c) for c in order])
