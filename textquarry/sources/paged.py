"""A paged listing as a Spark data source, for batches and streams.

``spark.read.format("paged")`` has a partition per key, so the keys of a
listing are read side by side by the executors; the pages of one key follow
each other by their continuation marks.  ``spark.readStream.format("paged")``
has the marks as its offset: a batch reads up to ``pages`` more pages of each
key, and a query that starts again goes on where its checkpoint ends.

Options: ``url``, an address with ``{key}`` and ``{mark}`` (http, https or
file); ``keys``, a JSON array; ``first``, the mark of a first page; ``next``,
where a page has its next mark, as names joined by dots; ``pause``, seconds
between two requests of one reader; ``attempts`` and ``wait``, tries of a page
and seconds after a failure, times the try (``blocked`` seconds after a 403 or
429); ``most``, pages of a key; ``pages``, pages of a key in a batch of a stream.

A page that is not there (404, no such file) ends its key.  A page that stays
out of reach fails the task, which Spark tries again, so no page is skipped.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "key string, page int, mark string, response string"


class Pages:
    """Pages of a listing by key and mark, with pace and patience."""

    def __init__(self, options: dict[str, str]):
        get = options.get
        self.url, self.keys = options["url"], json.loads(options["keys"])
        self.first, self.next = get("first", ""), get("next", "continue.cmcontinue").split(".")
        self.pause, self.attempts = float(get("pause", "0")), int(get("attempts", "3"))
        self.wait, self.blocked = float(get("wait", "2")), float(get("blocked", "5"))
        self.most, self.pages = int(get("most", "1000000")), int(get("pages", "1"))
        self.asked = 0.0

    def page(self, key: str, mark: str) -> str | None:
        """A page, or null if there is none."""
        address = self.url.replace("{key}", urllib.parse.quote(key, safe="")).replace("{mark}", urllib.parse.quote(mark, safe=""))
        for attempt in range(1, self.attempts + 1):
            time.sleep(max(0.0, self.asked + self.pause - time.monotonic()))
            self.asked = time.monotonic()
            try:
                with urllib.request.urlopen(address, timeout=30) as response:
                    return response.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                again = self.blocked if e.code in (403, 429) else self.wait
                problem: Exception = e
            except (urllib.error.URLError, OSError) as e:
                if isinstance(e, FileNotFoundError) or isinstance(getattr(e, "reason", None), FileNotFoundError):
                    return None
                again, problem = self.wait, e
            if attempt < self.attempts:
                time.sleep(again * attempt)
        raise ConnectionError(f"{address}: {problem}")

    def following(self, response: str) -> str | None:
        """The next mark that a page names; null after the last one, and for what is no such page."""
        try:
            at = json.loads(response)
            for name in self.next:
                at = at.get(name) if isinstance(at, dict) else None
        except ValueError:
            return None
        return None if at in (None, "") else str(at)

    def walk(self, key: str, mark: str, number: int, until: str | None = None, most: int | None = None) -> Iterator[tuple[str, int, str, str, str | None]]:
        """(key, number, mark, response, next mark) from a mark on, up to the mark ``until`` or for ``most`` pages."""
        limit = self.most - number if most is None else min(most, self.most - number)
        while mark is not None and mark != until and limit > 0:
            response = self.page(key, mark)
            if response is None:
                return
            after = self.following(response)
            yield key, number, mark, response, after
            mark, number, limit = after, number + 1, limit - 1


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in Pages(self.options).keys]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pages = Pages(self.options)
        for row in pages.walk(partition.value, pages.first, 0):
            yield row[:4]


class StreamReader(DataSourceStreamReader):
    """Offsets hold the mark of the next page of each key (null at the end) and its number.

    Marks are opaque, so the driver has to ask for a page to know the next
    mark; the executors read the pages between two offsets themselves.  Where
    an earlier run ended is known from the offset that Spark asks to plan from.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        pages = Pages(self.options)
        return {k: [pages.first, 0] for k in pages.keys}

    def latestOffset(self) -> dict:  # noqa: N802
        pages = Pages(self.options)
        start = self.at or self.initialOffset()
        out = {}
        for key, (mark, number) in start.items():
            for _, n, _, _, after in pages.walk(key, mark, number, most=pages.pages):
                mark, number = after, n + 1
            out[key] = [mark, number]
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None or any(self.at[k][1] < n for k, (_, n) in end.items() if k in self.at):
            self.at = end  # a run that goes on
        return [InputPartition([k, *start.get(k, [Pages(self.options).first, 0]), n]) for k, (_, n) in end.items() if start.get(k, [None, 0])[1] < n]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        key, mark, number, upto = partition.value
        for row in Pages(self.options).walk(key, mark, number, most=upto - number):
            yield row[:4]

    def commit(self, end: dict) -> None:
        if self.at is None or sum(n for _, n in end.values()) > sum(n for _, n in self.at.values()):
            self.at = end


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(PagedSource)
