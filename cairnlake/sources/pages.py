"""Paged and polled services: bounded page iteration, and a Spark data source with one partition per page."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageClient:
    """Iterates pages of a service through ``fetch(page, size) -> list of records``; the service itself is passed in.

    Repeated records end up once; ``truncated`` tells whether a bound stopped the iteration.
    """

    def __init__(self, fetch: Callable[[int, int], list[dict]], key: str, page_size: int = 100, max_pages: int = 10, max_records: int = 1200):
        self.fetch, self.key, self.page_size, self.max_pages, self.max_records = fetch, key, page_size, max_pages, max_records
        self.truncated = False

    def records(self) -> Iterator[dict]:
        seen, given = set(), 0
        for page in range(self.max_pages):
            rows = self.fetch(page, self.page_size)
            for row in rows:
                if row.get(self.key) in seen:
                    continue
                if given >= self.max_records:
                    self.truncated = True
                    return
                seen.add(row.get(self.key))
                given += 1
                yield row
            if len(rows) < self.page_size:
                return
        self.truncated = True


def poll(status: Callable[[], tuple[int, dict, float]], tries: int = 10, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The body of the first answer that is neither 202 nor 429; waits as long as the service says in between."""
    for _ in range(tries):
        code, body, wait = status()
        if code not in (202, 429):
            return body
        sleep(wait)
    raise TimeoutError("the job did not end")


class PagesSource(DataSource):
    """``spark.read.format("pages")``: options ``fetch`` (module:function, called with page and size), ``pages``, ``page_size``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(dict(self.options))


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.options["fetch"].partition(":")
        rows = getattr(importlib.import_module(module), function)(partition.value, int(self.options.get("page_size", 100)))
        for row in rows:
            yield partition.value, json.dumps(row, sort_keys=True)
