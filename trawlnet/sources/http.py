"""A batch data source that fetches pages (SRC13). The fetcher is replaceable, so that tests need no network."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trawlnet.sources.store import visit_store

SCHEMA = "url string, status int, content_type string, content binary, truncated boolean"
AGENT, TIMEOUT_S, MAX_BYTES = "trawlnet/0.1", 60, 16 << 20


def fetch(url: str) -> tuple[int, str, bytes]:
    """Status, content type and body of a GET, one byte more than ``MAX_BYTES`` at most; redirects are followed."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml,application/xml"})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as r:
        return r.status, r.headers.get("content-type", ""), r.read(MAX_BYTES + 1)


def answer(url: str, get: Callable = fetch) -> tuple:
    """A row of ``SCHEMA``: bodies are cut at ``MAX_BYTES``, which ``truncated`` tells; failures have status 0."""
    try:
        status, kind, body = get(url)
    except (OSError, ValueError):
        return url, 0, None, None, False
    return url, status, kind, None if body is None else body[:MAX_BYTES], body is not None and len(body) > MAX_BYTES


def fetched(requests: DataFrame, get: Callable = fetch) -> DataFrame:
    """Rows of ``SCHEMA`` for a column url of any length: the fetching half of the crawl, in the tasks that hold the rows."""
    return visit_store(requests.select("url"), lambda rows: (answer(r["url"], get) for r in rows), SCHEMA)


class _Urls(InputPartition):
    def __init__(self, urls: Sequence[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: Sequence[str], per_task: int, get: Callable):
        self._urls, self._per_task, self._get = urls, per_task, get

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self._urls[i : i + self._per_task]) for i in range(0, len(self._urls), self._per_task)] or [_Urls(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return (answer(url, self._get) for url in partition.urls)


class HttpSource(DataSource):
    """``spark.read.format("trawlnet_http").option("urls", "http://a/ http://b/")``; failures have status 0."""

    get = staticmethod(fetch)

    @classmethod
    def name(cls) -> str:
        return "trawlnet_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("urls", "").split(), int(self.options.get("per_task", "50")), self.get)
