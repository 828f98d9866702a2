"""A small search server over an index (SV1-SV6), on the standard library.

``/?q=words`` ranks, ``/cache/<id>`` shows a stored page, ``/source/<file>`` a file of the given folder. Answers are top
lists of bounded length, so what reaches the driver does not grow with the collection.
"""

from __future__ import annotations

import html
import mimetypes
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.urls import decode_query
from trawlnet.operators.index import Index, StoredIndex
from trawlnet.operators.pages import render_results
from trawlnet.operators.retrieval import cached_page, combine, ranked, vector_query, with_metadata

PORT, TOP = 8090, 100


class NotFoundError(Exception):
    pass


class Search:
    """Answers to paths: (status, content type, body). ``meta`` has doc_id, url, title; ``store`` doc_id, html; with
    ``ranks`` (doc_id, pagerank) results are ordered by the combined score."""

    def __init__(self, index: Index | StoredIndex, meta: DataFrame, store: DataFrame | None = None, ranks: DataFrame | None = None, files: str | None = None, top: int = TOP):
        self.index, self.meta, self.store, self.ranks, self.top = index, meta, store, ranks, top
        self.files = Path(files).resolve() if files else None

    def answer(self, target: str) -> tuple[int, str, bytes]:
        try:
            parts = urlsplit(target)
            route, _, rest = parts.path.lstrip("/").partition("/")
            routes = {"": lambda: self._page(decode_query(parts.query).get("q", "")), "cache": lambda: self._cache(rest), "source": lambda: self._file(unquote(rest))}
            if route not in routes:
                raise NotFoundError
            return routes[route]()
        except NotFoundError:
            return 404, "text/html; charset=utf-8", b"<h1>404 Not Found</h1>"
        except ValueError:
            return 400, "text/html; charset=utf-8", b"<h1>400 Bad Request</h1>"

    def results(self, query: str) -> DataFrame:
        """doc_id, score, url, title of the best."""
        found = vector_query(self.index, query, None if self.ranks is not None else self.top, strict=False)
        if self.ranks is not None:
            found = ranked(combine(found, self.ranks), k=self.top)
        else:
            found = found.withColumnRenamed("weight", "score")
        return with_metadata(found.select("doc_id", "score"), self.meta)

    def _page(self, query: str) -> tuple[int, str, bytes]:
        shown = ""
        if query.strip():
            items = render_results(self.results(query)).orderBy(F.desc("score"), "doc_id").limit(self.top).collect()
            shown = f"<ol>{''.join(r['item'] for r in items)}</ol>"
        form = f'<form><input name="q" value="{html.escape(query)}"><input type="submit"></form>'
        return 200, "text/html; charset=utf-8", f"<!doctype html><title>Search</title>{form}{shown}".encode()

    def _cache(self, name: str) -> tuple[int, str, bytes]:
        rows = cached_page(self.store, int(name)).limit(1).collect() if self.store is not None else []
        if not rows:
            raise NotFoundError
        return 200, "text/html; charset=utf-8", (rows[0]["html"] or "").encode()

    def _file(self, name: str) -> tuple[int, str, bytes]:
        path = (self.files / name).resolve() if self.files else None
        if path is None or not path.is_relative_to(self.files) or not path.is_file():
            raise NotFoundError
        return 200, mimetypes.guess_type(path.name)[0] or "application/octet-stream", path.read_bytes()


def server(search: Search, port: int = PORT, host: str = "127.0.0.1") -> HTTPServer:
    """A server that answers one request at a time; start it with ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            try:
                status, kind, body = search.answer(self.path)
            except Exception as e:
                self.log_error("%r", e)
                status, kind, body = 500, "text/html; charset=utf-8", b"<h1>500 Internal Server Error</h1>"
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, format: str, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)
