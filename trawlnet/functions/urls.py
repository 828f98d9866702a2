"""HTTP URLs: parsing to seven parts, normalisation, resolution of references, fingerprints.

Pure functions of strings, and the same as column functions over Arrow batches. What is no valid HTTP URL is null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PLAIN = _UNRESERVED | frozenset(b":/?#[]@!$&'()*+,;=")
_PARTS = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\Z")


class InvalidURL(ValueError):
    """No valid URL, or one with a scheme that isn't supported."""


class Url(NamedTuple):
    scheme: str = ""
    userinfo: str = ""
    host: str = ""
    port: str = ""
    path: str = ""
    query: str = ""
    fragment: str = ""

    def __str__(self) -> str:
        at = f"//{self.userinfo}{'@' * bool(self.userinfo)}{self.host}{':' * bool(self.port)}{self.port}" if self.host else ""
        return f"{self.scheme}{':' * bool(self.scheme)}{at}{self.path}{'?' * bool(self.query)}{self.query}{'#' * bool(self.fragment)}{self.fragment}"


def fix_percent(text: str) -> str:
    """URL5: unreserved characters plain, all else that a URL may not hold as upper-case escapes."""
    raw, out, at = text.encode(), bytearray(), 0
    while at < len(raw):
        c = raw[at]
        if c == 37:
            code = raw[at + 1 : at + 3]
            if len(code) < 2:  # a short escape at the end stays
                return (out + raw[at:]).decode()
            try:
                c = int(code, 16) if code.isalnum() else -1
            except ValueError:
                c = -1
            if c < 0:
                raise InvalidURL(text)
            out += bytes((c,)) if c in _UNRESERVED else b"%%%02X" % c
            at += 3
        else:
            out += bytes((c,)) if c in _PLAIN else b"%%%02X" % c
            at += 1
    return out.decode()


def remove_dots(path: str) -> str:
    """URL4: RFC 3986 section 5.2.4, and repeated slashes as one."""
    rest, out = path, []
    while rest:
        if rest.startswith(("../", "./")):
            rest = rest[rest.index("/") + 1 :]
        elif rest.startswith("//"):
            rest = "/" + rest.lstrip("/")
        elif rest.startswith("/./") or rest == "/.":
            rest = "/" + rest[3:]
        elif rest.startswith("/../") or rest == "/..":
            rest = "/" + rest[4:]
            if out:
                out.pop()
        elif rest in (".", ".."):
            rest = ""
        else:
            cut = rest.find("/", 1)
            cut = len(rest) if cut < 0 else cut
            out.append(rest[:cut])
            rest = rest[cut:]
    return "".join(out)


def parse(text: str, schemes: tuple[str, ...] = ("http",)) -> Url:
    """URL1-URL3, URL5: the normalised parts; raises InvalidURL."""
    scheme, authority, path, query, fragment = (x or "" for x in _PARTS.match(text).groups())
    scheme = scheme.lower()
    if scheme and scheme not in schemes:
        raise InvalidURL(text)
    userinfo = host = port = ""
    if _PARTS.match(text)[2] is not None:
        before, at, after = authority.partition("@")
        userinfo, rest = (before, after) if at else ("", authority)
        host, _, port = rest.partition(":")
        if not re.fullmatch(r"[A-Za-z0-9.-]+", host) or not re.fullmatch(r"[0-9]*", port):
            raise InvalidURL(text)
        host = host.lower().removesuffix(".")
        if port == "80" and scheme in ("http", ""):
            port = ""
    if scheme:
        path = remove_dots(path)
    path = fix_percent(path)
    if host and not path:
        path = "/"
    return Url(scheme, userinfo, host, port, path, fix_percent(query), fix_percent(fragment))


def resolve(base: Url, ref: Url) -> Url:
    """URL6: RFC 3986 section 5.2.2."""
    if ref.scheme or ref.host:
        out = ref._replace(scheme=ref.scheme or base.scheme, path=remove_dots(ref.path))
    else:
        path, query = ref.path, ref.query
        if not path:
            path, query = base.path, ref.query or base.query
        else:
            if not path.startswith("/"):
                path = "/" + path if base.host and base.path in ("", "/") else base.path[: base.path.rfind("/") + 1] + path
            path = remove_dots(path)
        out = base._replace(path=path, query=query, fragment=ref.fragment)
    return out._replace(path="/") if out.host and not out.path else out


def strip(url: Url) -> Url:
    """URL8: without userinfo, query and fragment."""
    return url._replace(userinfo="", query="", fragment="")


def _try(f, *args):
    if any(a is None for a in args):
        return None
    try:
        return f(*args)
    except InvalidURL:
        return None


def fnv1_64(raw: bytes) -> int:
    """URL11: FNV-1 with 64 bits; bytes from 128 on are sign-extended, as signed characters are."""
    h = 14695981039346656037
    for b in raw:
        h = (h * 1099511628211) & 0xFFFFFFFFFFFFFFFF ^ (b if b < 128 else 0xFFFFFFFFFFFFFF00 | b)
    return h


def fnv1_32(raw: bytes) -> int:
    """URL11: FNV-1 with 32 bits, bytes sign-extended likewise."""
    h = 2166136261
    for b in raw:
        h = (h * 16777619) & 0xFFFFFFFF ^ (b if b < 128 else 0xFFFFFF00 | b)
    return h


def fnv1_64_all(raws: Sequence[bytes]) -> np.ndarray:
    """``fnv1_64`` of many strings at once: byte by byte over all that are as long."""
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(raws), dtype=np.int8).astype(np.int64).view(np.uint64)  # sign-extended
    starts = (np.cumsum(sizes) - sizes)[order]
    longer = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # strings longer than i
    h = np.full(len(raws), 14695981039346656037, dtype=np.uint64)
    for i, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] * np.uint64(1099511628211)) ^ data[starts[:n] + i]
    out = np.empty_like(h)
    out[order] = h
    return out


_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")


def decode_query(text: str) -> dict[str, str]:
    """URL10: the pairs of a query string. Plus signs are spaces, stray percent signs stay, the last value of a key
    wins; bytes that are no UTF-8 become the replacement character."""
    plain = lambda x: _ESCAPE.sub(lambda m: bytes((int(m[1], 16),)), x.replace("+", " ").encode()).decode("utf-8", "replace")
    pairs = (part.partition("=") for part in text.split("&") if part)
    return {plain(k): plain(v) for k, _, v in pairs}


def query_pairs(query: Column) -> Column:
    @F.pandas_udf("map<string,string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode_query(x))

    return f(query)


def without_dots(path: Column) -> Column:
    """URL4 of a column."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else remove_dots(x))

    return f(path)


def percent_fixed(text: Column) -> Column:
    """URL5 of a column; null where an escape is invalid."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _try(fix_percent, x))

    return f(text)


def normalize_url(url: Column, schemes: tuple[str, ...] = ("http",)) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _try(lambda t: str(parse(t, schemes)), x))

    return f(url)


def parse_http_url(url: Column, schemes: tuple[str, ...] = ("http",)) -> Column:
    @F.pandas_udf("scheme string, userinfo string, host string, port string, path string, query string, fragment string")
    def f(s: pd.Series) -> pd.DataFrame:
        rows = [_try(lambda t: parse(t, schemes), x) or (None,) * 7 for x in s]
        return pd.DataFrame(rows, columns=Url._fields)

    return f(url)


def resolve_url(base: Column, ref: Column, stripped: bool = False, schemes: tuple[str, ...] = ("http",)) -> Column:
    @F.pandas_udf("string")
    def f(b: pd.Series, r: pd.Series) -> pd.Series:
        def one(x, y):
            out = resolve(parse(x, schemes), parse(y, schemes))
            return str(strip(out) if stripped else out)

        return pd.Series([_try(one, x, y) for x, y in zip(b, r)], dtype=object)

    return f(base, ref)


def fingerprint(url: Column) -> Column:
    """The FNV-1 hash of UTF-8 bytes as a signed long; compare for equality only."""

    @F.pandas_udf("bigint")
    def f(s: pd.Series) -> pd.Series:
        known = s[s.notna()]
        found = fnv1_64_all([x.encode() for x in known]).view(np.int64)
        return pd.Series(found, index=known.index, dtype="Int64").reindex(s.index)

    return f(url)
