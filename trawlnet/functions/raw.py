"""Functions of bytes: charsets, gzip, the byte-wise integer code, robots files."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: byte-order marks and patterns of "<", in the order they are tried
_MARKS = (
    (b"<\0\0\0", "utf-32-le"), (b"\0\0\0<", "utf-32-be"), (b"<\0?\0", "utf-16-le"), (b"\0<\0?", "utf-16-be"),
    (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"),
)
_DECLARED = re.compile(r"<\?xml[^>]*?encoding\s*=\s*[\"']?([\w.:-]+)|<meta[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", re.I)


_DECLARED_STRICT = re.compile(r"<\?xml[^>]*?encoding\s*=\s*[\"']?([\w.:-]+)|<meta(?=[^>]*http-equiv\s*=\s*[\"']?content-type)[^>]*?charset\s*=\s*([\w.:-]+)", re.I)


def to_utf8(raw: bytes, hint: str = "", compat: bool = False) -> tuple[str, str]:
    """FN-CS2-5: text and encoding: the hint, marks, what the first 1024 bytes declare, UTF-8, Latin-1. ``compat``
    leaves out UTF-8 as a guess and knows a page's declaration in an http-equiv header only."""
    declared = (_DECLARED_STRICT if compat else _DECLARED).search(raw[:1024].decode("latin-1"))
    marked = [enc for mark, enc in _MARKS if len(raw) > len(mark) and raw.startswith(mark)]
    tried = [hint, *marked, (declared[1] or declared[2]) if declared else "", "" if compat else "utf-8"]
    for enc in dict.fromkeys(filter(None, tried)):
        try:
            return raw.decode(enc).removeprefix("﻿"), enc.lower()
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1"), "latin-1"


def encode(value: int) -> bytes:
    """FN-VB1: bijective base 128, low digits first, the last byte below 128."""
    if value < 1:
        raise ValueError(value)
    out, v = bytearray(), value - 1
    while v >= 128:
        out.append(v % 128 + 128)
        v = v // 128 - 1
    return bytes((*out, v))


def decode_all(raw: bytes) -> list[int]:
    """FN-VB2: the integers of a string of codes."""
    out, value, shift = [], 0, 0
    for b in raw:
        value += (b - 127 if b >= 128 else b + 1) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def encode_all(values: np.ndarray) -> bytes:
    """The codes of an array of positive integers, one after the other."""
    v = np.asarray(values, dtype=np.uint64) - np.uint64(1)
    digits, kept = [], [np.ones(len(v), dtype=bool)]
    while True:
        more = v >= 128
        digits.append(np.where(more, v % np.uint64(128) + np.uint64(128), v).astype(np.uint8))
        if not more.any():
            break
        kept.append(kept[-1] & more)
        v = np.where(more, v // np.uint64(128) - np.uint64(1), np.uint64(0))
    return np.stack(digits, axis=1)[np.stack(kept, axis=1)].tobytes()


def decode_array(raw: bytes) -> np.ndarray:
    """``decode_all`` as an array; what an unfinished code at the end holds is left out."""
    b = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.empty(0, dtype=np.uint64)
    b = b[: ends[-1] + 1].astype(np.uint64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat(np.where(b >= 128, b - np.uint64(127), b + np.uint64(1)) << (np.uint64(7) * place.astype(np.uint64)), starts)


def compress_postings(postings: Sequence[tuple[int, int]]) -> bytes:
    """FN-VB3: each document's distance from the one before and its frequency, coded."""
    rows = np.array(postings, dtype=np.int64).reshape(-1, 2)
    rows[1:, 0] -= rows[:-1, 0].copy()
    return encode_all(rows.ravel())


def decompress_postings(raw: bytes) -> list[tuple[int, int]]:
    rows = decode_array(raw).astype(np.int64)
    rows = rows[: len(rows) // 2 * 2].reshape(-1, 2)
    return list(zip(np.cumsum(rows[:, 0]).tolist(), rows[:, 1].tolist()))


def parse_robots(text: str) -> list[tuple[str, bool]]:
    """ST6: (prefix, allowed) of the records for all agents."""
    rules: list[tuple[str, bool]] = []
    for record in re.split(r"\n[ \t]*\n", re.sub(r"\r\n?", "\n", text)):
        agents, ours = False, False
        for line in record.split("\n"):
            key, colon, value = line.split("#", 1)[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if key == "user-agent":
                if agents:
                    agents = ours = False
                ours = ours or value == "*"
            else:
                agents = agents or key in ("allow", "disallow")
                if ours and key in ("allow", "disallow") and value.startswith("/"):
                    rules.append((value, key == "allow"))
    return rules


def _gunzip(raw: bytes | None) -> bytes | None:
    if raw is None:
        return None
    try:
        return gzip.decompress(raw) if raw else b""
    except (OSError, EOFError, zlib.error):
        return None


def gunzip(content: Column) -> Column:
    """SRC5, SRC6: null where the bytes are no gzip."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(_gunzip)

    return f(content)


def utf8_of(content: Column, hint: Column | None = None, compat: bool = False) -> Column:
    """Text and encoding of bytes; ``hint`` is a charset to try first, as a header gives it."""

    @F.pandas_udf("text string, encoding string")
    def f(s: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([to_utf8(x, y or "", compat) if x is not None else (None, None) for x, y in zip(s, h)], columns=["text", "encoding"])

    return f(content, hint if hint is not None else F.lit("").cast("string"))


def robots_of(text: Column) -> Column:
    @F.pandas_udf("array<struct<prefix:string,allow:boolean>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"prefix": p, "allow": a} for p, a in parse_robots(x or "")])

    return f(text)


def vbyte_encoded(numbers: Column) -> Column:
    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: encode_all(np.asarray(xs)))

    return f(numbers)


def vbyte_decoded(raw: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: decode_array(raw).astype(np.int64))

    return f(raw)


def postings_coded(postings: Column) -> Column:
    """FN-VB3: an array of (doc_id, freq), ids rising from 1, in the byte-wise code."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: compress_postings([(int(x["doc_id"]), int(x["freq"])) for x in xs]))

    return f(postings)


def postings_decoded(data: Column) -> Column:
    @F.pandas_udf("array<struct<doc_id:bigint,freq:bigint>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: [{"doc_id": d, "freq": n} for d, n in decompress_postings(raw)])

    return f(data)
