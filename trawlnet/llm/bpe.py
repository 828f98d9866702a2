r"""Byte-level BPE encoding and decoding (operator 2).

The tiktoken library encodes with ranks from a local file. Texts are cut beforehand where no match of the
pre-splitting pattern can cross, so the ids of the parts, joined, are the ids of the whole:

* before the last character of a white-space run that precedes another character. There ``\s+(?!\S)`` always ends;
  once every text is cut there the lookahead decides nothing, and the parts are matched by the same pattern without
  it, which the library's engine runs about twice as fast and without backtracking;
* in long texts also before a single space between two other characters, every ``LONG_CHARS`` or so.

Defined results: null text counts as empty; an empty text has no ids and decodes to empty bytes; repeated rows each
give a row; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.plans.arrow import map_columns

#: Characters after which a text is cut at the next safe boundary.
LONG_CHARS = 1 << 16
#: Unicode White_Space, as the library's engine has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_RARE_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUN_END = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")
_SAFE = re.compile(f"(?<=[^{SPACE}])(?= [^{SPACE}])")
_LOOKAHEAD = r"|\s+(?!\S)|\s+"


def load_encoding(path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks, without special tokens, for texts cut by
    ``safe_parts``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    if not pattern.endswith(_LOOKAHEAD):
        raise ValueError("the pattern doesn't end as this module's cuts assume")
    return tiktoken.Encoding(path, pat_str=pattern.removesuffix(_LOOKAHEAD) + r"|\s+", mergeable_ranks=ranks, special_tokens={})


def _short(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > LONG_CHARS and (cut := _SAFE.search(text, at + LONG_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def safe_parts(text: str) -> list[str]:
    """``text`` in parts that are encoded separately; joined, they are the text."""
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or _RARE_SPACE.search(text):
        return [y for x in _RUN_END.split(text) for y in _short(x)]
    return [text] if len(text) <= LONG_CHARS else list(_short(text))


def encode_bytes(encoding, text: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit integers."""
    out = array("I")
    for part in safe_parts(text):
        out.extend(encoding.encode_ordinary(part))
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_encodings: dict[str, object] = {}


def encoding_for(path: str):
    """The encoding of a rank file, loaded once in each Python worker."""
    if path not in _encodings:
        _encodings[path] = load_encoding(path)
    return _encodings[path]


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype="<u4").tolist()


def bpe_encode(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids (binary: little-endian unsigned 32-bit) for each row."""

    def setup() -> Callable[..., list]:
        encoding = encoding_for(rank_file)
        return lambda keys, texts: [keys, [encode_bytes(encoding, t or "") for t in texts]]

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return map_columns(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids binary", setup)


def bpe_decode(df: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, decoded (binary) for each row of binary ids. Bytes, since ids need not end on characters."""

    def setup() -> Callable[..., list]:
        decode = encoding_for(rank_file).decode_bytes
        return lambda keys, raws: [keys, [decode(ids_of(r or b"")) for r in raws]]

    source = df.select(id_col, ids_col)
    return map_columns(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, decoded binary", setup)


def bpe_round_trip(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids, decoded: encoding and decoding of the encoded ids in one pass over the texts."""

    def setup() -> Callable[..., list]:
        encoding = encoding_for(rank_file)

        def run(keys: list, texts: list) -> list:
            ids = [encode_bytes(encoding, t or "") for t in texts]
            return [keys, ids, [encoding.decode_bytes(ids_of(r)) for r in ids]]

        return run

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return map_columns(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids binary, decoded binary", setup)


def bpe_digest(df: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    out = bpe_round_trip(df, rank_file)
    return out.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
