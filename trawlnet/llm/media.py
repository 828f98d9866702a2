"""Media columns (operator 5): bytes kept as 8-bit mono WAV, read back, and fingerprinted from their spectrum.

The UTF-8 bytes of a text, zero-padded to a positive multiple of ``BLOCK``, are the samples. The wave module writes
and reads the container. A short-time Fourier transform of the samples read back gives local maxima over time and
frequency; each maximum is paired with the few that follow it, and a pair becomes one integer that holds the time of
the first, both frequency bins and the distance in time. The array of these is ordered by time.

Defined results: null text counts as empty; an empty text is ``BLOCK`` zero bytes, whose spectrum has no maximum, so
its array is empty; equal texts give equal values, as each is transformed by itself in blocks of fixed size; long
texts are transformed in blocks, so that memory follows the block; of equal values in time the later one is the maximum,
and equal neighbours in frequency have none; repeated rows each give a row; an empty table gives an empty one; other
columns of the input are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.plans.arrow import map_columns

BLOCK = 64
RATE = 8000
WINDOW, HOP = 256, 128
#: Frames that are transformed at once.
FRAMES = 1024
#: A maximum is paired with so many that follow it, at most so many frames later.
FAN, REACH = 3, 8
#: Standard deviations by which a maximum must stand above the mean of its frame.
ABOVE = 1.5

_HANN = np.hanning(WINDOW)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes; the bytes padded with zeros to a positive multiple of ``BLOCK``."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def write_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the local maxima of the spectrum, by frame, then bin."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    at, bins = [], []
    for first in range(0, n, FRAMES):
        # one more frame on either side, so that maxima at the edges see their neighbours
        lo, hi = max(0, first - 1), min(n, first + FRAMES + 1)
        part = x[lo * HOP : (hi - 1) * HOP + WINDOW].astype(np.float64)
        part = np.pad(part, (0, (hi - 1 - lo) * HOP + WINDOW - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP]
        frames = frames - frames.mean(axis=1, keepdims=True)
        level = np.log1p(np.abs(np.fft.rfft(frames * _HANN, axis=1)))
        mid = level[:, 1:-1]
        top = (mid > level[:, :-2]) & (mid > level[:, 2:]) & (mid > level.mean(axis=1, keepdims=True) + ABOVE * level.std(axis=1, keepdims=True))
        top[1:] &= mid[1:] > mid[:-1]
        top[:-1] &= mid[:-1] >= mid[1:]
        f, b = np.nonzero(top)
        own = (f + lo >= first) & (f + lo < first + FRAMES)
        at.append(f[own] + lo)
        bins.append(b[own] + 1)
    return np.concatenate(at), np.concatenate(bins)


def pair_codes(at: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Pairs of peaks as integers, by time: frame << 24 | first bin << 14 | second bin << 4 | frames between."""
    found = []
    for k in range(1, FAN + 1):
        gap = at[k:] - at[:-k]
        near = gap <= REACH
        found.append((at[:-k][near] << 24) | (bins[:-k][near] << 14) | (bins[k:][near] << 4) | gap[near])
    return np.sort(np.concatenate(found)).astype(np.int64)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, media (the WAV), payload (its samples, read back), fingerprint (time-coded array)."""

    def setup() -> Callable[..., list]:
        def run(keys: list, texts: list) -> list:
            sizes, stored, back, codes = [], [], [], []
            for t in texts:
                n, samples = payload_of(t)
                media = write_wav(samples)
                read = read_wav(media)
                sizes.append(n)
                stored.append(media)
                back.append(read)
                codes.append(pair_codes(*spectral_peaks(read)))
            return [keys, sizes, stored, back, codes]

        return run

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    key = source.schema[0].dataType.simpleString()
    return map_columns(source, f"`{id_col}` {key}, n_bytes bigint, media binary, payload binary, fingerprint array<bigint>", setup)


def media_digest(df: DataFrame) -> DataFrame:
    """The contract's columns, derived from the stored media, the samples read back and the fingerprint."""
    return media_columns(df).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("fingerprint").cast("string"), F.lit(":"), F.sha2(F.array_join("fingerprint", ","), 256)).alias("feature"),
    )
