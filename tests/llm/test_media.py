import hashlib
import zlib

import numpy as np

from trawlnet.llm import media


def test_round_trip_and_padding():
    for text in (None, "", "a", "x" * 64, "é" * 33, "z" * 200_000):
        n, samples = media.payload_of(text)
        assert n == len((text or "").encode()) and len(samples) % 64 == 0 and samples
        assert samples.rstrip(b"\0") == (text or "").encode()
        assert media.read_wav(media.write_wav(samples)) == samples


def test_a_tone_is_found_at_its_bin():
    t = np.arange(8192)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.WINDOW) * (1 + 0.2 * np.sin(t / 900))).astype(np.uint8)
    at, bins = media.spectral_peaks(tone.tobytes())
    assert len(at) and set(bins[:3]) <= {19, 20, 21}


def test_blocks_do_not_change_peaks(monkeypatch):
    samples = np.random.default_rng(5).integers(32, 122, 64 * 900, dtype=np.uint8).tobytes()
    whole = media.spectral_peaks(samples)
    monkeypatch.setattr(media, "FRAMES", 37)
    for a, b in zip(whole, media.spectral_peaks(samples)):
        assert (a == b).all()
    codes = media.pair_codes(*whole)
    assert (np.diff(codes >> 24) >= 0).all()


def brute_peaks(samples):
    """Maxima by definition: one frame and one frequency at a time, by the sums of the transform."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(float)
    n = max(1, -(-(len(x) - media.WINDOW) // media.HOP) + 1)
    x = np.append(x, np.zeros((n - 1) * media.HOP + media.WINDOW - len(x)))
    k, t = np.arange(media.WINDOW // 2 + 1), np.arange(media.WINDOW)
    basis = np.exp(-2j * np.pi * np.outer(k, t) / media.WINDOW)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (media.WINDOW - 1))
    level = []
    for f in range(n):
        part = x[f * media.HOP : f * media.HOP + media.WINDOW]
        level.append(np.log1p(abs(basis @ ((part - part.sum() / media.WINDOW) * window))))
    out = []
    for f in range(n):
        least = sum(level[f]) / len(k) + media.ABOVE * np.sqrt(sum((level[f] - sum(level[f]) / len(k)) ** 2) / len(k))
        for b in range(1, len(k) - 1):
            v = level[f][b]
            beside = v > level[f][b - 1] and v > level[f][b + 1]
            if beside and v > least and (f == 0 or v > level[f - 1][b]) and (f == n - 1 or v >= level[f + 1][b]):
                out.append((f, b))
    return out


def test_peaks_and_pairs_match_brute_force():
    rng = np.random.default_rng(9)
    words = " ".join(rng.choice(["the", "quick", "brown", "fox", "jumps", "over"], 900)).encode()
    for samples in (words[: 64 * (len(words) // 64)], rng.integers(0, 256, 64 * 70, dtype=np.uint8).tobytes(), bytes(64), b"ab" * 32):
        at, bins = media.spectral_peaks(samples)
        want = brute_peaks(samples)
        assert list(zip(at.tolist(), bins.tolist())) == want
        pairs = [(f << 24) | (b << 14) | (c << 4) | (g - f) for i, (f, b) in enumerate(want) for g, c in want[i + 1 : i + 1 + media.FAN] if g - f <= media.REACH]
        assert media.pair_codes(at, bins).tolist() == sorted(pairs)


def test_rows(spark):
    rows = [(1, "some text " * 99), (1, "some text " * 99), (2, None), (3, ""), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "'x' AS fingerprint")
    out = media.media_digest(df).collect()
    assert [r.doc_id for r in out] == [1, 1, 2, 3, None] and out[0][1:] == out[1][1:] and out[2][1:] == out[3][1:]
    for r, (_, text) in zip(out, rows):
        n, samples = media.payload_of(text)
        assert (r.n_bytes, r.payload_bytes) == (n, len(samples))
        assert r.payload_sha256 == hashlib.sha256(samples).hexdigest() and r.tail_crc32 == zlib.crc32(samples[-64:])
        assert r.media_bytes == len(samples) + 44 and r.media_sha256 == hashlib.sha256(media.write_wav(samples)).hexdigest()
    assert out[3].feature.startswith("0:")
    assert media.media_digest(df.limit(0)).count() == 0
