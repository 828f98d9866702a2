"""Language identification (operator 6): one bit-sliced Bloom filter over character n-grams for all languages.

Slot ``i`` of the filter is a word with one bit for each language (further words hold further languages). The slots of
an n-gram, AND-ed, are the languages whose filter contains it. For a text, the n-grams that each language contains are
counted; the count is corrected for the false positives that the fill of that language's slice makes expected; the
language with the largest corrected count is predicted.

N-grams are windows of 3 and of 4 code points over the lower-cased text, in which every non-letter is a gap; a gap may
only open or close a window. Learning takes ``SAMPLE`` documents of each language at most (in expectation: those whose
hashed id falls under a threshold set by the language's count) and keeps the ``KEEP`` most frequent n-grams of each, or
all with ``keep=None`` (held-out rows of sf0.1: 100 % right, and 99.96 % with all). Everything runs on whole Arrow batches in numpy, in
blocks of bounded size; blocks of one text overlap, and each window counts where it starts, so they change nothing.

The score compares the best language with the next; ``share`` tells which share of the text's n-grams the best one holds,
so that texts in no learnt language can be rejected.

Defined results: ``und`` with score 0 for a null text or one without a letter; a text with letters of which no n-gram
is known gets the most frequent language with score 0; equal corrected counts go to the more frequent language;
repeated rows each give a row; a very long text is read whole, in blocks; other columns of the input are ignored; an empty
table gives an empty one; without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.plans.arrow import map_columns, pieces

#: Documents of a language that are learnt from, in expectation. A documented bound of the training sample.
SAMPLE = 2000
#: N-grams that a language keeps.
KEEP = 6000
#: Slots of the filter, and look-ups of an n-gram.
SLOTS, LOOKUPS = 1 << 17, 2
LENGTHS = (3, 4)
#: Code points handled at once.
BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def _codes(low: str) -> np.ndarray:
    """Code points with 0 for non-letters."""
    x = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(_letters()[x], x, 0).astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    """Code points of the lower-cased text with 0 for non-letters, and gaps around."""
    return np.concatenate([np.zeros(1, np.uint32), _codes(text.lower()), np.zeros(1, np.uint32)])


def text_pieces(text: str, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """``code_points`` in pieces, with how many windows start in each: all but the last end with what their windows need of
    the next."""
    low = text.lower()
    n, gap = len(low) + 2, np.zeros(1, np.uint32)
    for at in range(0, n, size):
        end = min(n, at + size + max(LENGTHS) - 1)
        x = [gap] * (at == 0) + [_codes(low[max(0, at - 1) : end - 1])] + [gap] * (end == n)
        yield np.concatenate(x), min(size, n - at)


def blocks_of(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts, about ``BLOCK`` code points at a time: the text of each piece, whether it has a letter, the n-grams
    that start in one, and their text."""
    block: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([x for _, x, _ in block])
        own = np.repeat(np.array([i for i, _, _ in block]), [len(x) for _, x, _ in block])
        starts_here = np.concatenate([np.arange(len(x)) < n for _, x, n in block])
        keys, starts = gram_keys(x)
        ok = starts_here[starts]
        return np.array([i for i, _, _ in block]), np.array([bool(x.any()) for _, x, _ in block]), keys[ok], own[starts[ok]]

    for i, text in enumerate(texts):
        if not text:
            continue
        for x, n in text_pieces(text, BLOCK):
            block.append((i, x, n))
            size += len(x)
            if size >= BLOCK:
                yield flush()
                block.clear()
                size = 0
    if block:
        yield flush()


def gram_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the n-grams in a run of code points, and where each starts."""
    keys, starts = [], []
    wide = x.astype(np.uint64)
    inside = x != 0
    for n in LENGTHS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        ok = inside[1 : m + 1].copy()
        for i in range(2, n - 1):
            ok &= inside[i : m + i]
        at = np.flatnonzero(ok)
        key = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            key = (key ^ wide[at + i]) * _ODD
            key ^= key >> np.uint64(29)
        keys.append(key)
        starts.append(at)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts)


def slots_of(keys: np.ndarray) -> Iterator[np.ndarray]:
    step = (keys * _ODD2) >> np.uint64(40) | np.uint64(1)
    first = keys >> np.uint64(17)
    for k in range(LOOKUPS):
        yield ((first + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    """``languages`` by falling frequency; ``table[word, slot]`` the language bits; ``false`` the rates of false
    positives by language."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], languages: list[str]) -> LanguageModel:
        table = np.zeros(((len(languages) + 63) // 64, SLOTS), dtype=np.uint64)
        for i, name in enumerate(languages):
            for slots in slots_of(grams[name].astype(np.uint64)):
                table[i // 64, slots] |= np.uint64(1 << i % 64)
        fill = [np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS for i in range(len(languages))]
        return cls(languages, table, np.array(fill) ** LOOKUPS)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: n-grams that each language contains, n-grams in all, and whether it has a letter."""
        hits = np.zeros((len(texts), len(self.languages)))
        total, lettered = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for piece_of, has_letter, keys, owner in blocks_of(texts):
            lettered[piece_of[has_letter]] = True
            total += np.bincount(owner, minlength=len(texts))
            for word in range(len(self.table)):
                mask = np.full(len(keys), np.uint64(0xFFFFFFFFFFFFFFFF))
                for slots in slots_of(keys):
                    mask &= self.table[word][slots]
                for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    bit = (mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
                    hits[:, i] += np.bincount(owner[bit], minlength=len(texts))
        return hits, total, lettered

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and share of each text."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        hits, total, lettered = self.counts(texts)
        right = np.maximum(0, hits - total[:, None] * self.false) / np.maximum(1e-9, 1 - self.false)
        best = right.argmax(axis=1)
        top = right[np.arange(len(texts)), best]
        right[np.arange(len(texts)), best] = 0
        second = right.max(axis=1)
        known = lettered & (top > 0)
        score = np.where(known, top / np.maximum(top + second, 1e-9), 0.0)
        share = np.where(known, np.minimum(1.0, top / np.maximum(total, 1)), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], score.tolist(), share.tolist()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


def learnable(id_col: str = "doc_id"):
    """Rows that may be learnt from: crc32 of the id as text, mod 4, is not 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, keep: int | None = KEEP) -> LanguageModel:
    """Learn from rows of ``docs`` with a language; the caller leaves out what is held out.

    The languages' counts and each language's ``keep`` n-grams come to the driver: both are bounded by the number of
    languages, and the n-grams are counted over the bounded sample only.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts, key=lambda k: (-counts[k], k))
    if not languages:
        return LanguageModel([], np.zeros((0, SLOTS), np.uint64), np.zeros(0))
    # a language is known by its place: short keys, whatever its name holds
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / counts[k]))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = docs.where(draw < share[F.col("lang")]).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                names, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for name in sorted(set(names)):
                    for _, _, found, _ in blocks_of([t for k, t in zip(names, texts) if k == name]):
                        keys, n = np.unique(found.view(np.int64), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = chosen.mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = found
    if keep is not None:
        top = found.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= keep)
    got: dict[str, list[int]] = {k: [] for k in languages}
    for r in top.select("lang", "gram").collect():
        got[r["lang"]].append(r["gram"])
    return LanguageModel.build({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in got.items()}, languages)


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score, share for each row."""
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    key = source.schema[0].dataType.simpleString()

    def setup() -> Callable[..., list]:
        return lambda keys, texts: [keys, *model.judge(texts)]

    return map_columns(source, f"`{id_col}` {key}, lang_pred string, score double, share double", setup)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, share of every row; learnt from the rows that are not held out."""
    model = train(docs.where(learnable()))
    return predict(docs, model).select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score", "share")


#: In the pipeline, documents go of whose n-grams the best language holds less than this share, and those without a letter.
LEAST_SHARE = 0.5


def keep_identified(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` whose text has letters and a share of ``least`` or more, with all columns."""
    model = train(docs.where(learnable()))
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                names, _, shares = model.judge(part.column(at).to_pylist())
                yield part.filter(pa.array([k != "und" and s >= least for k, s in zip(names, shares)], pa.bool_()))

    return docs.mapInArrow(run, schema)
