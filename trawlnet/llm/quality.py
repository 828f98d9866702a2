"""Quality classifier (operator 1): regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of ``STATISTICS``, transformed so that good texts scatter about evenly. For each of two
classes the mean and covariance are sums over labelled rows, gathered in one aggregation. Covariances shrink towards a scaled identity and towards the pooled covariance. A text's score is the posterior of
class 1, from the difference of the two Gaussian log-densities; Mahalanobis distances use Cholesky factors computed
once for each model. The model learns from ``SAMPLE`` labelled rows of a class at most, in expectation: those whose
hashed id falls under a threshold set by the class's count. Their ids are broadcast, which that number bounds.

Defined results: null text counts as empty, and the empty text has its vector like any other; words are split at ASCII
white space; a label given more than once for a document counts once if its values agree and not at all if they
differ; null labels are ignored; repeated rows each give a row; without labelled rows of both classes every score is
the share of class 1 among labels, or 0.5; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.llm.langid import learnable
from trawlnet.plans.arrow import map_columns, pieces

#: Labelled rows of a class that are learnt from, in expectation. A documented bound of the training sample.
SAMPLE = 20_000
#: Weight of the pooled covariance in a class covariance; weight of the scaled identity, and what few rows add to it.
SHRINK_POOLED, SHRINK_IDENTITY, SHRINK_FEW = 0.1, 0.001, 0.1
#: A prior count of unremarkable words or characters, so that rates of short texts vary less.
PRIOR = 30.0
#: Score from which a text counts as good.
THRESHOLD = 0.7

_SYMBOLS = "#*$%&|<>!~^=+@\\_{}[]"

STATISTICS = ("length", "word_length", "symbols", "upper", "digits", "top_word", "distinct", "repeats", "same_next", "short", "commas", "stops")


def statistics(text: str | None) -> list[float]:
    """The transformed vector of a text."""
    t = text or ""
    words = t.split()
    n, chars = len(words), sum(map(len, words))
    counts = Counter(words)
    symbols = sum([t.count(c) for c in _SYMBOLS])
    upper = sum(map(str.isupper, words))
    digits = sum([t.count(c) for c in "0123456789"])
    top = max(counts.values(), default=0)
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    single = sum(1 for c in counts.values() if c == 1)
    short = sum([len(w) < 4 for w in words])
    # square roots even out the variance of rates
    rate = lambda k, of: math.sqrt(max(0.0, k) / (of + PRIOR))
    return [
        math.log1p(n),
        math.log((chars + 5 * PRIOR) / (n + PRIOR)),
        rate(symbols, chars),
        rate(upper, n),
        rate(digits, chars),
        rate(top - 1, n),
        math.log((len(counts) + PRIOR) / (n + PRIOR)) / math.log(n + 20),
        rate(n - single, n),
        rate(same, n),
        rate(short, n),
        rate(t.count(","), n),
        rate(t.count("."), n),
    ]


@dataclass
class QualityModel:
    """By class: mean, Cholesky factor of the covariance, log-determinant half and log-prior, over scaled vectors."""

    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    share: float

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> QualityModel:
        """``moments``: for classes 0 and 1 the count, the sum of vectors and the sum of their outer products."""
        n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        total = n[0] + n[1]
        share = n[1] / total if total else 0.5
        d = len(STATISTICS)
        if not n[0] or not n[1]:
            return cls(np.ones(d), [], [], [], share)
        mean = {k: moments[k][1] / n[k] for k in n}
        cov = {k: moments[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in n}
        pooled = (cov[0] * n[0] + cov[1] * n[1]) / total
        between = n[0] * n[1] / total**2 * np.outer(mean[0] - mean[1], mean[0] - mean[1])
        scale = np.sqrt(np.maximum(np.diag(pooled + between), 1e-8))
        factors, offsets = [], []
        for k in (0, 1):
            c = ((1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled) / np.outer(scale, scale)
            a = SHRINK_IDENTITY + SHRINK_FEW * d / (d + n[k])
            c = (1 - a) * c + a * max(np.trace(c) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(c)
            factors.append(factor)
            offsets.append(math.log(n[k] / total) - float(np.log(np.diag(factor)).sum()))
        return cls(scale, [mean[k] / scale for k in (0, 1)], factors, offsets, share)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(vectors), self.share)
        x = (vectors / self.scale).T
        density = [o - 0.5 * (np.linalg.solve(f, x - m[:, None]) ** 2).sum(axis=0) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Learn from the learnable rows of ``docs`` that ``labels`` marks 0 or 1."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL").where(learnable("id"))
    marked = marked.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y")
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return QualityModel.fit({k: (n, np.zeros(len(STATISTICS)), np.zeros((len(STATISTICS),) * 2)) for k, n in counts.items()})
    share = F.when(F.col("y") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = F.broadcast(marked.where(draw < share))  # bounded by 2 * sample
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("y", "text")

    vectors = map_columns(rows, "y int, v array<double>", lambda: lambda ys, texts: [ys, [statistics(t) for t in texts]])
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    v = F.col("v")
    sums = [F.sum(v[i]).alias(f"s{i}") for i in range(d)] + [F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in pairs]
    moments = {}
    for r in vectors.groupBy("y").agg(F.count("*").alias("n"), *sums).collect():
        outer = np.zeros((d, d))
        for i, j in pairs:
            outer[i, j] = outer[j, i] = r[f"p{i}_{j}"]
        moments[r["y"]] = float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), outer
    return QualityModel.fit(moments)


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score for each row."""
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    key = source.schema[0].dataType.simpleString()

    def setup() -> Callable[..., list]:
        return lambda keys, texts: [keys, model.of_texts(texts).tolist()]

    return map_columns(source, f"`{id_col}` {key}, score double", setup)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    return score(docs, model).select(
        "doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with all columns."""
    model = train(docs, labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array(model.of_texts(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
