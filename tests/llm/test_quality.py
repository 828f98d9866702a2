import random
import zlib

import numpy as np
import pytest

from trawlnet.llm import quality as q


def brute(model, x):
    """Log-densities through inverse and determinant instead of cached factors."""
    x = x / model.scale
    out = []
    for m, f, o in zip(model.means, model.factors, model.offsets):
        c = f @ f.T
        prior = o + np.log(np.diag(f)).sum()
        out.append(prior - 0.5 * np.log(np.linalg.det(c)) - 0.5 * (x - m) @ np.linalg.inv(c) @ (x - m))
    return 1 / (1 + np.exp(-(out[1] - out[0])))


def test_scores_are_posteriors_of_the_two_gaussians():
    rng = np.random.default_rng(1)
    d = len(q.STATISTICS)
    sets = {0: rng.normal(0.4, 1.1, (400, d)), 1: rng.normal(0, 1, (900, d))}
    model = q.QualityModel.fit({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in sets.items()})
    x = rng.normal(0.2, 1, (50, d))
    assert np.allclose(model.scores(x), [brute(model, r) for r in x], atol=1e-9)
    mean = model.means[1] * model.scale
    assert np.allclose(mean, sets[1].mean(0))


def test_no_scatter_and_missing_classes():
    d = len(q.STATISTICS)
    one = np.ones(d)
    same = q.QualityModel.fit({0: (3.0, 3 * one, 3 * np.outer(one, one)), 1: (3.0, 6 * one, 12 * np.outer(one, one))})
    assert np.isfinite(same.scores(np.array([one, 2 * one]))).all() and same.scores(2 * one[None])[0] > 0.5 > same.scores(one[None])[0]
    assert q.QualityModel.fit({}).scores(np.zeros((2, d))).tolist() == [0.5, 0.5]


def test_statistics_of_edges():
    for t in (None, "", " \n", "a", "x " * 200_000, "　"):
        v = q.statistics(t)
        assert len(v) == len(q.STATISTICS) and np.isfinite(v).all()


def brute_statistics(text):
    """Each statistic by its definition, from lists of words and characters."""
    words = (text or "").split()
    chars = [c for w in words for c in w]
    n, m, p = len(words), len(chars), q.PRIOR
    times = {w: words.count(w) for w in words}
    root = lambda k, of: np.sqrt(max(0, k) / (of + p))
    among = lambda of: sum(c in of for c in text or "")
    return [
        np.log(1 + n), np.log((m + 5 * p) / (n + p)), root(among("#*$%&|<>!~^=+@\\_{}[]"), m), root(sum(w.isupper() for w in words), n), root(among("0123456789"), m),
        root(max(times.values(), default=0) - 1, n), np.log((len(times) + p) / (n + p)) / np.log(n + 20), root(sum(times[w] > 1 for w in words) if n else 0, n),
        root(sum(a == b for a, b in zip(words, words[1:])), n), root(sum(len(w) <= 3 for w in words), n), root(among(","), n), root(among("."), n),
    ]


def test_statistics_and_moments_match_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", "A a A a, B.", "x9 x9 x9 $$ [y] _z_ ÉÀ É"] + [" ".join(rnd.choices(["the", "The", "THE", "of,", "42", "end.", "#*", "ñandú"], k=rnd.randrange(60))) for _ in range(60)]
    for t in texts:
        got, want = q.statistics(t), brute_statistics(t)
        got[7], want[7] = [0, 0] if not (t or "").split() else [got[7], want[7]]
        assert np.allclose(got, want), t
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(len(texts))], "doc_id long, quality int")
    taken = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    vectors = {k: np.array([q.statistics(texts[i]) for i in taken if i % 3 % 2 == k]) for k in (0, 1)}
    want = q.QualityModel.fit({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in vectors.items()})
    model = q.train(docs, labels)
    assert np.allclose(model.scale, want.scale) and np.allclose(model.means, want.means) and np.allclose(model.factors, want.factors) and np.allclose(model.offsets, want.offsets)


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = {r.doc_id: r for r in q.classify_quality(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [(out[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in out and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and all(r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r, _ in held)
    assert sum(r.predicted == y for r, y in held) >= 0.97 * len(held)
    clean = [r for r, y in held if y]
    assert sum(r.predicted for r in clean) >= 0.98 * len(clean)


def test_rows(spark, tables):
    docs, labels = tables
    extra = spark.createDataFrame([(None, None, "x"), (-5, "", "y"), (-5, "", "y")], "doc_id long, text string, score string")
    odd = docs.select("doc_id", "text", docs.lang.alias("score")).unionByName(extra)
    marks = labels.unionByName(labels.limit(50)).unionByName(spark.createDataFrame([(None, 1, 0), (-5, None, 0)], labels.schema))
    out = q.classify_quality(odd, marks)
    assert out.count() == docs.count() + 3
    again = [r.score for r in out.where("doc_id = -5").collect()]
    assert len(again) == 2 and again[0] == again[1]
    assert q.classify_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in q.classify_quality(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()
