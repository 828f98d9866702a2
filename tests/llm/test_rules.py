import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trawlnet.llm import rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_match_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", "\n \t\x0b", "a b c d e", "a b c d e a b c d e", "x " * 400, "é\x85中 \xa0 b\x1cc", "# a\n# a\n\n# a\r\n|<>&$%*"]
    texts += ["".join(rnd.choices(["a ", "b ", "c ", "a b c d e ", "\n", "## ", "É"], k=rnd.randrange(80))) for _ in range(60)]
    texts.append(" ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=30_000)))
    rows = [(i, t, rnd.choice(["en", None, "de"]), rnd.choice(["s", None]), 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, "q", None, None, 2)], "doc_id long, text string, lang string, source string, n_words int")
    out = rules.judge(df).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        text = "q" if r.doc_id is None else texts[r.doc_id]
        assert tuple(r[n] for n in NAMES) == brute(text), text
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.distance2 <= rules.CUTOFF)
    assert rules.judge(df.limit(0)).count() == 0


def brute_mcd(x, share):
    """Concentration to convergence from the same starts, with exact quantiles and numpy's linear algebra."""
    mid = np.median(x, axis=0)
    z = np.abs(x - mid) / (1.4826 * np.median(np.abs(x - mid), axis=0) + rules.FLOOR)
    best = None
    for q in ((z**2).sum(1), z.max(1)):
        for _ in range(100):
            near = x[q <= np.quantile(q, share, method="inverted_cdf")]
            mean = near.mean(0)
            cov = rules.consistency(share, x.shape[1]) * np.cov(near.T, bias=True) + rules.FLOOR**2 * np.eye(x.shape[1])
            q = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best[1:]


def test_estimates_match_brute_force_and_withstand_outliers(spark):
    rng = np.random.default_rng(2)
    groups = {}
    for g, n in (("a", 600), ("b", 300)):
        x = rng.normal(0, 1, (n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]) + 3
        x[: n // 5] += 25
        groups[g] = x
    df = spark.createDataFrame([(g, "p", *map(float, r)) for g, x in groups.items() for r in x], "g string, p string, x0 double, x1 double, x2 double")
    out = {r.g: r for r in rules.robust_estimates(df, 3, shrink=0.0).collect()}
    for g, x in groups.items():
        mean, cov = brute_mcd(x, rules.SHARE)
        r = out[g]
        assert r.n == len(x) and np.allclose([r.m0, r.m1, r.m2], mean, atol=0.02) and np.allclose(mean, 3, atol=0.6)
        w = np.array([[r[f"w{i}_{j}"] if j <= i else 0.0 for j in range(3)] for i in range(3)])
        assert np.allclose(w.T @ w, np.linalg.inv(cov), rtol=0.05, atol=0.02)


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = rules.judge(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_marked_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = rules.judge(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.quality: r.k for r in out.collect()}
    assert share[1] > 0.98 and share[0] < 0.2


def test_windows_of_equal_hashes_are_compared_by_their_words(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices("abcdefgh", k=rnd.randrange(5, 400))) for _ in range(80)] + [" ".join(map(str, range(300))), "a " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (31, 60, 62):  # 33, 4 and 2 bits of the hash
        monkeypatch.setattr(rules, "PLACE_BITS", bits)
        for r in rules.text_counts(df, keep=()).collect():
            assert r.n_repeat_words == brute(texts[r.doc_id])[4], (bits, texts[r.doc_id])


def brute_shrunk(groups, share, shrink):
    """As ``brute_mcd`` with means and covariances averaged with those of the language and of all rows, by definition."""
    d = next(iter(groups.values())).shape[1]
    spread = {}
    for g, x in groups.items():
        mid = np.median(x, axis=0)
        spread[g] = np.abs(x - mid) / (1.4826 * np.median(np.abs(x - mid), axis=0) + rules.FLOOR)
    ended = []
    for start in range(2):
        q = {g: (z**2).sum(1) if start == 0 else z.max(1) for g, z in spread.items()}
        for _ in range(60):
            near = {g: x[q[g] <= np.quantile(q[g], share, method="inverted_cdf")] for g, x in groups.items()}
            moments = lambda x: (len(x), x.mean(0), rules.consistency(share, d) * np.cov(x.T, bias=True).reshape(d, d) + rules.FLOOR**2 * np.eye(d))
            mix = lambda own, wide: ((own[0] * own[1] + shrink * wide[1]) / (own[0] + shrink), (own[0] * own[2] + shrink * wide[2]) / (own[0] + shrink))
            all_rows = moments(np.vstack(list(near.values())))
            by_lang = {p: (0, *mix(moments(np.vstack([x for g, x in near.items() if g[0] == p])), all_rows)) for p in {g[0] for g in groups}}
            est = {g: mix(moments(x), by_lang[g[0]]) for g, x in near.items()}
            q = {g: np.einsum("ij,jk,ik->i", x - est[g][0], np.linalg.inv(est[g][1]), x - est[g][0]) for g, x in groups.items()}
        ended.append(est)
    return {g: min((e[g] for e in ended), key=lambda e: np.linalg.slogdet(e[1])[1]) for g in groups}


def test_small_groups_lean_on_their_language(spark):
    rng = np.random.default_rng(5)
    mix = np.array([[1, 0.4], [0, 1]])
    groups = {g: rng.normal(0, 1, (n, 2)) @ mix + at for g, n, at in (("e1", 400, 0), ("e2", 40, 1), ("e3", 3, 2), ("d1", 120, 9), ("d2", 1, 9))}
    df = spark.createDataFrame([(g, g[0], *map(float, r)) for g, x in groups.items() for r in x], "g string, p string, x0 double, x1 double")
    want = brute_shrunk(groups, rules.SHARE, rules.SHRINK)
    out = {r.g: r for r in rules.robust_estimates(df, 2).collect()}
    assert set(out) == set(groups)
    for g, (mean, cov) in want.items():
        r = out[g]
        w = np.array([[r.w0_0, 0.0], [r.w1_0, r.w1_1]])
        assert np.allclose([r.m0, r.m1], mean, atol=0.05) and np.allclose(w.T @ w, np.linalg.inv(cov), rtol=0.1, atol=0.03), g
    assert np.linalg.norm(want["e3"][0] - want["e1"][0]) < 0.5 < np.linalg.norm(groups["e3"].mean(0) - want["e1"][0])


def test_cutoff_is_the_tail_of_a_gaussian():
    assert abs(rules.tail_cutoff(2, 0.01) + 2 * np.log(0.01)) < 1e-9 and abs(rules.tail_cutoff(4, 0.05) - 9.487729) < 1e-5
