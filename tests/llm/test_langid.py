import zlib
from collections import Counter

import numpy as np
import pytest

from trawlnet.llm import langid


def exact_model(samples):
    grams = {k: np.unique(langid.gram_keys(np.concatenate([langid.code_points(t) for t in v]))[0]) for k, v in samples.items()}
    return langid.LanguageModel.build(grams, list(samples)), grams


SAMPLES = {"en": ["the thing is that you of and with"], "es": ["que las ción del mente y los"], "de": ["der und nicht schön für das"]}


def test_filter_has_every_gram_and_counts_match_brute_force():
    model, grams = exact_model(SAMPLES)
    texts = ["that thing, the 42 und", "ción QUE las", None, "", "123 !!", "x"]
    hits, total, lettered = model.counts(texts)
    for t, h, n in zip(texts, hits, total):
        keys = langid.gram_keys(langid.code_points(t or ""))[0]
        assert n == len(keys)
        for i, k in enumerate(SAMPLES):
            exact = np.isin(keys, grams[k]).sum()
            assert exact <= h[i] <= exact + 1
    assert lettered.tolist() == [True, True, False, False, False, True]
    assert model.predict(texts)[0] == ["en", "es", "und", "und", "und", "en"]


def test_long_texts_in_blocks_count_as_whole(monkeypatch):
    model, _ = exact_model(SAMPLES)
    text = "the thing is that nicht schön que las ción " * 40
    whole = model.counts([text])
    texts = [text, "x", None, "", "12", "Ab" * 100, "ΑΣ ΣΑΣ " * 30, "İstanbul ẞ" * 20, " " * 300, "a\ud800b" * 50]
    whole = model.counts(texts)
    for block in (1, 2, 3, 5, 32, 64, 240):
        monkeypatch.setattr(langid, "BLOCK", block)
        for a, b in zip(whole, model.counts(texts)):
            assert (a == b).all(), block


def brute_grams(text):
    """N-grams by definition: windows whose inner characters are letters; others are gaps, at either end only."""
    x = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    return Counter(x[i : i + n] for n in langid.LENGTHS for i in range(len(x) - n + 1) if "\0" not in x[i + 1 : i + n - 1])


def test_learnt_ngrams_match_brute_force(spark, monkeypatch):
    rows = [(i, t, k) for k, v in SAMPLES.items() for i, t in enumerate(v[0].split())] + [(9, "the " * 500 + "end", "en"), (10, None, "en"), (11, "12 !", "de"), (12, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    code = lambda g: int(langid.gram_keys(np.array([0 if c == "\0" else ord(c) for c in g], dtype=np.uint32))[0].view(np.int64)[-1])
    for block in (langid.BLOCK, 7):
        monkeypatch.setattr(langid, "BLOCK", block)
        for keep in (4, None):
            built = {}
            monkeypatch.setattr(langid.LanguageModel, "build", classmethod(lambda cls, grams, names: built.update(grams) or (names, grams)))
            names, _ = langid.train(docs, keep=keep)
            assert names[0] == "en"
            for k in SAMPLES:
                want = sum((brute_grams(t) for _, t, own in rows if own == k and t), Counter())
                best = sorted(want, key=lambda g: (-want[g], code(g)))[:keep]
                assert sorted(map(code, best)) == sorted(built[k].view(np.int64).tolist()), (block, keep, k)


def test_share_tells_texts_of_no_learnt_language():
    model, _ = exact_model({**SAMPLES, "en": ["the thing is that you of and with a man in his house near the river said to them"]})
    names, scores, shares = model.judge(["the man is in his house", "これは日本語のテキストです", "zupełnie inny język którego", None])
    assert names[0] == "en" and shares[0] > 0.9 and max(shares[1:]) < langid.LEAST_SHARE and (names[3], shares[3]) == ("und", 0.0)


def test_more_languages_than_bits_of_a_word():
    samples = {f"l{i:03}": [chr(0x100 + 3 * i) * 3 + chr(0x101 + 3 * i) * 3] for i in range(130)}
    model, _ = exact_model(samples)
    names, _ = model.predict([v[0] for v in samples.values()])
    assert model.table.shape[0] == 3 and sum(a == b for a, b in zip(names, samples)) >= 125


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(small):
    out = {(r.doc_id): r for r in langid.language_id(small).collect()}
    assert len(out) == small.count()
    right = n = 0
    for r in small.select("doc_id", "lang").collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert out[r.doc_id].held_out == held and 0 <= out[r.doc_id].score <= 1
        if held:
            n += 1
            right += out[r.doc_id].lang_pred == r.lang
    assert n > 200 and right / n > 0.98


def test_rows(spark, small):
    rows = [(1, "that the thing", "en", 5), (1, "that the thing", "en", 5), (2, None, "en", 6), (3, "", None, 7), (None, "12", "de", 8), (5, "und der nicht", "de", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    out = langid.language_id(df).collect()
    assert [(r.doc_id, r.lang_pred) for r in out if r.doc_id != 5] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (None, "und")]
    assert langid.language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_id(df.where("lang IS NULL")).collect()} == {"und"}
    kept = langid.keep_identified(small)
    assert kept.columns == small.columns and kept.count() >= 0.99 * small.count()
