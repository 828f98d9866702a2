from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as c
from tests.llm.test_simhash import brute_print, brute_roots
from trawlnet.llm import langid, quality


def test_run_matches_stage_by_stage_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.collect()
    model = langid.train(docs.where(langid.learnable()))
    names, _, shares = model.judge([r.text for r in rows])
    rows = [r for r, n, s in zip(rows, names, shares) if n != "und" and s >= langid.LEAST_SHARE]
    q = quality.train(spark.createDataFrame(rows, docs.schema), spark.read.parquet(f"{d}/labels.parquet"))
    rows = [r for r, s in zip(rows, q.of_texts([r.text for r in rows])) if s >= quality.THRESHOLD]
    roots = brute_roots([brute_print(r.text) for r in rows])
    least = {}
    for r, k in zip(rows, roots):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    out = c.run(spark, d).collect()
    assert {r.doc_id for r in out} == set(least.values()) and len(rows) > 100


def test_stages_keep_columns_and_take_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 AS fp", "2 AS score")
    for name, f in c.STAGES:
        assert name == "best_fit_packing" or f(spark, docs, d).columns == docs.columns, name
        assert f(spark, docs.limit(0), d).count() == 0, name


def odd_documents(spark, d):
    """The documents, with nulls in every column, empty and long texts, copies, repeated rows and ids, and ties."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = docs.where("lang = 'en' AND length(text) > 800").orderBy("doc_id").first().text
    rows = [(None,) * 5, (-1, None, "en", "s", None), (-2, "", None, None, 0), (-3, " \n\t", "de", "s", 3), (-4, "12 !?", "en", "s", 5), (-5, text * 40, "en", "s", 1), (None, text, "en", "s", 1)]
    rows += [(-6, text, "en", "s", 1)] * 2 + [(-7, text, "fr", "t", 2), (-8, text + " end", "en", "s", 1)]
    return docs, docs.unionByName(spark.createDataFrame(rows, docs.schema)), text


def test_stages_on_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    docs, odd, text = odd_documents(spark, d)
    stages = dict(c.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)

    kept = stages["language_id"](spark, odd, d)
    assert kept.columns == odd.columns and set(ids(kept)).isdisjoint({-1, -2, -3, -4})
    # repeated rows stay, and so do a row without an id and all clean documents
    assert ids(kept).count(-6) == 2 and ids(kept).count(None) == 1 and {-5, -7, -8} < set(ids(kept))
    assert set(ids(stages["language_id"](spark, docs, d))) <= set(ids(kept))

    good = stages["quality_classifier"](spark, odd, d)
    assert good.columns == odd.columns and ids(good).count(-6) in (0, 2) and (-6 in ids(good)) == (-7 in ids(good))

    one = ids(stages["simhash_dedup"](spark, odd, d))
    same = [r.doc_id for r in odd.collect() if r.doc_id is not None and r.text in (text, text + " end")]
    assert [i for i in one if i in same] == [min(same)] == [-8] and one.count(None) == 2  # rows without an id are never dropped
    empty = [i for i in one if i in (-1, -2, -3)]
    assert empty == [-3]  # no words: one fingerprint, and the smallest id stays

    placed = stages["best_fit_packing"](spark, odd, d)
    got = Counter(r.doc_id for r in placed.where("piece = 0").collect())
    assert got == Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_on_odd_rows_and_on_no_rows(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    _, odd, _ = odd_documents(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    odd.write.parquet(str(tmp_path / "a/documents.parquet"))
    labels.write.parquet(str(tmp_path / "a/labels.parquet"))
    out = {r.doc_id for r in c.run(spark, str(tmp_path / "a")).collect()}
    assert out and out.isdisjoint({-1, -2, -3, -4, -6, -7})
    odd.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "b/labels.parquet"))
    assert c.run(spark, str(tmp_path / "b")).count() == 0
