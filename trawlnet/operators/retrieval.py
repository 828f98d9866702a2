"""Boolean and ranked retrieval over an index (see ``index``).

Query terms are literals: their filter reaches the scan of the postings, and everything after it works on the terms'
own postings. A boolean query is one grouped pass whatever its operators.
"""

from __future__ import annotations

from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.text import ACCENTED, PLAIN, TOKEN
from trawlnet.operators.index import Index, StoredIndex


class UnknownTermError(ValueError):
    """A boolean query names a term that no document has."""


def _normal(words: list[str]) -> list[str]:
    return [w.lower().translate(str.maketrans(ACCENTED, PLAIN)) for w in words]


def _words(query: str, strict: bool) -> list[str]:
    """The query's words: what single spaces separate, or, if not ``strict``, its tokens as those of texts."""
    return query.split(" ") if strict else regex.findall(TOKEN, query)


def parse_boolean(query: str, default_op: str = "AND", strict: bool = True) -> list[tuple[str, str]]:
    """(operator, word) from left to right. Operators stay in force until the next; a leading one is a word."""
    op, out = default_op, []
    for word in _words(query, strict):
        if out and word in ("AND", "OR"):
            op = word
        else:
            out.append((op, word))
    return out


def boolean_query(index: Index | StoredIndex, query: str, default_op: str = "AND", strict: bool = True) -> DataFrame:
    """RT1, SET1-3: doc_id of the documents that match, strictly from left to right."""
    steps = parse_boolean(query, default_op, strict)
    if not steps:
        raise UnknownTermError("")
    words = _normal([w for _, w in steps])
    terms = sorted(set(words))
    hits = index.postings.where(F.col("term").isin(terms))
    known = {r["term"] for r in index.frequencies.where(F.col("term").isin(terms)).select("term").collect()}
    if missing := [w for w in words if w not in known]:
        raise UnknownTermError(missing[0])
    flags = hits.groupBy("doc_id").agg(*[F.max(F.when(F.col("term") == t, 1).otherwise(0)).alias(f"_t{i}") for i, t in enumerate(terms)])
    has = {t: F.col(f"_t{i}") == 1 for i, t in enumerate(terms)}
    match = has[words[0]]
    for (op, _), w in zip(steps[1:], words[1:]):
        match = match & has[w] if op == "AND" else match | has[w]
    return flags.where(match).select("doc_id")


def vector_query(index: Index | StoredIndex, query: str, k: int | None = None, strict: bool = True) -> DataFrame:
    """RT2, SO3: doc_id, weight of documents with every term; a term that none has gives no rows, nor does a query
    without a word."""
    times = Counter(_normal(_words(query, strict) or [""]))
    q = F.create_map(*[F.lit(x) for t, n in times.items() for x in (t, n)])
    wanted = F.col("term").isin(list(times))
    idf = F.log(F.lit(float(index.n_docs)) / F.col("df"))
    rows = index.postings.where(wanted).join(index.frequencies.where(wanted), "term")
    acc = rows.groupBy("doc_id").agg(F.sum(q[F.col("term")] * F.col("freq") * idf).alias("acc"), F.count("*").alias("n"))
    matched = acc.where(F.col("n") == len(times)).join(index.norms, "doc_id")
    out = matched.select("doc_id", F.coalesce(F.try_divide(F.col("acc"), F.col("max_freq") * F.col("wd")), F.lit(0.0)).alias("weight"))
    return out.orderBy(F.desc("weight"), "doc_id").limit(k) if k is not None else out


def combine(results: DataFrame, ranks: DataFrame, weight: float = 0.6) -> DataFrame:
    """RT3, GR6, JN5: doc_id, pagerank, similarity, score. The two maxima are one row, joined to all."""
    rows = results.join(ranks, "doc_id", "left").select("doc_id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.col("weight").alias("similarity"))
    top = rows.agg(F.max("pagerank").alias("_p"), F.max("similarity").alias("_s"))
    share = lambda x, of: F.coalesce(F.try_divide(F.col(x), F.col(of)), F.lit(0.0))
    score = weight * share("pagerank", "_p") + (1 - weight) * share("similarity", "_s")
    return rows.join(F.broadcast(top)).select("doc_id", "pagerank", "similarity", score.alias("score"))


def ranked(results: DataFrame, score: str = "score", k: int | None = None) -> DataFrame:
    """SO4: results by falling ``score``, ties by document; the first ``k``, if given."""
    out = results.orderBy(F.desc(score), "doc_id")
    return out.limit(k) if k is not None else out


def with_metadata(results: DataFrame, meta: DataFrame) -> DataFrame:
    """RT4, JN6: results with url and title, empty where unknown."""
    out = results.join(meta.select("doc_id", "url", "title"), "doc_id", "left")
    return out.withColumn("url", F.coalesce("url", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))


def cached_page(store: DataFrame, doc_id: int) -> DataFrame:
    """RT5: the stored row of one document; the filter reaches the scan."""
    return store.where(F.col("doc_id") == doc_id)
