"""Retrieval and ranking on tiny collections, worked out by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trawlnet.operators import frontier as fr
from trawlnet.operators import graph as gr
from trawlnet.operators import index as ix
from trawlnet.operators import retrieval as rt

DOCS = {1: "Pease porridge hot, pease porridge cold", 2: "pease porridge in the pot", 4: "some like it HOT some like it cold", 7: ""}


@pytest.fixture(scope="module")
def index(spark):
    return ix.Index(spark.createDataFrame(list(DOCS.items()), "doc_id long, text string"))


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_boolean_session(index):
    assert ids(rt.boolean_query(index, "porridge")) == [1, 2] and ids(rt.boolean_query(index, "hot")) == [1, 4]
    assert ids(rt.boolean_query(index, "hot AND porridge")) == [1] and ids(rt.boolean_query(index, "hot OR porridge")) == [1, 2, 4]
    assert ids(rt.boolean_query(index, "hot OR pot the")) == [1, 2, 4] and ids(rt.boolean_query(index, "hot OR pot AND cold")) == [1, 4]
    with pytest.raises(rt.UnknownTermError):
        rt.boolean_query(index, "hot OR  pot")


def test_vector_weights(index):
    words = {d: [w.strip(",").lower() for w in t.split()] for d, t in DOCS.items()}
    df = {w: sum(w in ws for ws in words.values()) for ws in words.values() for w in ws}
    idf = {w: math.log(len(DOCS) / n) for w, n in df.items()}
    got = {r.doc_id: r.weight for r in rt.vector_query(index, "hot cold Hot").collect()}
    assert sorted(got) == [1, 4]
    for d in got:
        norm = math.sqrt(sum((words[d].count(w) * idf[w]) ** 2 for w in set(words[d])))
        assert math.isclose(got[d], (2 * words[d].count("hot") * idf["hot"] + words[d].count("cold") * idf["cold"]) / norm)
    assert rt.vector_query(index, "hot zzz").count() == 0 and len(rt.vector_query(index, "hot", k=1).collect()) == 1


def test_dense_ids_and_offsets(spark, index):
    terms = sorted(r.term for r in index.frequencies.collect())
    assert [r.term for r in ix.vocabulary(index.postings).orderBy("term_id").collect()] == terms
    rows = ix.header_offsets(index.postings).orderBy("term").collect()
    at = 0
    for r in rows:
        assert r.pos == at
        at += r.bytes


def test_pagerank_matches_brute_force(spark):
    rnd = random.Random(1)
    nodes = list(range(12))
    edges = [(rnd.choice(nodes[:9]), rnd.choice(nodes)) for _ in range(30)] + [(0, 0), (0, 99), (3, 4), (3, 4)]
    valid = {(a, b) for a, b in edges if b in nodes}
    deg = {a: sum(x == a for x, _ in valid) for a, _ in valid}
    rank = dict.fromkeys(nodes, 1.0)
    while True:
        new = {v: 0.15 + 0.85 * sum(rank[a] / deg[a] for a, b in valid if b == v) for v in nodes}
        off = sum(abs(new[v] - rank[v]) for v in nodes)
        rank = new
        if off <= 1e-3:
            break
    n = spark.createDataFrame([(x,) for x in nodes], "id long")
    links = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.rank for r in gr.pagerank(n, links).collect()}
    assert all(math.isclose(got[v], rank[v], abs_tol=1e-9) for v in nodes)
    out = spark.createDataFrame([(1, 99), (1, 98), (2, 3), (2, 99), (3, 2)], "src long, dst long")
    some = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    pruned = {r.id: round(r.rank, 2) for r in gr.pagerank(some, out, prune_dangling=True).collect()}
    assert pruned == {1: 0.15, 2: 1.0, 3: 1.0, 4: 0.15}


def test_frontier(spark):
    links = [("http://A.br/x", 1), ("http://a.br/x?q", 2), ("http://a.br/y", 0), ("http://b.br/", 3), ("http://c.com/", 4), ("http://d.br/z", 5)]
    rows = spark.createDataFrame(links, "url string, seq long")
    known = spark.createDataFrame([("d.br", "/z")], "host string, path string")
    q = fr.host_queues(fr.frontier_add(rows, known, ".br"))
    assert [(r.host, r.queue_len, r.next_path) for r in fr.frontier_pop(q).collect()] == [("a.br", 2, "/y"), ("b.br", 1, "/")]
    assert [r.host for r in fr.frontier_pop(q, F.lit(2), "bf").collect()] == ["a.br"]


def test_blocks_change_nothing(spark):
    rnd = random.Random(2)
    rows = [(t, d, rnd.randint(1, 300)) for t, share in (("hot", 0.9), ("rare", 0.05)) for d in range(400) if rnd.random() < share]
    postings = spark.createDataFrame(rows, "term string, doc_id long, freq long")
    last, want = {}, []
    for t, d, n in rows:
        want.append((t, d, n, d - last.get(t, 0)))
        last[t] = d
    got = ix.gaps(postings, 7)
    assert sorted(map(tuple, got.select("term", "doc_id", "freq", "gap").collect())) == sorted(want)
    place, placed = {}, []
    for t, d, n, gap in want:
        place[t] = place.get(t, 0) + 1
        placed.append((t, place[t], n, gap))
    back = ix.ungap(spark.createDataFrame(placed, "term string, pos long, freq long, gap long"), 7)
    assert sorted(map(tuple, back.select("term", "doc_id", "freq").collect())) == sorted(rows)
    assert sorted(map(tuple, ix.decoded_lists(ix.coded_lists(postings, 16), 16).select("term", "doc_id", "freq").collect())) == sorted(rows)
    assert ix.gaps(postings.limit(0)).count() == 0 and ix.coded_lists(postings.limit(0)).count() == 0


def test_stored_index(spark, index, tmp_path):
    ix.write_index(index.postings, str(tmp_path / "i"), index.n_docs)
    stored = ix.StoredIndex(spark, str(tmp_path / "i"))
    rows = lambda i: sorted((r.doc_id, round(r.weight, 9)) for r in rt.vector_query(i, "hot cold").collect())
    assert rows(stored) == rows(index) and ids(rt.boolean_query(stored, "hot OR porridge")) == [1, 2, 4]
    assert sorted(r.term_id for r in stored.frequencies.collect()) == list(range(index.frequencies.count()))
    urls = spark.createDataFrame([("b",), ("a",), ("c",)], "url string")
    assert sorted(map(tuple, ix.assign_ids(urls, "url", start=10).collect())) == [("a", 10), ("b", 11), ("c", 12)]


def test_tokenised_queries(index):
    assert ids(rt.boolean_query(index, "hot,  OR pot!", strict=False)) == [1, 2, 4]
    assert ids(rt.vector_query(index, "(Hot)  cold?", strict=False)) == [1, 4] and rt.vector_query(index, "...", strict=False).count() == 0
    with pytest.raises(rt.UnknownTermError):
        rt.boolean_query(index, "!", strict=False)


def test_restart_and_counters(spark):
    listed = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/y"), (3, "http://b/")], "doc_id long, url string")
    known, left = fr.pending(listed, spark.createDataFrame([(2,)], "doc_id long"))
    assert sorted(map(tuple, known.collect())) == [("a", "/x"), ("a", "/y"), ("b", "/")]
    assert sorted(map(tuple, left.collect())) == [("a", "/x", 1), ("b", "/", 3)]
    log = fr.log_rows(spark.createDataFrame([(1, "u", True), (2, "v", False)], "doc_id long, url string, downloaded boolean"), F.lit(0).cast("timestamp"))
    r = fr.crawl_counters(log, fr.host_queues(left), F.lit(1)).first()
    assert (r.seen, r.crawled, r.downloaded, r.hosts, r.queued, r.active, r.idle) == (2, 2, 1, 2, 2, 1, 1)
    empty = fr.crawl_counters(log.limit(0), fr.host_queues(left.limit(0))).first()
    assert (empty.seen, empty.hosts, empty.queued, empty.idle) == (0, 0, 0, 0)
    assert fr.error_rows(spark.createDataFrame([(1, "u", None)], "doc_id long, url string, msg string")).first().msg == ""


def test_all_links_are_resolved(spark):
    import re
    from urllib.parse import quote, urldefrag, urljoin

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = entry.queries()["all_resolved_links"](spark, d).collect()
    links = {(i, link) for i, r in pages.items() for link in re.findall('<a href="([^"]*)"', r.html)}
    assert len(rows) == len(links) and {(r.page_id, r.link) for r in rows} == links
    for r in rows:
        full = quote(urldefrag(urljoin(pages[r.page_id].url, r.link))[0], safe="/:?&=%,;+")
        http = pages[r.page_id].url.startswith("http://") and full.startswith("http://")
        assert r.target == (full if http else None), r


def test_pagerank_with_hubs_cut_in_parts(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(a, b) for a in range(30) for b in range(30) if rnd.random() < (0.9 if a < 3 else 0.1)]
    n, links = spark.range(30), spark.createDataFrame(edges, "src long, dst long")
    ranks = lambda: {r.id: r.rank for r in gr.pagerank(n, links, tol=-1.0, max_iter=4).collect()}
    want = ranks()
    monkeypatch.setattr(gr, "HUB", 5)
    got = ranks()
    assert set(got) == set(want) == set(range(30)) and all(math.isclose(got[v], want[v]) for v in want)
    steps = {r.id: r["rank"] for r in gr.pagerank_steps(n.select("id"), links, 4)[-1].collect()}
    assert all(math.isclose(steps[v], want[v]) for v in want)


def test_pagerank_keeps_its_tables_in_buckets(spark):
    """An iteration shuffles votes only: neither shares nor ranks are dealt again."""
    from trawlnet.plans.shared import materialise_bucketed

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shares = materialise_bucketed(spark.range(100).selectExpr("id % 10 AS src", "id AS dst", "10L AS n"), "shares", "src", parts)
        ranks = materialise_bucketed(spark.range(100).selectExpr("id", "1.0D AS rank"), "ranks", "id", parts)
        plan = gr.pagerank_step(shares, ranks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(dst" in plan


def test_stored_index_is_in_ranges(spark, index, tmp_path):
    """A filter on a term reaches the scan, and files hold ranges of terms, so all but one can be skipped."""
    import pyarrow.parquet as pq

    ix.write_index(index.postings, str(tmp_path / "i"), index.n_docs)
    for name, key in (("lists", "term"), ("vocabulary", "term"), ("norms", "doc_id")):
        spans = []
        for f in (tmp_path / "i" / name).glob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(key)
            spans += [(g.column(at).statistics.min, g.column(at).statistics.max) for g in map(meta.row_group, range(meta.num_row_groups)) if g.num_rows]
        spans.sort()
        assert spans and all(a[1] <= b[0] for a, b in zip(spans, spans[1:])), name
    plan = ix.StoredIndex(spark, str(tmp_path / "i")).postings.where("term = 'hot'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,hot)" in plan


@pytest.mark.parametrize("name", ["page_text_tokens", "page_text_decoded"])
def test_page_text_with_cut_entities_equals_its_sql(spark, tmp_path, name):
    """An entity that a tag cuts before its semicolon is a word in the one query, and decoded in the other."""
    import duckdb

    import __spark_entry__ as entry

    pages = [(1, "<title>Ly.&amp;&amp;&amp; and&amp</title><p>x&am</p>&a b&quo; c&quot"), (2, "&copy;y&middot;z &copy&amp;copy; &ampx"), (3, None), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select("doc_id", "term", "freq").collect()]
    assert sorted(got) == sorted(want) and ((1, "amp", 1) in got) == (name == "page_text_tokens")


def test_pagerank_runs_to_its_residual_in_few_jobs(spark, monkeypatch):
    """Over 100 iterations where the residual asks for them, and many iterations a job; blocks, chunks and ids of text."""
    rnd = random.Random(5)
    nodes = [f"n{x}" for x in range(25)]
    edges = [(f"n{min(rnd.randrange(20), rnd.randrange(20))}", f"n{rnd.randrange(30)}") for _ in range(90)] + [("x", "n1"), ("n1", "n1"), ("n2", "n3"), ("n2", "n3")]
    valid = {(a, b) for a, b in edges if a in nodes and b in nodes}
    deg = {a: sum(x == a for x, _ in valid) for a, _ in valid}
    edges += [("n20", "n21"), ("n21", "n20")]
    valid |= {("n20", "n21"), ("n21", "n20")}
    deg |= {"n20": 1 + deg.get("n20", 0), "n21": 1 + deg.get("n21", 0)}
    rank, k = dict.fromkeys(nodes, 1.0), 0
    while k == 0 or off > 1e-9:
        new = {v: 0.15 + 0.85 * sum(rank[a] / deg[a] for a, b in valid if b == v) for v in nodes}
        off, rank, k = sum(abs(new[v] - rank[v]) for v in nodes), new, k + 1
    assert k > 100
    monkeypatch.setattr(gr, "LEAST_ROWS", 30)
    monkeypatch.setattr(gr, "HUB", 7)
    n, links = spark.createDataFrame([(x,) for x in nodes + nodes[:3]], "id string"), spark.createDataFrame(edges, "src string, dst string")
    spark.sparkContext.setJobGroup("ranks", "")
    try:
        got = {r.id: r["rank"] for r in gr.pagerank(n, links, tol=1e-9).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ranks")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == set(nodes) and all(math.isclose(got[v], rank[v], abs_tol=1e-11) for v in nodes) and 0 < len(jobs) < k
    with pytest.raises(ValueError):
        gr.pagerank(n, links, tol=0.0)
    assert {r.id: r["rank"] for r in gr.pagerank(n, links.limit(0)).collect()} == pytest.approx(dict.fromkeys(nodes, 0.15))
    assert gr.pagerank(n.limit(0), links).count() == 0
