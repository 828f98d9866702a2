import gzip
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from trawlnet.operators import crawl as cr
from trawlnet.operators import pages as P
from trawlnet.sources import http
from trawlnet.sources import store as S
from trawlnet.sources.http import HttpSource
from trawlnet.streaming import frontier as fs


def test_docid_list_and_store(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 http://a/\n 2\thttp://b/ \nbad\n1 http://c/\n")
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"<p>"))
    listed = S.read_docid_list(spark, str(tmp_path / "l.txt"))
    assert sorted(map(tuple, listed.collect())) == [(1, "http://a/"), (1, "http://c/"), (2, "http://b/")]
    numbered = listed.withColumn("row", F.col("url"))
    assert S.last_urls(numbered, "row").where("doc_id = 1").first().url == "http://c/"
    assert bytes(S.read_gzip_pages(spark, str(tmp_path / "p.gz")).first().content) == b"<p>"
    pages = spark.createDataFrame([(1, "u", "<title>t &amp;</title>"), (2, "v", ""), (3, "w", "x")], "doc_id long, url string, html string")
    S.write_store(S.build_store(pages, listed), str(tmp_path / "store"))
    kept = S.read_store(spark, str(tmp_path / "store"))
    assert [r.doc_id for r in kept.collect()] == [1] and S.page_metadata(kept).first().title == "t &amp;"


def test_page_processing(spark):
    page = b"<base href='http://h/x/'><meta name=robots content=index><a href='../y?q'>1</a><a href='/y#z'>2</a><a href=https://s/>3</a><title>\xe7</title>"
    rows = [("http://h/", 200, "text/html; charset=latin-1", page), ("http://h/p", 200, "image/png", b""), ("http://h/q", 404, None, page)]
    out = P.process_pages(spark.createDataFrame(rows, "url string, status int, content_type string, content binary"))
    r = out.first()
    assert out.count() == 1 and (r.title, r.encoding, r.follow, len(r.links)) == ("ç", "latin-1", True, 3)
    assert [x.target for x in P.resolved_links(out).collect()] == ["http://h/y"]
    item = P.render_results(spark.createDataFrame([(1, "http://a/?x&y", "<b>", 0.5)], "doc_id long, url string, title string, score double")).first().item
    assert item == '<li><a href="http://a/?x&amp;y">&lt;b&gt;</a> 0.5</li>'


class FakeSource(HttpSource):
    @staticmethod
    def get(url):
        if "bad" in url:
            raise OSError
        return 200, "text/html", url.encode()

    @classmethod
    def name(cls):
        return "fake_http"


def test_http_source(spark):
    spark.dataSource.register(FakeSource)
    out = spark.read.format("fake_http").option("urls", "http://a/ http://bad/").option("per_task", "1").load().collect()
    assert sorted((r.url, r.status) for r in out) == [("http://a/", 200), ("http://bad/", 0)]


def test_long_bodies_are_cut_and_say_so(spark, monkeypatch):
    monkeypatch.setattr(http, "MAX_BYTES", 10)
    for n, cut in ((0, False), (10, False), (11, True)):
        row = http.answer("http://a/", lambda url: (200, "text/html", b"x" * n))
        assert row[3:] == (b"x" * min(n, 10), cut)
    rows = http.fetched(spark.createDataFrame([("http://a/",), ("http://bad/",)], "url string"), FakeSource.get).collect()
    assert sorted((r.url, r.status, r.truncated) for r in rows) == [("http://a/", 200, False), ("http://bad/", 0, False)]


SITE = {
    "http://a.x/robots.txt": "User-agent: *\nDisallow: /no\n", "http://a.x/": "<title>home</title><a href=/1>1</a><a href=/no/2>2</a><a href='http://b.x/'>b</a><a href=https://s.x/>s</a>",
    "http://a.x/1": "<a href=/>home</a><a href=/3#top>3</a>", "http://a.x/3": "<meta name=robots content=nofollow><a href=/4>4</a>", "http://b.x/": "<a href='http://c.y/'>c</a><a href='http://a.x/1'>1</a>",
}


def get_page(url):
    if url not in SITE:
        raise OSError(url)
    return 200, "text/plain" if url.endswith(".txt") else "text/html", SITE[url].encode()


def test_crawl_rounds(spark, tmp_path):
    crawl, now, asked = cr.Crawl.of(spark, ["http://a.x/", "http://a.x/"]), 1000, []
    for _ in range(6):
        asked.append(sorted(r.url for r in cr.requests(crawl, now).collect()))
        assert all(r.host in ("a.x", "b.x") for r in cr.requests(crawl, now).collect())
        crawl = cr.crawl_round(crawl, now, str(tmp_path), get_page, suffix=".x")
        assert cr.requests(crawl, now + 29).where("host = 'a.x'").count() == 0  # politeness
        now += 30
    assert asked == [["http://a.x/robots.txt"], ["http://a.x/"], ["http://a.x/1", "http://b.x/robots.txt"], ["http://a.x/3", "http://b.x/"], [], []]
    pages = spark.read.parquet(str(tmp_path / "pages"))
    assert sorted(r.url for r in pages.collect()) == sorted(u for u in SITE if not u.endswith(".txt"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 6 and log.where("status = 'DOWN'").count() == 5
    assert sorted(map(tuple, crawl.frontier.select("host", "path").collect())) == [("a.x", "/no/2")]
    assert cr.requests(cr.Crawl.of(spark, ["http://a.x/", "http://b.x/1", "http://b.x/2"]), 0, k=1).first().host == "b.x"


class FakeState(dict):
    """The calls of a map, value or timer state that the host's queue makes."""

    exists = lambda self: "v" in self
    get = lambda self: self["v"]
    update = lambda self, v: self.__setitem__("v", v)
    containsKey = dict.__contains__
    updateValue = dict.__setitem__
    getValue = dict.__getitem__
    removeKey = dict.pop

    def __init__(self):
        self.timers = []

    getMapState = getValueState = lambda self, *a: FakeState()
    registerTimer = lambda self, at: self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.getCurrentProcessingTimeInMs = lambda: now


def test_frontier_steps():
    host, handle = fs.HostQueue(), FakeState()
    host.init(handle)
    rows = lambda *paths: iter([Row(host="h", path=p) for p in paths])
    assert [tuple(r) for r in host.handleInputRows(("h",), rows("/a", "/b", "/a"), Clock(1000))] == [("h", "/robots.txt", 3, 1000)]
    assert handle.timers == [31_000]
    assert list(host.handleInputRows(("h",), rows("/a", "/robots.txt"), Clock(30_999))) == []
    assert [r.path for r in host.handleExpiredTimer(("h",), Clock(31_000), None)] == ["/a"]
    assert [r.path for r in host.handleInputRows(("h",), rows("/c"), Clock(61_000))] == ["/b"]
    assert [(r.path, r.queue_len) for r in host.handleExpiredTimer(("h",), Clock(91_000), None)] == [("/c", 1)]
    assert list(host.handleExpiredTimer(("h",), Clock(121_000), None)) == [] and handle.timers[-1] == 91_000


def test_frontier_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "/1"), ("a", "/2"), ("b", "/1")], "host string, path string").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.conf.set(*fs.STATE_STORE)
    seen = []
    try:
        stream = spark.readStream.schema("host string, path string").parquet(str(tmp_path / "in/*"))
        sink = fs.frontier_stream(stream).writeStream.foreachBatch(lambda batch, _: seen.extend((r.host, r.path, r.queue_len) for r in fs.in_priority(batch).collect()))
        q = sink.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        until = time.time() + 60
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.2)
        q.stop()  # timers would wake it again
    finally:
        spark.conf.unset(fs.STATE_STORE[0])
    assert seen == [("a", "/robots.txt", 3), ("b", "/robots.txt", 2)]
