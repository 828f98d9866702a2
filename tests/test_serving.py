import threading
import urllib.error
import urllib.request

import pytest

from trawlnet.operators import index as ix
from trawlnet.serving import Search, server


@pytest.fixture(scope="module")
def search(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "a.css").write_text("x")
    docs = spark.createDataFrame([(1, "hot soup"), (2, "hot hot tea"), (3, "cold")], "doc_id long, text string")
    meta = spark.createDataFrame([(1, "http://a/", "<soup>"), (2, "http://b/", "")], "doc_id long, url string, title string")
    store = spark.createDataFrame([(1, "<p>1")], "doc_id long, html string")
    ranks = spark.createDataFrame([(1, 9.0)], "doc_id long, pagerank double")
    index = ix.Index(docs)
    return Search(index, meta, store, ranks, str(folder)), Search(index, meta)


def test_answers(search):
    ranked, plain = search
    status, _, body = ranked.answer("/?q=Hot%21")
    assert status == 200 and body.decode().index("&lt;soup&gt;") < body.decode().index("http://b/")
    assert b"<ol>" not in plain.answer("/?q=")[2] and b"<li>" in plain.answer("/?q=hot")[2] and b"<li>" not in plain.answer("/?q=zzz")[2]
    assert ranked.answer("/cache/1")[2] == b"<p>1" and ranked.answer("/source/a.css")[1:] == ("text/css", b"x")
    codes = [ranked.answer(p)[0] for p in ("/cache/7", "/cache/x", "/cache", "/nothing", "/source/../a", "/source/%2e%2e/%2e%2e/etc/passwd")]
    assert codes == [404, 400, 400, 404, 404, 404] and plain.answer("/cache/1")[0] == 404


def test_server(search):
    s = server(search[1], 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"
    with urllib.request.urlopen(f"{base}/?q=tea", timeout=60) as r:
        assert r.status == 200 and b"http://b/" in r.read()
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/x", timeout=60)
    s.shutdown()
    s.server_close()
