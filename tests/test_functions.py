"""Golden cases of URLs, HTML, entities, the byte-wise code, charsets and robots files."""

import gzip

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawlnet.functions import html as H
from trawlnet.functions import raw as R
from trawlnet.functions import text as T
from trawlnet.functions import urls as U


@pytest.mark.parametrize(
    "a,b",
    [
        ("http://shop.example:80/~kim/list", "http://SHOP.example/%7Ekim/list"), ("http://shop.example/~kim/", "http://Shop.Example:/%7ekim/"),
        ("http://news.example.:80/", "HTTP://NEWS.example"), ("http://h.example", "http://h.example:80/"), ("http://h.example/%7Eü 1%42", "http://h.example/~%C3%BC%201B"),
    ],
)
def test_equal_urls(a, b):
    assert U.parse(a) == U.parse(b)


def test_url_parts_and_rejects():
    assert U.parse("http://kim:secret@box:8181/a/b?c=d#e") == ("http", "kim:secret", "box", "8181", "/a/b", "c=d", "e")
    assert U.parse("http://box/a") != U.parse("http://box/a/")
    for bad in ("GOPHER://box/", "data: text", "http://a box:80/", "http://[box]/x.png", "http://böx.example/", "http://box:eighty/", "http://box:80 1/", "http://box/%G1"):
        with pytest.raises(U.InvalidURL):
            U.parse(bad)
    assert str(U.strip(U.parse("http://any one@box.example/?a=b#c"))) == "http://box.example/"


@given(st.lists(st.binary(max_size=40), max_size=20))
def test_fingerprints_of_many_are_those_of_each(raws):
    assert U.fnv1_64_all(raws).tolist() == [U.fnv1_64(x) for x in raws]


def test_fingerprint_of_a_known_string():
    # fixed values: the offset and a published value of FNV-1 with 64 bits
    assert U.fnv1_64(b"") == 0xCBF29CE484222325 and U.fnv1_64(b"foobar") == 0x340D8765A4DDA9C2


def test_paths_and_percent():
    for a, b in {"./.././/x/y/../z": "/x/z", "/p/q/./r/../../s": "/p/s", "one/two/.././three": "one/three", "one/two///../three": "one/three"}.items():
        assert U.remove_dots(a) == b
    assert U.fix_percent("%78%79%2F%7e ä%e4%3f") == "xy%2F~%20%C3%A4%E4%3F" and U.fix_percent("%2D") == "-"


# fixed values: references and targets of RFC 3986, section 5.4
RFC = {
    "g": "g", "./g": "g", "g/": "g/", "/g": "/g", "?y": "d;p?y", "g?y": "g?y", "#s": "d;p?q#s", "g#s": "g#s", "g?y#s": "g?y#s", ";x": ";x", "g;x": "g;x", "g;x?y#s": "g;x?y#s", "": "d;p?q",
    ".": "", "./": "", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../": "/", "../../g": "/g", "../../../g": "/g", "../../../../g": "/g", "/./g": "/g", "/../g": "/g",
    "g.": "g.", ".g": ".g", "g..": "g..", "..g": "..g", "./../g": "/b/g", "./g/.": "g/", "g/./h": "g/h", "g/../h": "h", "g;x=1/./y": "g;x=1/y", "g;x=1/../y": "y", "g?y/./x": "g?y/./x", "g#s/../x": "g#s/../x",
}


def test_resolution():
    base = U.parse("http://a/b/c/d;p?q")
    for ref, want in RFC.items():
        full = f"http://a{want}" if want.startswith("/") else f"http://a/b/c/{want}"
        assert str(U.resolve(base, U.parse(ref))) == full, ref
    assert str(U.resolve(base, U.parse("//g"))) == "http://g/" and str(U.resolve(U.parse("http://a/b/c"), U.parse("/"))) == "http://a/"


@given(st.text(alphabet="/.ab", max_size=12))
def test_dot_removal_is_idempotent(path):
    once = U.remove_dots("/" + path)
    assert U.remove_dots(once) == once


def told(html):
    return [(e.kind, e.name, e.attrs) if e.attrs else (e.kind, e.name) for e in H.events(html)]


@pytest.mark.parametrize(
    "html,want",
    [
        ("1 <> 2", [("text", "1 <> 2")]), ("u<i>v", [("text", "u"), ("tag", "i"), ("text", "v")]), ("<img src=/pics/1/>", [("tag", "img", {"src": "/pics/1/"})]),
        ("~<td ROW=\"1 2\" col='3 4' span=5 nowrap />~", [("text", "~"), ("tag", "td", {"row": "1 2", "col": "3 4", "span": "5", "nowrap": ""}), ("endtag", "td"), ("text", "~")]),
        ("u<i", [("text", "u"), ("text", "<i")]), ("u<i id=", [("text", "u"), ("text", "<i id=")]), ("u<i id=v w", [("text", "u"), ("text", "<i id=v w")]),
        ("<q cite='1>0'>u</q and more>", [("tag", "q", {"cite": "1>0"}), ("text", "u"), ("endtag", "q")]),
        ("u<?php echo?><!-- <p> -->v", [("text", "u"), ("pi", "php", {"echo": ""}), ("comment", " <p> "), ("text", "v")]),
        ("<style>p<b></i></STYLE><hr>", [("tag", "style"), ("endtag", "style"), ("tag", "hr")]), ("<textarea/><hr>", [("tag", "textarea"), ("endtag", "textarea"), ("tag", "hr")]),
        ("u</", [("text", "u"), ("text", "</")]), ("u<", [("text", "u<")]), ("u<!-- v", [("text", "u"), ("text", "<!-- v")]), ("<style>u", [("tag", "style")]),
    ],
)
def test_events(html, want):
    assert told(html) == want


def test_links_and_robots():
    page = "<base href='/top/'><base target=x><a href=1>u</a><link href='2'><iframe src=3></iframe><area href=4><a href=1><script><a href=5></script><!-- <a href=6> -->"
    out = H.extract_links(page)
    assert (out["links"], out["base"]) == (["1", "2", "3", "4"], "/top/")
    flags = lambda s: (lambda o: (o["index"], o["follow"]))(H.extract_links(f"<meta content='{s}' name=Robots>"))
    assert flags("none,all") == (True, True) and flags(" all , NOINDEX") == (False, True) and flags("noindex,nofollow,follow") == (False, True)


@pytest.mark.parametrize(
    "raw,want",
    [("&gt;", ">"), ("1&lt;2&amp;3", "1<2&3"), ("&uuml;&#xFC;&#252;", "üüü"), ("&uuml&uuml;", "üü"), ("&gt &gt", "> >"), ("&#252Wort", "üWort"), ("&", "&"), ("&nosuchname;", "&nosuchname;"), ("&gtfoo", "&gtfoo")],
)
def test_entities(raw, want):
    assert H.decode_entities(raw) == want


def test_byte_code():
    # fixed values: a number's code, which files of lists hold
    assert R.encode(1044) == bytes([147, 7])
    numbers = [1, 128, 129, 16512, 16513, 77, 2**40]
    assert R.decode_all(b"".join(map(R.encode, numbers))) == numbers
    postings = [(3, 9), (4, 1), (400, 70_000), (2**33, 2)]
    assert R.decompress_postings(R.compress_postings(postings)) == postings and R.decompress_postings(b"") == [] and R.compress_postings([]) == b""


@given(st.lists(st.integers(1, 2**62)))
def test_byte_code_of_arrays_is_that_of_each(numbers):
    raw = b"".join(map(R.encode, numbers))
    assert R.encode_all(np.array(numbers, dtype=np.uint64)) == raw and R.decode_array(raw).tolist() == numbers
    assert R.decode_array(raw + b"\xff").tolist() == numbers


@given(st.lists(st.integers(1, 2**32 - 1)))
def test_byte_code_round_trip(numbers):
    assert R.decode_all(b"".join(map(R.encode, numbers))) == numbers


def test_charsets():
    assert R.to_utf8(b"\x61\xe7\xe3\x6f") == ("ação", "latin-1") and R.to_utf8("ação".encode()) == ("ação", "utf-8")
    assert R.to_utf8("﻿a".encode("utf-16-le")) == ("a", "utf-16-le") and R.to_utf8(b"\xef\xbb\xbfab")[0] == "ab"
    assert R.to_utf8(b"<meta charset=windows-1252>\x80") == ("<meta charset=windows-1252>€", "windows-1252")


def test_robots():
    text = "User-agent: *\nUser-agent: bot\nAllow: /open # why\nDisallow: /shut\nDisallow: no-slash\n\nUser-agent: other\nDisallow: /\n"
    assert R.parse_robots(text) == [("/open", True), ("/shut", False)]
    assert R.parse_robots("user-agent: *\r\ndisallow: /a/b/\rDisallow: /c") == [("/a/b/", False), ("/c", False)]


def test_columns(spark):
    df = spark.createDataFrame([("text/html;charset=ISO-8859-1", " \t a b,c,d ", 258)], "ct string, s string, id long")
    r = df.select(T.charset_of(F.col("ct")).alias("c"), T.strip(F.col("s")).alias("s"), T.split_max(F.col("s"), ",", 1).alias("p"), T.docid_path(F.col("id"), "st").alias("d"), R.gunzip(F.lit(gzip.compress(b"zz"))).alias("z"), R.gunzip(F.lit(b"no")).alias("n")).first()
    assert (r.c, r.s, r.p, r.d, bytes(r.z), r.n) == ("iso-8859-1", "a b,c,d", [" \t a b", "c,d "], "st/00/00/01/02/data.gz", b"zz", None)
    n = spark.createDataFrame([("AçãO",), ("acao",)], "t string").select(T.normalize_term("t").alias("t")).distinct().collect()
    assert [x.t for x in n] == ["acao"]


def test_more_functions(spark):
    assert U.decode_query("q=a+b%20c%&q=%C3%A7&x&y=1=2&%ff=z") == {"q": "ç", "x": "", "y": "1=2", "\ufffd": "z"}
    assert U.fnv1_32(b"") == 2166136261 and U.fnv1_32(b"a") == 0x050C5D7E
    assert H.decode_entities("&lt;&aacute;&nope;", H.WORD_ENTITIES) == " á&nope;"
    assert R.to_utf8("ç".encode(), compat=True)[1] == "latin-1" and R.to_utf8(b"<meta charset=utf-8>\xc3\xa7", compat=True)[1] == "latin-1"
    assert R.to_utf8(b"<meta http-equiv='Content-Type' content='text/html; charset=utf-8'>\xc3\xa7", compat=True)[1] == "utf-8"
    codes = [0, 1, 65, 127, 128, 0xE7, 0x7FF, 0x800, 0xD800, 0xFFFD, 0x10000, 0x10FFFF, 0x110000, -1, None]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c long").select("i", T.unichr(F.col("c")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == ["" if c == 0 else None if c is None else chr(c) if 0 < c < 0x110000 and not 0xD800 <= c < 0xE000 else "\ufffd" for c in codes]
    df = spark.createDataFrame([("a<b x=1>c", "/a/../b", "%41%zz", " 12 ", "k=v")], "h string, p string, q string, n string, g string")
    r = df.select(H.events_of("h").alias("e"), U.without_dots("p").alias("p"), U.percent_fixed("q").alias("q"), T.to_number(F.col("n")).alias("n"), T.to_number(F.col("g")).alias("none"), U.query_pairs("g").alias("g")).first()
    assert [(e.kind, e.name, e.attrs) for e in r.e] == [("text", "a", {}), ("tag", "b", {"x": "1"}), ("text", "c", {})]
    assert (r.p, r.q, r.n, r.none, r.g) == ("/b", None, 12, None, {"k": "v"})


def test_malformed_tags_take_linear_time():
    events = list(H.events("<a b" * 20_000 + ">"))
    assert events and "".join(e.name for e in events if e.kind == "text").startswith("<a b")
