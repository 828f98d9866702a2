"""Queries that put every rule of URLs, HTML, charsets and strings to work on inputs made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.functions import html as H
from trawlnet.functions import raw as R
from trawlnet.functions import text as T
from trawlnet.functions import urls as U
from trawlnet.operators import crawl as cr
from trawlnet.operators import frontier as fr
from trawlnet.operators import graph as gr
from trawlnet.operators import index as ix
from trawlnet.operators import pages as pg
from trawlnet.operators import retrieval as rt
from trawlnet.plans.shared import new_path
from trawlnet.plans.spread import spread
from trawlnet.plans.tables import table
from trawlnet.registry import _FRONTIER, _GRAPH, _HOST, _PATH, _RANKS, P, _graph, _index, _part_ranks, _postings, _vector, query
from trawlnet.sources import store as S

BOTH = ("http", "https")


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(rows: list[tuple], names: str) -> str:
    shown = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") t({names})"


def _filled(template: str, **of: str) -> F.Column:
    """A template with its marks (``{host}``) replaced by columns."""
    out = F.col(template)
    for mark, column in of.items():
        out = F.replace(out, F.lit("{" + mark + "}"), F.col(column))
    return out


def _filled_sql(template: str, **of: str) -> str:
    for mark, column in of.items():
        template = f"replace({template}, '{{{mark}}}', {column})"
    return template


_HOSTS = f"hosts AS (SELECT DISTINCT {_HOST.format('url')} AS host FROM pages)"


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(T.host_of(F.col("url")).alias("host")).distinct()


# fixed values: URLs and their normal forms (null: no valid http URL)
_URLS = [
    (1, "HTTP://User:Pw@{HOST}.:80/a", "http://User:Pw@{host}/a"), (2, "http://{host}:/x/../y/./z", "http://{host}/y/z"), (3, "http://{host}//a//b/..//c", "http://{host}/a/c"),
    (4, "http://{host}/%7eu/%2f%c3%A9", "http://{host}/~u/%2F%C3%A9"), (5, "http://{host}/a b/é?q=ü v", "http://{host}/a%20b/%C3%A9?q=%C3%BC%20v"), (6, "http://{host}", "http://{host}/"),
    (7, "http://{host}:8080", "http://{host}:8080/"), (8, "http://{host}/a%4", "http://{host}/a%4"), (9, "http://{host}/a%zzb", None), (10, "https://{host}/", None),
    (11, "ftp://{host}/", None), (12, "javascript:go('{host}')", None), (13, "http://{host} x/", None), (14, "http://{host}:8a/", None), (15, "http:///{host}", None),
    (16, "http://{host}/../../up", "http://{host}/up"), (17, "http://{host}/x?a=/../b#/../c", "http://{host}/x?a=/../b#/../c"), (18, "mailto:a@{host}", None), (19, "http://{host}/%41%2e%2D", "http://{host}/A.-"),
]


@query(f"WITH {_HOSTS} SELECT host, k, replace(want, '{{host}}', host) AS normal FROM hosts, {_sql(_URLS, 'k, url, want')}")
def urls_normalised(spark, d):
    """URL1-URL5, URL7, FLT10: valid URLs in one form, others null."""
    rows = _hosts(spark, d).join(F.broadcast(_values(spark, _URLS, "k int, raw string, want string"))).withColumn("HOST_", F.upper("host"))
    return rows.select("host", "k", U.normalize_url(_filled("raw", host="host", HOST="HOST_")).alias("normal"))


@query(
    f"WITH {_HOSTS} SELECT host, 'http' AS scheme, 'u:p' AS userinfo, '81' AS port, '/p/q' AS path, 'a=1&b' AS query, 'f' AS fragment, true AS equal, 'http://' || host || ':81/p/q' AS stripped FROM hosts"
)
def url_parts(spark, d):
    """URL1, URL8, URL9: the seven parts; equal URLs have equal parts."""
    a, b = "http://u:p@{0}:81/p/x/../q?a=1&b#f", "HTTP://u:p@{0}.:81/p/./q?a=1&b#f"
    of = lambda t: U.parse_http_url(F.concat(*[F.lit(x) if i % 2 == 0 else F.col("host") for i, x in enumerate(t.replace("{0}", "\0\0").split("\0"))]))
    rows = _hosts(spark, d).select("host", of(a).alias("u"), of(b).alias("v"))
    parts = [F.col("u")[x].alias(x) for x in ("scheme", "userinfo", "port", "path", "query", "fragment")]
    stripped = F.concat(F.col("u.scheme"), F.lit("://"), F.col("u.host"), F.lit(":"), F.col("u.port"), F.col("u.path")).alias("stripped")
    return rows.select("host", *parts, (F.col("u") == F.col("v")).alias("equal"), stripped)


# fixed values: references and what they resolve to against /b/c/d;p?q, after RFC 3986, section 5.4
_REFS = [
    ("g", "/b/c/g"), ("./g", "/b/c/g"), ("g/", "/b/c/g/"), ("/g", "/g"), ("?y", "/b/c/d;p?y"), ("g?y#s", "/b/c/g?y#s"), ("#s", "/b/c/d;p?q#s"), ("", "/b/c/d;p?q"), (".", "/b/c/"),
    ("..", "/b/"), ("../g", "/b/g"), ("../..", "/"), ("../../../g", "/g"), ("/./g", "/g"), ("g.", "/b/c/g."), ("..g", "/b/c/..g"), ("./g/.", "/b/c/g/"), ("g/../h", "/b/c/h"),
    ("g;x=1/../y", "/b/c/y"), ("g?y/../x", "/b/c/g?y/../x"), ("https://s/", None), ("mailto:x", None), ("a b/é", "/b/c/a%20b/%C3%A9"),
]


@query(f"WITH {_HOSTS} SELECT host, ref, 'http://' || host || want AS target FROM hosts, {_sql(_REFS, 'ref, want')}")
def references_resolved(spark, d):
    """URL6: RFC 3986, section 5.2."""
    rows = _hosts(spark, d).join(F.broadcast(_values(spark, _REFS, "ref string, want string")))
    return rows.select("host", "ref", U.resolve_url(F.concat(F.lit("http://"), F.col("host"), F.lit("/b/c/d;p?q")), F.col("ref")).alias("target"))


_FNV_BYTES = "list_transform(range(1, 2 * octet_length(encode({0})), 2), lambda i: (16 * (instr('0123456789ABCDEF', substr(hex(encode({0})), CAST(i AS INT), 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode({0})), CAST(i + 1 AS INT), 1)) - 1)::UHUGEINT)"
_FNV_STEP = "lambda h, b: xor((h * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, CASE WHEN b < 128 THEN b ELSE b + 18446744073709551360::UHUGEINT END)"


def _fnv(text: str) -> str:
    h = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, {_FNV_BYTES.format(text)}), {_FNV_STEP})"
    return f"(SELECT CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS BIGINT) FROM (SELECT {h} AS h))"


@query(f"SELECT page_id, {_fnv('url')} AS fp, {_fnv('concat(url, chr(233), page_id)')} AS accented FROM pages")
def url_fingerprints(spark, d):
    """URL11: of plain bytes, and of bytes from 128 on."""
    return table(spark, d, "pages").select("page_id", U.fingerprint(F.col("url")).alias("fp"), U.fingerprint(F.concat("url", F.lit("é"), "page_id")).alias("accented"))


_ENCODED = "replace(replace(url_encode({0}), '%2F', '/'), '%2C', ',')"
_TARGETS = (
    "WITH links AS (SELECT DISTINCT page_id, regexp_replace(url, '[?#].*$', '') AS src, regexp_extract(url, '^https?://[^/?#]*', 0) AS site, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS link FROM pages), "
    f"edges AS (SELECT DISTINCT site || {_ENCODED.format('link')} AS dst, regexp_replace(url, '#.*$', '') AS src FROM links JOIN pages USING (page_id))"
)


@query(f"SELECT page_id, {_fnv('url')} AS fp FROM pages")
def fnv_fingerprints(spark, d):
    """URL11."""
    return table(spark, d, "pages").select("page_id", U.fingerprint(F.col("url")).alias("fp"))


@query(
    "WITH links AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS link FROM pages WHERE starts_with(url, 'http://')), "
    f"edges AS (SELECT DISTINCT url AS src, regexp_extract(url, '^http://[^/?#]*', 0) || {_ENCODED.format('link')} AS dst FROM links) SELECT DISTINCT {_fnv('src')} AS src, {_fnv('dst')} AS dst FROM edges"
)
def link_graph(spark, d):
    """GR1: source and target fingerprints of stripped links of http pages, distinct."""
    return gr.page_edges(spread(table(spark, d, "pages").select("url", "html")))


@query(
    f"SELECT page_id, link, CASE WHEN starts_with(url, 'http://') THEN regexp_extract(url, '^http://[^/?#]*', 0) || {_ENCODED.format('link')} END AS target "
    "FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)"
)
def all_resolved_links(spark, d):
    """URL6: every link of every page; a target is null where the page or the link has a scheme other than http."""
    rows = table(spark, d, "pages").select("page_id", "url", F.explode(H.links_of(F.col("html"))["links"]).alias("link"))
    return rows.select("page_id", "link", U.resolve_url(F.col("url"), F.col("link"), stripped=True).alias("target"))


@query(_TARGETS + f" SELECT src, dst, {_fnv('src')} AS src_fp, {_fnv('dst')} AS dst_fp FROM edges")
def page_graph(spark, d):
    """GR1, HTML9, AG12, with both schemes: edges between URLs, and their fingerprints as the link graph has them."""
    pages = spread(table(spark, d, "pages").select("url", "html"))
    parsed = pages.select(F.regexp_replace(U.normalize_url(F.col("url"), BOTH), "#.*$", "").alias("url"), H.links_of(F.col("html")).alias("p"))
    urls = pg.resolved_links(parsed.select("url", "p.base", "p.links"), BOTH).select(F.col("url").alias("src"), F.col("target").alias("dst"))
    named = urls.select("src", "dst", U.fingerprint(F.col("src")).alias("src_fp"), U.fingerprint(F.col("dst")).alias("dst_fp"))
    clean = pages.withColumn("url", F.regexp_replace("url", "#.*$", ""))
    edges = gr.page_edges(clean, BOTH).withColumnsRenamed({"src": "src_fp", "dst": "dst_fp"})
    return named.join(edges, ["src_fp", "dst_fp"]).select("src", "dst", "src_fp", "dst_fp")


_LISTED = ", listed AS (SELECT url, max(doc_id) AS doc_id FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url, 2 * page_id AS doc_id FROM pages UNION ALL SELECT dst, 2 * ascii(substr(dst, 9, 1)) + 1 FROM edges) GROUP BY 1), "
_IDS = "ids AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM (SELECT DISTINCT regexp_replace(src, '[?#].*$', '') AS src, dst FROM edges) e JOIN listed a ON e.src = a.url JOIN listed b ON e.dst = b.url)"


def _listed_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A collection of pages and some link targets, several with one id, and its edges by id."""
    pages = spread(table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), "html"))
    edges = gr.page_edges(pages, BOTH)
    parsed = pages.select("url", H.links_of(F.col("html")).alias("p"))
    targets = pg.resolved_links(parsed.select("url", "p.base", "p.links"), BOTH).select((2 * F.ascii(F.substring("target", 9, 1)) + 1).cast("long").alias("doc_id"), F.col("target").alias("url"))
    listed = pages.select((2 * F.col("page_id")).alias("doc_id"), "url").union(targets)
    documents = gr.documents_of(listed, BOTH)
    return documents, gr.edges_by_document(edges, documents)


@query(_TARGETS + _LISTED + _IDS + " SELECT src, dst FROM ids")
def document_graph(spark, d):
    """GR2, JN10: fingerprints of both ends as documents of the collection."""
    return _listed_graph(spark, d)[1]


def _rank_steps(k: int) -> str:
    one = "r{1} AS (SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.rank / n), 0) AS rank FROM nodes v LEFT JOIN ids e ON e.dst = v.id LEFT JOIN deg ON deg.src = e.src LEFT JOIN r{0} r ON r.id = e.src GROUP BY v.id)"
    start = ", nodes AS (SELECT DISTINCT doc_id AS id FROM listed), deg AS (SELECT src, count(*) AS n FROM ids GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM nodes), "
    return start + ", ".join(one.format(i, i + 1) for i in range(k))


@query(_TARGETS + _LISTED + _IDS + _rank_steps(4) + " SELECT id AS doc_id, round(rank, 6) AS pagerank FROM r4")
def page_ranks_stored(spark, d):
    """GR3, GR4, SNK9, SRC11: ranks of pages from their own links, written and read again."""
    documents, edges = _listed_graph(spark, d)
    path = new_path(spark, "ranks")
    S.write_ranks(gr.pagerank(documents.select(F.col("doc_id").alias("id")), edges, tol=-1.0, max_iter=4), path)
    return S.read_ranks(spark, path).withColumn("pagerank", F.round("pagerank", 6))


# fixed values: texts with entities, and decoded (ENT1), and with letters only (ENT2)
_ENTITIES = [
    (1, "&lt;{id}&gt; &amp;&quot;", '<{id}> &"', " {id}    "), (2, "&eacute;&Eacute&ccedil;{id}", "éÉç{id}", "éÉç{id}"), (4, "&#233;&#xe9; {id}", "éé {id}", "éé {id}"),
    (5, "&nope;&{id}; & &;", "&nope;&{id}; & &;", "&nope;&{id}; & &;"), (6, "&LT;&Ccedil;&copy;{id}", "&LT;Ç©{id}", "&LT;Ç {id}"), (7, "&hearts;&alpha;{id}&Omega;", "♥α{id}Ω", " α{id}Ω"), (8, "&#38;lt;{id}", "&lt;{id}", "&lt;{id}"),
]


@query(f"SELECT doc_id, k, {_filled_sql('a', id='doc_id::VARCHAR')} AS decoded, {_filled_sql('b', id='doc_id::VARCHAR')} AS words FROM documents, {_sql(_ENTITIES, 'k, raw, a, b')}")
def entities_decoded(spark, d):
    """ENT1, ENT2, UX3: named and numeric entities, with and without semicolon; unknown ones stay."""
    rows = table(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("id"))
    rows = rows.join(F.broadcast(_values(spark, _ENTITIES, "k int, raw string, a string, b string")))
    raw = _filled("raw", id="id")
    return rows.select("doc_id", "k", H.decoded(raw).alias("decoded"), H.decoded(raw, H.WORD_ENTITIES).alias("words"))


# fixed values: a page, and its events
_PAGE = "x < {id}<P Class=a b=\"c d\" e='f' g>t<br/><!-- no <i> --></P junk><?xml v=\"1\"?><script><b>{id}</b></SCRIPT><a href=u/v/>&amp;<>{id}<q r"
_EVENTS = [
    (0, "text", "x < {id}", ""), (1, "tag", "p", "b=c d;class=a;e=f;g="), (2, "text", "t", ""), (3, "tag", "br", ""), (4, "endtag", "br", ""), (5, "comment", " no <i> ", ""), (6, "endtag", "p", ""), (7, "pi", "xml", "v=1"),
    (8, "tag", "script", ""), (9, "endtag", "script", ""), (10, "tag", "a", "href=u/v/"), (11, "text", "&amp;<>{id}", ""), (12, "text", "<q r", ""),
]


@query(f"SELECT page_id, pos, kind, {_filled_sql('name', id='page_id::VARCHAR')} AS name, attrs FROM pages, {_sql(_EVENTS, 'pos, kind, name, attrs')}")
def html_recovery(spark, d):
    """HTML1-HTML5, FLT8: events of a page with every kind of tag and error."""
    page = F.replace(F.lit(_PAGE), F.lit("{id}"), F.col("page_id").cast("string"))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(H.events_of(page)).alias("pos", "e"))
    attrs = F.array_join(F.array_sort(F.transform(F.map_entries(F.coalesce("e.attrs", F.create_map().cast("map<string,string>"))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return rows.select("page_id", "pos", F.col("e.kind").alias("kind"), F.col("e.name").alias("name"), attrs.alias("attrs"))


# fixed values: heads of pages, with base, robots flags and links
_HEADS = [
    (1, "<base href=/a/><base href='{id}/'><base target=x>", "{id}/", True, True, ""), (2, "<meta name=ROBOTS content='noindex, follow'>", "", False, True, ""), (3, "<meta name=robots content='none,index'>", "", True, False, ""),
    (4, "<meta name=robots content='nofollow,all'>", "", True, True, ""), (5, "<meta name=other content=none><a href=x{id}>1</a><a href=x{id}>2</a><a name=y><area href=z>", "", True, True, "x{id} z"),
    (6, "<link href=l><frame src=f><iframe src='i{id}'><img src=no><style><a href=no></style>", "", True, True, "l f i{id}"),
]


@query(
    f"SELECT page_id, k, {_filled_sql('base', id='page_id::VARCHAR')} AS base, idx AS indexed, flw AS followed, {_filled_sql('links', id='page_id::VARCHAR')} AS links FROM pages, {_sql(_HEADS, 'k, raw, base, idx, flw, links')}"
)
def heads_and_links(spark, d):
    """HTML9-HTML11, AG13: the last base, robots flags in their order, distinct links of all five elements."""
    rows = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("id"))
    rows = rows.join(F.broadcast(_values(spark, _HEADS, "k int, raw string, base string, idx boolean, flw boolean, links string")))
    rows = rows.select("page_id", "k", H.links_of(_filled("raw", id="id")).alias("p"))
    return rows.select("page_id", "k", "p.base", F.col("p.index").alias("indexed"), F.col("p.follow").alias("followed"), F.array_join("p.links", " ").alias("links"))


# fixed values: by kind of bytes, the encoding that is found
_KINDS = [("utf8", "utf-8"), ("mark", "utf-8"), ("utf16", "utf-16-le"), ("utf16be", "utf-16-be"), ("latin", "latin-1"), ("meta", "iso-8859-1"), ("xml", "iso-8859-1"), ("hint", "iso-8859-1")]


@query(
    f"SELECT doc_id, kind, CASE kind WHEN 'meta' THEN '<meta charset=iso-8859-1>' || w WHEN 'xml' THEN '<?xml encoding=\"iso-8859-1\"?>' || w ELSE w END AS text, encoding "
    f"FROM (SELECT doc_id, 'é' || regexp_replace(text, '[^\\x01-\\x7E\\xA1-\\xFF]', '', 'g') AS w FROM documents), {_sql(_KINDS, 'kind, encoding')}"
)
def charsets_found(spark, d):
    """FN-CS2-FN-CS5: whole texts in other encodings, by marks, declarations, a hint, or none of them."""
    w = F.concat(F.lit("é"), F.regexp_replace("text", r"[^\x01-\x7E\xA1-\xFF]", ""))
    latin = lambda x: F.encode(x, "ISO-8859-1")
    mark = lambda h: F.unhex(F.lit(h))
    kinds = {
        "utf8": w.cast("binary"), "mark": F.concat(mark("EFBBBF"), w.cast("binary")), "utf16": F.concat(mark("FFFE"), F.encode(w, "UTF-16LE")), "utf16be": F.concat(mark("FEFF"), F.encode(w, "UTF-16BE")),
        "latin": latin(w), "meta": latin(F.concat(F.lit("<meta charset=iso-8859-1>"), w)), "xml": latin(F.concat(F.lit('<?xml encoding="iso-8859-1"?>'), w)), "hint": latin(w),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("raw")) for k, v in kinds.items()])).alias("x")
    rows = spread(table(spark, d, "documents")).select("doc_id", each).select("doc_id", "x.kind", "x.raw")
    hint = F.when(F.col("kind") == "hint", T.charset_of(F.lit("text/html; charset=ISO-8859-1"))).otherwise("")
    return rows.select("doc_id", "kind", R.utf8_of(F.col("raw"), hint).alias("u")).select("doc_id", "kind", "u.text", "u.encoding")


@query(
    "SELECT doc_id, source AS stripped, source || ' ' AS lefted, list_extract(string_split(text, ' '), 1) AS head, CASE WHEN contains(text, ' ') THEN substr(text, instr(text, ' ') + 1) END AS rest, "
    "len(string_split(text, '. ')) AS parts, array_to_string(string_split(text, ' '), '-') AS joined, doc_id AS number, NULL::BIGINT AS none, upper(source) AS up, starts_with(text, substr(text, 1, 3)) AS begins, ends_with(text, 'x') AS ends FROM documents"
)
def string_functions(spark, d):
    """FN-ST1, ST2, SP1, JN1, CV1, LC1, LC2, SW1."""
    blank = F.concat(F.lit(" \t\n\u000b\r\f"), F.chr(F.lit(0)))
    padded = F.concat(blank, F.col("source"), F.lit(" "))
    two = T.split_max(F.col("text"), " ", 1)
    return table(spark, d, "documents").select(
        "doc_id", T.strip(padded).alias("stripped"), T.lstrip(padded).alias("lefted"), two[0].alias("head"), F.get(two, F.lit(1)).alias("rest"), F.size(T.split_max(F.col("text"), ". ")).cast("long").alias("parts"),
        T.join(T.split_max(F.col("text"), " "), "-").alias("joined"), T.to_number(F.concat(F.lit(" "), "doc_id", F.lit("\n"))).alias("number"), T.to_number(F.concat("doc_id", F.lit("x"))).alias("none"),
        F.upper(F.lower("source")).alias("up"), F.startswith("text", F.substring("text", 1, 3)).alias("begins"), F.endswith("text", F.lit("x")).alias("ends"),
    )


@query("SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN url || '&again' ELSE url END AS url FROM pages")
def docid_list(spark, d):
    """SRC1, SRC2: a list with blanks, tabs, malformed lines and repeated ids, written as text and read; later lines win."""
    pages = table(spark, d, "pages").select("page_id", "url")
    again = pages.where("page_id % 3 = 0").select("page_id", F.concat("url", F.lit("&again")).alias("url"))
    lines = pages.select(F.lit(0).alias("o"), F.concat(F.lit(" "), "page_id", F.lit("\t"), "url", F.lit(" rest")).alias("value"))
    lines = lines.union(again.select(F.lit(1), F.concat_ws("  ", "page_id", "url"))).union(pages.select(F.lit(2), F.concat_ws(" ", F.lit("none"), "url")))
    path = new_path(spark, "list")
    lines.orderBy("o").select("value").coalesce(1).write.text(path)
    return S.last_urls(S.read_docid_list(spark, path).withColumn("_o", F.col("url").endswith("&again")), "_o")


@query(
    f"SELECT {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, min(page_id) AS seq FROM pages WHERE {_HOST.format('url')} <> '' AND "
    f"({_HOST.format('url')}, {_PATH.format('url')}) NOT IN (SELECT ({_HOST.format('url')}, {_PATH.format('url')}) FROM pages WHERE page_id % 2 = 0) GROUP BY 1, 2"
)
def frontier_unknown(spark, d):
    """ST1, JN11, FLT6: what half of the pages adds to a frontier that knows the other half."""
    links = table(spark, d, "pages").select("url", F.col("page_id").alias("seq"))
    return fr.frontier_add(links, fr.frontier_add(links.where("seq % 2 = 0")))


@query(
    "SELECT page_id, url, 'utf-8' AS encoding, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title, page_id % 5 <> 0 AS followed, "
    "CASE WHEN page_id % 5 = 0 THEN 0 ELSE len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) END AS links FROM pages WHERE page_id % 7 <> 0 AND page_id % 4 <> 1"
)
def pages_processed(spark, d):
    """ST8, FLT5, FLT7: fetched rows, some failed, some no HTML, some that forbid following."""
    i = F.col("page_id")
    kind = F.when(i % 4 == 1, "image/png").when(i % 4 == 2, "TEXT/HTML; charset=utf-8").when(i % 4 == 3, None).otherwise("application/xhtml+xml")
    robots = F.when(i % 5 == 0, "<meta name=robots content=nofollow>").otherwise("")
    raw = spread(table(spark, d, "pages")).select(F.concat("page_id", F.lit(" "), "url").alias("url"), F.when(i % 7 == 0, 404).otherwise(200).alias("status"), kind.alias("content_type"), F.concat(robots, "html").cast("binary").alias("content"))
    out = pg.process_pages(raw)
    key = F.split("url", " ")
    return out.select(key[0].cast("long").alias("page_id"), key[1].alias("url"), "encoding", "title", F.col("follow").alias("followed"), F.size("links").cast("long").alias("links"))


@query(
    _vector({"the": 1, "thin": 1}) + " SELECT doc_id, round(weight, 4) AS weight, '<li><a href=\"http://h/?a&amp;b=' || doc_id || '\">' || CASE WHEN doc_id % 2 = 0 THEN '&lt;b&gt; &quot;' || doc_id ELSE 'http://h/?a&amp;b=' || doc_id END || '</a> '"
    " || CAST(round(0.5 + doc_id % 10, 4) AS VARCHAR) || '</li>' AS item FROM hits"
)
def results_rendered(spark, d):
    """SNK11, SV5: list items of a result with all text escaped; empty titles show the URL."""
    found = rt.vector_query(_index(spark, d), "the thin")
    i = F.col("doc_id")
    rows = found.select("doc_id", "weight", F.concat(F.lit("http://h/?a&b="), i).alias("url"), F.when(i % 2 == 0, F.concat(F.lit('<b> "'), i)).otherwise("").alias("title"), (F.lit(0.5) + i % 10).alias("score"))
    items = pg.render_results(rows).select("doc_id", "item")
    return items.join(found.select("doc_id", F.round("weight", 4).alias("weight")), "doc_id").select("doc_id", "weight", "item")


@query(
    _vector({"the": 1, "thin": 1}) + ", " + _RANKS + ", both_ AS (SELECT doc_id, coalesce(pagerank, 0) AS pr, weight AS sim FROM hits LEFT JOIN ranks USING (doc_id)), "
    "scored AS (SELECT doc_id, round(0.6 * coalesce(pr / nullif(max(pr) OVER (), 0), 0) + 0.4 * coalesce(sim / nullif(max(sim) OVER (), 0), 0), 6) AS score FROM both_) SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 25"
)
def combined_top(spark, d):
    """SO4: the first results by combined score."""
    scored = rt.combine(rt.vector_query(_index(spark, d), "the thin"), _part_ranks(spark, d)).select("doc_id", F.round("score", 6).alias("score"))
    return rt.ranked(scored, k=25)


@query("SELECT page_id // 1000 AS part, count(*) AS docs, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, CAST(sum(len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))) AS BIGINT) AS links FROM pages GROUP BY 1")
def link_statistics(spark, d):
    """AG14: documents, bytes and links by thousand documents."""
    pages = spread(table(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), "html")
    return S.scan_statistics(pages, F.size(H.links_of(F.col("html"))["links"]))


_SPANS = (
    "WITH log AS (SELECT ts, CASE event_type WHEN 'click' THEN 'CRAW' WHEN 'purchase' THEN 'DOWN' ELSE 'SEEN' END AS status FROM events), "
    "spans AS (SELECT time_bucket(INTERVAL 10 SECONDS, ts::TIMESTAMP) AS span, count(*) AS seen, count(*) FILTER (status <> 'SEEN') AS crawled, count(*) FILTER (status = 'DOWN') AS downloaded FROM log GROUP BY 1)"
)


@query(
    _SPANS + " SELECT span, seen, crawled, downloaded, " + ", ".join(f"CAST(sum({c}) OVER (ORDER BY span) AS BIGINT) AS total_{c}" for c in ("seen", "crawled", "downloaded")) + " FROM spans"
)
def crawl_samples(spark, d):
    """ST10, T13, WN5: counters of ten seconds and up to their end."""
    status = F.when(F.col("event_type") == "click", "CRAW").when(F.col("event_type") == "purchase", "DOWN").otherwise("SEEN")
    return fr.counter_samples(table(spark, d, "events").select("ts", status.alias("status")))


@query("SELECT event_id, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) || ' DOWN ' || event_id || ' http://u/' || user_id AS value FROM events")
def crawl_log_lines(spark, d):
    """SNK10: lines of the crawl's log."""
    log = table(spark, d, "events").select("ts", F.lit("DOWN").alias("status"), F.col("event_id").alias("doc_id"), F.concat(F.lit("http://u/"), "user_id").alias("url"), "event_id")
    return fr.log_lines(log).select(F.split("value", " ")[2].cast("long").alias("event_id"), "value")


@query(P + "SELECT term, doc_id, freq FROM postings")
def plain_lists_roundtrip(spark, d):
    """SNK5, UX4: lists in another encoding."""
    return ix.decoded_lists(ix.coded_lists(_postings(spark, d), encode=ix.plain_postings), decode=ix.plain_postings)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'de'")
def store_visited(spark, d):
    """SRC3, UX1: a visitor that yields what it will for each row."""
    store = S.read_store(spark, f"{d}/documents.parquet").select("doc_id", "lang", "text")
    return S.visit_store(store, _lengths, "doc_id bigint, n bigint")


def _lengths(rows):
    for r in rows:
        if r["lang"] == "de":
            yield r["doc_id"], len(r["text"])


@query("SELECT p.page_id AS doc_id, p.url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title FROM pages p SEMI JOIN documents d ON p.page_id = d.doc_id WHERE length(html) > 0")
def store_written(spark, d):
    """SNK1, SNK2, SRC3, FLT1, T8: a store is built, written and read, and its metadata taken."""
    pages = table(spark, d, "pages").withColumnRenamed("page_id", "doc_id")
    path = new_path(spark, "store")
    S.write_store(S.build_store(pages, table(spark, d, "documents").select("doc_id")), path)
    return S.page_metadata(S.read_store(spark, path))


@query(
    _FRONTIER + "SELECT host, '/robots.txt' AS path, queue_len FROM q ORDER BY queue_len DESC, ts, host LIMIT 20"
)
def crawl_requests(spark, d):
    """ST2-ST5: the first requests of a new crawl: robots.txt of the largest sites."""
    front = fr.frontier_add(table(spark, d, "pages").select("url", F.col("page_id").alias("seq")))
    hosts = front.select("host").distinct().selectExpr("host", "0L AS next_s", "CAST(NULL AS array<struct<prefix:string,allow:boolean>>) AS rules")
    return cr.requests(cr.Crawl(front, front.select("host", "path"), hosts, 0), 100, k=20).select("host", "path", "queue_len")
