"""The registered queries and the SQL that gives the same rows. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.functions import text as T
from trawlnet.operators import frontier as fr
from trawlnet.operators import graph as gr
from trawlnet.operators import index as ix
from trawlnet.operators import retrieval as rt
from trawlnet.plans.shared import new_path
from trawlnet.plans.tables import table
from trawlnet.sources.store import build_store, page_metadata, read_store, scan_statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return ix.term_frequencies(table(spark, d, "documents"))


def _index(spark: SparkSession, d: str) -> ix.Index:
    return ix.Index(table(spark, d, "documents"))


#: Postings, frequencies and norms in SQL, the common start of many oracles.
P = f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM documents),
postings AS (SELECT doc_id, translate(lower(w), '{T.ACCENTED}', '{T.PLAIN}') AS term, count(*) AS freq FROM words GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
total AS (SELECT count(*) AS n FROM documents),
norms AS (SELECT doc_id, sqrt(sum(pow(freq * ln(n::DOUBLE / df), 2))) / max(freq) AS wd, max(freq) AS max_freq
          FROM postings JOIN dfs USING (term), total GROUP BY doc_id)
"""


@query(P + "SELECT doc_id, term, freq FROM postings")
def term_frequency(spark, d):
    return _postings(spark, d)


@query(P + "SELECT term, df FROM dfs")
def vocabulary_df(spark, d):
    return ix.document_frequencies(_postings(spark, d))


@query(P + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM dfs")
def vocabulary_ids(spark, d):
    return ix.vocabulary(_postings(spark, d))


@query(P + "SELECT term, count(*) AS df, string_agg('<' || doc_id || ',' || freq || '>', ' ' ORDER BY doc_id) AS list FROM postings GROUP BY term")
def posting_lists(spark, d):
    return ix.dump(_postings(spark, d))


@query(P + "SELECT doc_id, term, freq, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM postings")
def posting_gaps(spark, d):
    return ix.gaps(_postings(spark, d))


@query(P + "SELECT term, doc_id, freq FROM postings")
def posting_gaps_roundtrip(spark, d):
    from pyspark.sql import Window

    placed = ix.gaps(_postings(spark, d)).withColumn("pos", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).drop("doc_id")
    return ix.ungap(placed).select("term", "doc_id", "freq")


@query(P + "SELECT term, doc_id, freq FROM postings")
def coded_lists_roundtrip(spark, d):
    return ix.decoded_lists(ix.coded_lists(_postings(spark, d)))


_SIZE = "CASE WHEN {0} - 1 < 128 THEN 1 WHEN {0} - 1 < 16512 THEN 2 WHEN {0} - 1 < 2113664 THEN 3 WHEN {0} - 1 < 270549120 THEN 4 ELSE 5 END"
_SIZES = (
    P
    + ", g AS (SELECT term, freq, doc_id + 1 - coalesce(lag(doc_id + 1) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM postings),"
    + f" sizes AS (SELECT term, count(*) AS df, CAST(sum({_SIZE.format('gap')} + {_SIZE.format('freq')}) AS BIGINT) AS bytes FROM g GROUP BY term)"
)


@query(_SIZES + " SELECT term, df, bytes FROM sizes")
def compressed_sizes(spark, d):
    return ix.compressed_sizes(_postings(spark, d))


@query(_SIZES + " SELECT term, df, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM sizes")
def header_offsets(spark, d):
    return ix.header_offsets(_postings(spark, d))


@query(P + "SELECT doc_id, round(wd, 6) AS wd, max_freq FROM norms")
def doc_norms(spark, d):
    return _index(spark, d).norms.withColumn("wd", F.round("wd", 6))


def _has(*terms: str) -> list[str]:
    return [f"SELECT doc_id FROM postings WHERE term = '{t}'" for t in terms]


@query(P + " INTERSECT ".join(_has("the", "thin")))
def boolean_and(spark, d):
    return rt.boolean_query(_index(spark, d), "the thin")


@query(P + " UNION ".join(_has("thin", "que")))
def boolean_or(spark, d):
    return rt.boolean_query(_index(spark, d), "thin OR Que")


@query(P + "({} UNION {}) INTERSECT {}".format(*_has("thin", "de", "la")))
def boolean_mixed(spark, d):
    return rt.boolean_query(_index(spark, d), "thin OR de AND la")


def _vector(terms: dict[str, int]) -> str:
    q = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return (
        P + f", q(term, mult) AS (VALUES {q}), hits AS (SELECT p.doc_id, coalesce(sum(q.mult * p.freq * ln(n::DOUBLE / df)) / nullif(any_value(max_freq) * any_value(wd), 0), 0) AS weight "
        f"FROM postings p JOIN q USING (term) JOIN dfs USING (term) JOIN norms USING (doc_id), total GROUP BY p.doc_id HAVING count(*) = {len(terms)})"
    )


@query(_vector({"the": 1, "thin": 1}) + " SELECT doc_id, round(weight, 6) AS weight, row_number() OVER (ORDER BY round(weight, 6) DESC, doc_id) AS place FROM hits")
def vector_query(spark, d):
    from pyspark.sql import Window

    out = rt.vector_query(_index(spark, d), "the thin").withColumn("weight", F.round("weight", 6))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "doc_id")))  # WN6: places of a result list


@query(_vector({"de": 2, "la": 1}) + " SELECT doc_id, round(weight, 6) AS weight FROM hits")
def vector_query_repeated_term(spark, d):
    return rt.vector_query(_index(spark, d), "de la De").withColumn("weight", F.round("weight", 6))


@query(_vector({"the": 1, "zzzz": 1}) + " SELECT doc_id, round(weight, 6) AS weight FROM hits")
def vector_query_unknown_term(spark, d):
    return rt.vector_query(_index(spark, d), "the zzzz").withColumn("weight", F.round("weight", 6))


@query(_vector({"the": 1, "thin": 1}) + " SELECT doc_id, round(weight, 6) AS weight FROM hits ORDER BY weight DESC, doc_id LIMIT 10")
def vector_query_top10(spark, d):
    return rt.vector_query(_index(spark, d), "the thin", k=10).withColumn("weight", F.round("weight", 6))


@query(_vector({"the": 1, "thin": 1}) + " SELECT doc_id, round(weight, 6) AS weight FROM hits")
def vector_query_tokenised(spark, d):
    return rt.vector_query(_index(spark, d), " The (thin)!", strict=False).withColumn("weight", F.round("weight", 6))


@query(_vector({"the": 1, "thin": 1}) + " SELECT doc_id, round(weight, 6) AS weight FROM hits")
def stored_index_query(spark, d):
    """SNK4-6, SRC9, SRC10: the index is written, read again, and asked."""
    docs = table(spark, d, "documents")
    path = new_path(spark, "index")
    ix.write_index(ix.term_frequencies(docs), path, docs.count())
    return rt.vector_query(ix.StoredIndex(spark, path), "the thin").withColumn("weight", F.round("weight", 6))


@query("SELECT url, row_number() OVER (ORDER BY url) - 1 AS doc_id FROM (SELECT DISTINCT url FROM pages)")
def assigned_ids(spark, d):
    return ix.assign_ids(table(spark, d, "pages").select("url").distinct(), "url")


@query("SELECT doc_id, chr(CAST(doc_id + 1 AS INTEGER)) AS c FROM documents")
def unichr_table(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unichr(F.col("doc_id") + 1).alias("c"))


_RANKS = "ranks AS (SELECT p_partkey AS doc_id, 0.15 + p_size / 10.0::DOUBLE AS pagerank FROM part)"


def _part_ranks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (0.15 + F.col("p_size") / 10.0).alias("pagerank"))


@query(
    _vector({"the": 1, "thin": 1})
    + ", "
    + _RANKS
    + ", both_ AS (SELECT doc_id, coalesce(pagerank, 0) AS pr, weight AS sim FROM hits LEFT JOIN ranks USING (doc_id)) SELECT doc_id, round(pr, 6) AS pagerank, round(sim, 6) AS similarity, "
    "round(0.6 * coalesce(pr / nullif(max(pr) OVER (), 0), 0) + 0.4 * coalesce(sim / nullif(max(sim) OVER (), 0), 0), 6) AS score FROM both_"
)
def combined_query(spark, d):
    out = rt.combine(rt.vector_query(_index(spark, d), "the thin"), _part_ranks(spark, d))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("pagerank", "similarity", "score")])


@query(
    _vector({"the": 1, "thin": 1})
    + ", meta AS (SELECT page_id AS doc_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title FROM pages)"
    + " SELECT doc_id, round(weight, 6) AS weight, coalesce(url, '') AS url, coalesce(title, '') AS title FROM hits LEFT JOIN meta USING (doc_id)"
)
def results_with_meta(spark, d):
    meta = page_metadata(table(spark, d, "pages").withColumnRenamed("page_id", "doc_id"))
    return rt.with_metadata(rt.vector_query(_index(spark, d), "the thin"), meta).withColumn("weight", F.round("weight", 6))


@query("SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS stripped FROM pages")
def url_strip(spark, d):
    return table(spark, d, "pages").select("page_id", "url", T.strip_url(F.col("url")).alias("stripped"))


_HOST = "regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', '')"
_PATH = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", T.host_of(F.col("url")).alias("host"), T.path_of(F.col("url")).alias("path"))


@query(f"SELECT {_HOST.format('url')} AS host, count(DISTINCT url) AS urls FROM pages WHERE ends_with({_HOST.format('url')}, '.org') GROUP BY 1")
def hosts_grouped(spark, d):
    return fr.hosts_grouped(table(spark, d, "pages"), suffix=".org")


_FRONTIER = (
    f"WITH f AS (SELECT {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, min(page_id) AS seq FROM pages GROUP BY 1, 2), "
    "q AS (SELECT host, count(*) AS queue_len, min_by(path, seq) AS next_path, min(seq) AS ts FROM f WHERE host <> '' GROUP BY host) "
)


def _queues(spark: SparkSession, d: str) -> DataFrame:
    return fr.host_queues(fr.frontier_add(table(spark, d, "pages").select("url", F.col("page_id").alias("seq"))))


@query(_FRONTIER + "SELECT * FROM q ORDER BY queue_len DESC, ts, host LIMIT 20")
def frontier_lsf(spark, d):
    return fr.frontier_pop(_queues(spark, d), k=20)


@query(_FRONTIER + "SELECT * FROM q ORDER BY ts, queue_len DESC, host LIMIT 20")
def frontier_bf(spark, d):
    return fr.frontier_pop(_queues(spark, d), policy="bf", k=20)


_LOG = {"view": "SEEN", "click": "CRAW", "purchase": "DOWN"}


@query(
    _FRONTIER
    + ", log AS (SELECT CASE event_type WHEN 'view' THEN 'SEEN' WHEN 'click' THEN 'CRAW' WHEN 'purchase' THEN 'DOWN' ELSE event_type END AS status FROM events), "
    "a AS (SELECT count(*) AS seen, count(*) FILTER (status IN ('CRAW', 'DOWN')) AS crawled, count(*) FILTER (status = 'DOWN') AS downloaded FROM log), "
    "b AS (SELECT count(*) AS hosts, CAST(coalesce(sum(queue_len), 0) AS BIGINT) AS queued, count(*) FILTER (ts <= 100) AS active, count(*) FILTER (ts > 100) AS idle FROM q) SELECT * FROM a, b"
)
def crawl_counters(spark, d):
    status = F.col("event_type")
    for a, b in _LOG.items():
        status = F.when(F.col("event_type") == a, b).otherwise(status)
    return fr.crawl_counters(table(spark, d, "events").select(status.alias("status")), _queues(spark, d), F.lit(100))


@query(
    f"SELECT {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, min(page_id) AS seq FROM pages "
    f"WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AND {_HOST.format('url')} <> '' GROUP BY 1, 2"
)
def restart_pending(spark, d):
    listed = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return fr.pending(listed, table(spark, d, "documents").where("lang = 'en'"))[1]


@query("SELECT doc_id, printf('%02X/%02X/%02X/%02X/data.gz', doc_id >> 24 & 255, doc_id >> 16 & 255, doc_id >> 8 & 255, doc_id & 255) AS path FROM documents")
def docid_path(spark, d):
    return table(spark, d, "documents").select("doc_id", T.docid_path(F.col("doc_id")).alias("path"))


@query("SELECT count(*) AS docs, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages")
def store_scan_stats(spark, d):
    whole = scan_statistics(read_store(spark, f"{d}/pages.parquet"), id_col="page_id")
    return whole.agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))


@query("SELECT p.page_id, p.url, octet_length(encode(html)) AS size FROM pages p SEMI JOIN documents d ON p.page_id = d.doc_id WHERE length(html) > 0")
def store_build(spark, d):
    pages = table(spark, d, "pages").withColumnRenamed("page_id", "doc_id")
    return build_store(pages, table(spark, d, "documents")).select(F.col("doc_id").alias("page_id"), "url", F.octet_length("html").cast("long").alias("size"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts as nodes; a line item links its supplier and its part both ways. Part 1 has no links out."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"))
    edges = rows.select(F.col("s").alias("src"), F.col("p").alias("dst")).union(rows.where("p <> 'p1'").select("p", "s")).distinct()
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey")))
    return nodes, edges


_GRAPH = (
    "WITH e0 AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_partkey <> 1), "
    "nodes AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part), "
    "edges AS (SELECT src, dst FROM e0 SEMI JOIN nodes ON dst = id), deg AS (SELECT src, count(*) AS n FROM edges GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM nodes), "
)


def _steps(k: int) -> str:
    one = "r{1} AS (SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.rank / n), 0) AS rank FROM nodes v LEFT JOIN edges e ON e.dst = v.id LEFT JOIN deg ON deg.src = e.src LEFT JOIN r{0} r ON r.id = e.src GROUP BY v.id)"
    return _GRAPH + ", ".join(one.format(i, i + 1) for i in range(k))


@query(_GRAPH.rstrip(", ") + " SELECT src, dst FROM edges")
def valid_outlinks(spark, d):
    nodes, edges = _graph(spark, d)
    return gr.valid_edges(edges, nodes)


@query(_GRAPH.rstrip(", ") + " SELECT n AS out_degree, count(*) AS pages FROM deg GROUP BY n")
def out_degree_distribution(spark, d):
    nodes, edges = _graph(spark, d)
    return gr.degree_distribution(gr.valid_edges(edges, nodes))


@query(_steps(3) + " SELECT id, round(rank, 6) AS rank FROM r3")
def pagerank_k3(spark, d):
    nodes, edges = _graph(spark, d)
    return gr.pagerank(nodes, edges, tol=-1.0, max_iter=3).withColumn("rank", F.round("rank", 6))


@query(_steps(2) + " SELECT round(sum(abs(a.rank - coalesce(b.rank, 0))), 6) AS l1 FROM r1 a LEFT JOIN r2 b USING (id)")
def pagerank_residual(spark, d):
    nodes, edges = _graph(spark, d)
    ranks = gr.pagerank_steps(nodes, gr.valid_edges(edges, nodes), 2)
    return gr.residual(ranks[1], ranks[2]).withColumn("l1", F.round("l1", 6))


@query()
def pagerank_converged(spark, d):
    return gr.pagerank(*_graph(spark, d)).withColumn("rank", F.round("rank", 6))


@query("SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def crawl_minute_rates(spark, d):
    return fr.minute_rates(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def crawl_deltas(spark, d):
    return fr.counter_deltas(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "user_id", F.round("delta", 6).alias("delta"))


@query("SELECT * FROM (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap_us FROM events) WHERE gap_us < 30000000")
def politeness_violations(spark, d):
    return fr.politeness_violations(table(spark, d, "events"), "user_id", "ts").select("event_id", "user_id", "gap_us")


@query(
    f"SELECT page_id, {_PATH.format('url')} AS path, CASE WHEN starts_with({_PATH.format('url')}, '/en/1') THEN true WHEN starts_with({_PATH.format('url')}, '/en/') THEN false "
    f"WHEN starts_with({_PATH.format('url')}, '/de/') THEN false ELSE true END AS allowed FROM pages"
)
def robots_filter(spark, d):
    rules = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for p, a in (("/en/1", True), ("/en/", False), ("/de/", False))])
    path = T.path_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", path.alias("path"), T.robots_allowed(path, rules).alias("allowed"))


_TYPES = ("text/html;charset=ISO-8859-1", "application/xhtml+xml; charset = UTF-8", "image/png", "TEXT/HTML", None)
_TYPES_SQL = "(VALUES " + ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in enumerate(_TYPES)) + ") t(id, ct)"


def _types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_TYPES)), "id int, ct string")


@query(f"SELECT id, ct FROM {_TYPES_SQL} WHERE ct IS NULL OR contains(lower(ct), 'html') OR contains(lower(ct), 'xml')")
def content_type_filter(spark, d):
    return _types(spark).where(T.accepts_content_type(F.col("ct")))


@query(f"SELECT id, trim(regexp_extract(lower(ct), 'charset\\s*=?([^=;]*)', 1)) AS charset FROM {_TYPES_SQL}")
def charset_from_content_type(spark, d):
    return _types(spark).select("id", T.charset_of(F.col("ct")).alias("charset"))


from trawlnet import registry_pages, registry_rules  # noqa: E402, F401  (register the queries over HTML, URLs and bytes, and rule by rule)
