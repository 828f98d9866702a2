"""Page processing (ST8): what is fetched, decoded, parsed and expanded to stripped, resolved links; result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.html import links_of, page_title
from trawlnet.functions.raw import utf8_of
from trawlnet.functions.text import accepts_content_type, charset_of
from trawlnet.functions.urls import resolve_url


def process_pages(raw: DataFrame) -> DataFrame:
    """url, text, encoding, title, follow, index and links of the rows (url, status, content_type, content) that were
    fetched well and hold HTML or XML. Links of pages that forbid following are empty (FLT7)."""
    good = raw.where((F.col("status") == 200) & accepts_content_type(F.col("content_type")))
    text = good.select("url", utf8_of(F.col("content"), F.coalesce(charset_of(F.col("content_type")), F.lit(""))).alias("u"))
    parsed = text.select("url", "u.text", "u.encoding", links_of(F.col("u.text")).alias("p"))
    links = F.when(F.col("p.follow"), F.col("p.links")).otherwise(F.array().cast("array<string>"))
    return parsed.select("url", "text", "encoding", page_title(F.col("text")).alias("title"), "p.base", "p.index", "p.follow", links.alias("links"))


def resolved_links(pages: DataFrame, schemes: tuple[str, ...] = ("http",)) -> DataFrame:
    """url, target: each link of a page once, resolved against its base or URL, stripped (AG12, FLT10)."""
    base = F.coalesce(resolve_url(F.col("url"), F.col("base"), schemes=schemes), F.col("url"))
    rows = pages.select("url", base.alias("_base"), F.explode("links").alias("link"))
    return rows.select("url", resolve_url(F.col("_base"), F.col("link"), True, schemes).alias("target")).where("target IS NOT NULL").distinct()


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def render_results(results: DataFrame, score: str = "score") -> DataFrame:
    """SNK11, SV5: one HTML list item for each row (url, title, score), with its place; all text is escaped."""
    title = F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title"))
    item = F.concat(F.lit('<li><a href="'), escaped(F.col("url")), F.lit('">'), escaped(title), F.lit("</a> "), F.round(score, 4).cast("string"), F.lit("</li>"))
    return results.select("doc_id", score, item.alias("item"))
