"""Link graph and PageRank over edge tables.

Ranks are iterated over blocks of nodes (``blocks``): edges are shuffled once, into chunks of arrays by the block of their
source, and an iteration moves one row of summed votes from each block to each. A block whose sources have more than
``HUB`` links in all is cut into chunks of that many, held by tasks of their own. Some iterations are one job; its ranks are
written to the shared folder with their changes, which cuts lineage, survives lost executors and gives the residuals;
the ranks before are deleted. ``pagerank_step`` is one iteration as a join, over any tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.html import links_of
from trawlnet.functions.urls import fingerprint, normalize_url
from trawlnet.operators.blocks import chunks, iterate, placed
from trawlnet.operators.pages import resolved_links
from trawlnet.plans.shared import discard, materialise

#: Edges (or nodes) of a block on average, at most; edges of a chunk; edges below which a block isn't worth a task.
BUCKET_ROWS, HUB, LEAST_ROWS = 4_000_000, 8_000_000, 100_000
#: Iterations of a job, at most; votes that a job shuffles, at most, unless that is one iteration's.
TOGETHER, VOTES = 16, 250_000_000


def page_edges(pages: DataFrame, schemes: tuple[str, ...] = ("http",)) -> DataFrame:
    """GR1: src, dst: distinct fingerprints of pages (url, html) and of their links' targets, resolved against a page's
    base or URL and stripped. Links and pages that are no valid URLs of ``schemes`` have no edge."""
    parsed = pages.select(normalize_url(F.col("url"), schemes).alias("url"), links_of(F.col("html")).alias("p")).where("url IS NOT NULL")
    found = resolved_links(parsed.select("url", "p.base", "p.links"), schemes)
    return found.select(fingerprint(F.col("url")).alias("src"), fingerprint(F.col("target")).alias("dst")).distinct()


def documents_of(listed: DataFrame, schemes: tuple[str, ...] = ("http",)) -> DataFrame:
    """JN10: fp, doc_id of the valid URLs of a list (doc_id, url); of documents with one URL the last counts."""
    named = listed.select("doc_id", normalize_url(F.col("url"), schemes).alias("url")).where("url IS NOT NULL")
    return named.groupBy(fingerprint(F.col("url")).alias("fp")).agg(F.max("doc_id").alias("doc_id"))


def edges_by_document(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """GR2, JN10: src, dst: distinct pairs of documents (fp, doc_id) that fingerprint edges link; others go."""
    by = lambda end: documents.select(F.col("fp").alias(end), F.col("doc_id").alias(f"{end}_id"))
    out = edges.join(by("src"), "src").join(by("dst"), "dst")
    return out.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLT2, JN8, AG12: distinct edges whose target is in the collection."""
    return edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n"))


def pagerank_step(shares: DataFrame, ranks: DataFrame, damping: float = 0.85) -> DataFrame:
    """GR3: id, rank, off (the absolute change) after one iteration; ``shares`` are edges with their source's
    out-degree, ``ranks`` hold every node."""
    votes = shares.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("_v"))
    new = F.lit(1 - damping) + damping * F.coalesce("_v", F.lit(0.0))
    joined = ranks.select("id", F.col("rank").alias("_old")).join(votes.withColumnRenamed("dst", "id"), "id", "left")
    return joined.select("id", new.alias("rank"), F.abs(new - F.col("_old")).alias("off"))


def residual(old: DataFrame, new: DataFrame) -> DataFrame:
    """AG10, JN12: the sum of absolute changes, one row."""
    both = old.withColumnRenamed("rank", "_old").join(new.withColumnRenamed("rank", "_new"), "id", "left")
    return both.agg(F.sum(F.abs(F.col("_old") - F.coalesce("_new", F.lit(0.0)))).alias("l1"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR5: ids of nodes that have links, none of them into the collection."""
    linking = edges.select(F.col("src").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    return linking.join(valid_edges(edges, nodes).select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tol: float = 1e-3, max_iter: int | None = None, prune_dangling: bool = False) -> DataFrame:
    """GR3, GR4: id, rank; at least one iteration, until the residual is ``tol`` or less, or after ``max_iter`` if that is
    given. With ``prune_dangling`` (GR5), nodes all of whose links lead out of the collection take no part and get the
    least rank, 1 - ``damping``."""
    if max_iter is None and not (tol > 0 and 0 < damping < 1):
        raise ValueError("without max_iter, tol must be positive and damping between 0 and 1")
    spark = nodes.sparkSession
    nodes = materialise(nodes.select("id").distinct(), "nodes")
    edges = materialise(edges.select("src", "dst"), "edges")
    lone = None
    if prune_dangling:
        lone = materialise(dangling(nodes, edges), "dangling")
        nodes = materialise(nodes.join(lone, "id", "left_anti"), "nodes")
    links, size = edges.count(), nodes.count()
    few = min(2 * spark.sparkContext.defaultParallelism, -(-links // LEAST_ROWS))  # more blocks send more sums for a target
    blocks = max(1, few, -(-links // BUCKET_ROWS), -(-size // BUCKET_ROWS))
    nodes = materialise(placed(nodes, blocks), "placed")
    stored = materialise(chunks(edges, nodes, blocks, HUB), "chunks")
    out = iterate(stored, nodes, blocks, damping, tol, max_iter, max(1, min(TOGETHER, VOTES // max(1, links))))
    discard(edges, stored)
    return out.union(lone.select("id", F.lit(1 - damping))) if lone is not None else out


def pagerank_steps(nodes: DataFrame, edges: DataFrame, k: int, damping: float = 0.85) -> list[DataFrame]:
    """The ranks before and after each of ``k`` iterations."""
    edges = materialise(edges, "edges")
    shares = materialise(edges.join(out_degrees(edges), "src"), "shares")
    out = [nodes.withColumn("rank", F.lit(1.0))]
    for _ in range(k):
        out.append(pagerank_step(shares, out[-1], damping).select("id", "rank"))
    return out


def degree_distribution(edges: DataFrame) -> DataFrame:
    """AG17."""
    return out_degrees(edges).groupBy(F.col("n").alias("out_degree")).agg(F.count("*").alias("pages"))
