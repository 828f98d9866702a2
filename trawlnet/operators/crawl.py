"""The crawl as rounds over tables (ST1-ST9): pop, fetch, process, save, and queue what was found.

A round takes the first due path of each of the first hosts by policy, robots.txt first; fetches them in tasks; saves what
is HTML and logs every request; and adds the links found to the frontier, less what is known. The state is three tables in
the shared folder (frontier, known paths, hosts), written once a round; a crawl goes on from the state it is given (ST9).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.functions.raw import robots_of
from trawlnet.functions.text import host_of, path_of, robots_allowed
from trawlnet.operators.frontier import POLITE_S, frontier_pop
from trawlnet.operators.pages import process_pages, resolved_links
from trawlnet.plans.shared import discard, materialise
from trawlnet.sources.http import fetch, fetched

ROBOTS = "/robots.txt"


@dataclass
class Crawl:
    """``frontier``: host, path, seq of what is to be fetched; ``known``: host, path of all ever queued; ``hosts``: host,
    next_s (when it may be asked again), rules (of its robots.txt; null before it was asked for); ``n``: next seq."""

    frontier: DataFrame
    known: DataFrame
    hosts: DataFrame
    n: int

    @classmethod
    def of(cls, spark: SparkSession, seeds: list[str]) -> Crawl:
        """A new crawl from a short list of seeds (ST12)."""
        urls = spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, seq long")
        rows = urls.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "seq").where("host <> ''").groupBy("host", "path").agg(F.min("seq").alias("seq"))
        frontier = materialise(rows, "frontier")
        hosts = frontier.select("host").distinct().select("host", F.lit(0).cast("long").alias("next_s"), F.lit(None).cast("array<struct<prefix:string,allow:boolean>>").alias("rules"))
        return cls(frontier, materialise(frontier.select("host", "path"), "known"), materialise(hosts, "hosts"), len(seeds))


def requests(crawl: Crawl, now_s: int, k: int | None = None, policy: str = "lsf") -> DataFrame:
    """ST2-ST5: host, path, url, queue_len of the hosts that are due, the first ``k`` by policy: robots.txt of a host that
    was never asked, otherwise the path that was queued first of those that its rules allow."""
    allowed = crawl.frontier.join(crawl.hosts, "host").where(F.col("rules").isNull() | robots_allowed(F.col("path"), F.col("rules")))
    queues = allowed.groupBy("host").agg(
        F.count("*").alias("queue_len"), F.min_by("path", "seq").alias("next_path"), F.min("seq").alias("ts"), F.max("next_s").alias("_next"), F.max(F.col("rules").isNull()).alias("_new")
    )
    due = frontier_pop(queues.where(F.col("_next") <= now_s), policy=policy, k=k)
    path = F.when(F.col("_new"), ROBOTS).otherwise(F.col("next_path")).alias("path")
    return due.select("host", path, "queue_len").withColumn("url", F.concat(F.lit("http://"), F.col("host"), F.col("path")))


def crawl_round(crawl: Crawl, now_s: int, path: str, get: Callable = fetch, k: int | None = None, policy: str = "lsf", suffix: str = "") -> Crawl:
    """One round (ST7, ST8, SNK7, SNK10): pages go to ``path``/pages, requests to ``path``/log. Failed requests are
    logged and not repeated; a robots.txt that fails allows all."""
    asked = materialise(requests(crawl, now_s, k, policy), "requests")
    got = materialise(fetched(asked, get), "fetched").join(asked.select("url", "host", "path"), "url")
    robots = F.col("path") == ROBOTS
    rules = got.where(robots).select("host", F.when(F.col("status") == 200, robots_of(F.col("content").try_cast("string"))).otherwise(F.array().cast("array<struct<prefix:string,allow:boolean>>")).alias("_rules"))
    pages = materialise(process_pages(got.where(~robots)), "pages")
    pages.write.mode("append").parquet(f"{path}/pages")
    status = F.when(F.col("status") == 200, "DOWN").otherwise("CRAW")
    got.select(F.timestamp_seconds(F.lit(now_s)).alias("ts"), status.alias("status"), "url").write.mode("append").parquet(f"{path}/log")
    links = resolved_links(pages).select(host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path")).distinct()
    links = links.where((F.col("host") != "") & F.col("host").endswith(suffix)).join(crawl.known, ["host", "path"], "left_anti")
    found = materialise(links.withColumn("seq", F.monotonically_increasing_id() + crawl.n), "found")
    left = crawl.frontier.join(asked.select("host", "path"), ["host", "path"], "left_anti").select("host", "path", "seq")
    hosts = crawl.hosts.join(asked.select("host", F.lit(True).alias("_asked")), "host", "left").join(rules, "host", "left")
    hosts = hosts.select("host", F.when(F.col("_asked"), F.lit(now_s + POLITE_S)).otherwise(F.col("next_s")).alias("next_s"), F.coalesce("rules", "_rules").alias("rules"))
    new = found.select("host").distinct().join(crawl.hosts, "host", "left_anti").select("host", F.lit(now_s).cast("long").alias("next_s"), F.lit(None).cast(crawl.hosts.schema["rules"].dataType).alias("rules"))
    n = max(crawl.n, 1 + (found.agg(F.max("seq")).first()[0] or 0))
    out = Crawl(materialise(left.unionByName(found.select("host", "path", "seq")), "frontier"), materialise(crawl.known.unionByName(found.select("host", "path")), "known"), materialise(hosts.unionByName(new), "hosts"), n)
    discard(crawl.frontier, crawl.known, crawl.hosts, found)
    return out
