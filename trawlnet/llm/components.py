"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouped minimum and one join on the same key, so a node with very many edges is pre-aggregated before
the shuffle and its join is split by adaptive execution. The number of steps grows with the logarithm of the number of
nodes. Edges are written to the shared folder after each round; nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.plans.shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``u``, ``v``); the root is the least node of its component.
    Repeated edges and loops change nothing; an empty table gives an empty one."""
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    sign = _sign(edges)
    for _ in range(max_rounds):
        if not sign[0]:
            break
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = _sign(edges)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
