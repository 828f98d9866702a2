"""PageRank's iterations over blocks of nodes, as arrays.

A node's id becomes a block and a place in it. A block's edges lie in chunks sorted by target: sources' places, and where
each target's begin; what does not fit the first chunk is held by tasks of their own, which get the block's votes as well,
so a hub's links are many tasks' work. The chunks are dealt once, and an iteration moves summed votes only: a task adds up
its block's votes, and sends each target block one row of sums. Some iterations are one job, whose ranks are
written to the shared folder; that cuts lineage, and what the job shuffled can go.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from trawlnet.plans.shared import discard, materialise

_CHUNK = pa.schema([("p", pa.int32()), ("c", pa.int32()), *((x, pa.binary()) for x in ("src", "at", "targets", "blocks", "begins", "degrees"))])
_RANKS = pa.schema([("p", pa.int32()), ("i", pa.int32()), ("rank", pa.float64())])
_STATE = "p int, rank binary, offs array<double>"


def placed(nodes: DataFrame, blocks: int) -> DataFrame:
    """id, p, i: each node's block and its place there, from 0."""
    from pyspark.sql import Window

    rows = nodes.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1).cast("int"))


def chunks(edges: DataFrame, nodes: DataFrame, blocks: int, limit: int) -> DataFrame:
    """Chunks of at most ``limit`` distinct edges between ``nodes`` (id, p, i), by the block of their source; a block's last
    chunk also holds the number of links of each of its sources."""
    end = lambda name, p, i: nodes.select(F.col("id").alias(name), F.col("p").alias(p), F.col("i").alias(i))
    rows = edges.select("src", "dst").join(end("dst", "q", "j"), "dst").join(end("src", "p", "i"), "src").select("p", "i", "q", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c, held, n, last, links = None, 0, [], 0, None, np.zeros(0, np.int64)

        def row(k: int, degrees: bytes | None = None) -> pa.RecordBatch:
            """The first ``k`` of the held edges."""
            nonlocal held, n, c
            i, q, j = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int32)
            held, n = [np.stack([i[k:], q[k:], j[k:]])], n - k
            i, q, j = i[:k], q[:k], j[:k]
            new = np.ones(k, bool)
            new[1:] = (q[1:] != q[:-1]) | (j[1:] != j[:-1])
            at = np.flatnonzero(new)
            first = np.ones(len(at), bool)
            first[1:] = q[at][1:] != q[at][:-1]
            begins = np.flatnonzero(first)
            arrays = [x.astype(np.int32) for x in (i, at, j[at], q[at][begins], begins)]
            c += 1
            return _batch([[now], [c - 1], *([a.tobytes()] for a in arrays), [degrees]], _CHUNK)

        for batch in batches:
            p, i, q, j = (batch.column(k).to_numpy() for k in range(4))
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if p[a] != now:
                    if now is not None:
                        yield row(n, links.tobytes())
                    now, c, held, n, last, links = int(p[a]), 0, [], 0, None, np.zeros(0, np.int64)
                part = np.stack([i[a:b], q[a:b], j[a:b]])
                new = np.ones(b - a, bool)
                new[1:] = (part[:, 1:] != part[:, :-1]).any(axis=0)
                new[0] = last is None or (part[:, 0] != last).any()
                last, part = part[:, -1].copy(), part[:, new]
                found = np.bincount(part[0], minlength=len(links))
                found[: len(links)] += links
                links = found
                held.append(part)
                n += part.shape[1]
                while n > limit:
                    yield row(limit)
        if now is not None:
            yield row(n, links.tobytes())

    return rows.repartition(blocks, "p").sortWithinPartitions("p", "q", "j", "i").mapInArrow(run, from_arrow_schema(_CHUNK))


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, schema.types)], schema=schema)


def iterate(stored: DataFrame, nodes: DataFrame, blocks: int, damping: float, tol: float, max_iter: int | None, together: int) -> DataFrame:
    """id, rank after the first iteration that changes ranks by ``tol`` or less in all, or after ``max_iter``;
    ``stored`` are the chunks of ``nodes`` in ``blocks``, and at most ``together`` iterations are one job."""
    spark = nodes.sparkSession
    sizes = {r.p: r.n for r in nodes.groupBy("p").agg(F.count("*").alias("n")).collect()}
    holders, extra = {p: [p] for p in sizes}, {}
    for r in stored.where("c > 0").select("p", "c").collect():
        extra[r.p, r.c] = blocks + len(extra)
        holders[r.p].append(extra[r.p, r.c])

    def dealt(r) -> Iterator[tuple]:
        yield extra.get((r.p, r.c), r.p), ("chunk", r.p, *map(bytes, (r.src, r["at"], r.targets, r.blocks, r.begins)))
        if r.degrees is not None:
            for k in holders[r.p]:
                yield k, ("degrees", r.p, bytes(r.degrees))

    static = stored.rdd.flatMap(dealt).partitionBy(blocks + len(extra), _same).persist(StorageLevel.MEMORY_AND_DISK)
    state = materialise(spark.createDataFrame([(p, None, []) for p in sizes], _STATE), "ranks")
    done, off, shrinks = 0, math.inf, 0 < damping < 1 and tol > 0
    left = lambda: max(1, math.ceil(math.log(tol / off) / math.log(damping)))  # noqa: E731  iterations at most, but for rounding: each leaves ``damping`` of the change or less
    try:
        while sizes and off > tol and (max_iter is None or done < max_iter):
            m = together if max_iter is None else min(together, max_iter - done)
            m = min(m, left()) if shrinks and done else m
            new, offs = _run(static, state, holders, sizes, damping, m)
            short = next((k for k, x in enumerate(offs, 1) if x <= tol), m)
            if short < m:
                discard(new)
                new, offs = _run(static, state, holders, sizes, damping, short)
            discard(state)
            state, done, off = new, done + short, offs[-1]
            if max_iter is None:
                max_iter = done + 10 + left() if off > tol else done
            spark.sparkContext._jvm.System.gc()  # else shuffle files stay until the driver happens to collect its garbage
    finally:
        static.unpersist()
    return _named(state, nodes)


def _same(key: int) -> int:
    return key


def _run(static: RDD, state: DataFrame, holders: dict, sizes: dict, damping: float, m: int) -> tuple[DataFrame, list[float]]:
    """The ranks after ``m`` iterations, and the sums of absolute changes by each."""
    parts = static.getNumPartitions()

    def copies(r) -> Iterator[tuple]:
        for k in holders[r.p]:
            yield k, ("rank", r.p, None if r.rank is None else bytes(r.rank), ())

    def gathered(rows, first: bool) -> Iterator[tuple]:
        """By key: its block, chunks, degrees, ranks and the changes so far. What holds no old ranks tells no changes."""
        block, held, degrees, ranks, votes = {}, defaultdict(list), {}, {}, {}
        for key, (kind, p, *x) in rows:
            block[key] = p
            if kind == "chunk":
                held[key].append([np.frombuffer(b, np.int32) for b in x])
            elif kind == "degrees":
                degrees[key] = np.frombuffer(x[0], np.int64)
            elif kind == "rank":
                ranks[key] = (np.ones(sizes[p]) if x[0] is None else np.frombuffer(x[0]), x[1])
            else:
                if key not in votes:
                    votes[key] = np.zeros(sizes[p])
                votes[key][np.frombuffer(x[0], np.int32)] += np.frombuffer(x[1])
        for key, p in block.items():
            rank, offs = ranks.get(key, (None, ()))
            if not first:
                new = 1 - damping + damping * votes.get(key, np.zeros(sizes[p]))
                rank, offs = new, offs if rank is None else (*offs, float(np.abs(new - rank).sum()))
            yield key, p, held[key], degrees.get(key), rank, offs

    def sent(first: bool):
        def run(rows) -> Iterator[tuple]:
            for key, p, held, degrees, rank, offs in gathered(rows, first):
                if key == p:
                    yield key, ("rank", p, rank.tobytes(), offs)
                for src, at, targets, blocks, begins in held:
                    share = rank[: len(degrees)] / np.maximum(degrees, 1)
                    sums = np.add.reduceat(share[src], at)
                    for q, a, b in zip(blocks.tolist(), begins.tolist(), [*begins[1:].tolist(), len(targets)]):
                        for k in holders[q]:
                            yield k, ("votes", q, targets[a:b].tobytes(), sums[a:b].tobytes())

        return run

    def ended(rows) -> Iterator[tuple]:
        for key, p, _, _, rank, offs in gathered(rows, False):
            if key == p:
                yield p, rank.tobytes(), list(offs)

    now = state.rdd.flatMap(copies).partitionBy(parts, _same)
    for k in range(m):
        both = static.union(now)
        if both.getNumPartitions() != parts:
            raise RuntimeError("chunks and ranks are not dealt alike")
        now = both.mapPartitions(sent(k == 0)).partitionBy(parts, _same)
    out = materialise(state.sparkSession.createDataFrame(now.mapPartitions(ended), state.schema, verifySchema=False), "ranks")
    return out, [math.fsum(x) for x in zip(*(r.offs for r in out.select("offs").collect()))]


def _named(state: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, rank of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(*(batch.column(k).to_pylist() for k in range(2))):
                rank = np.frombuffer(raw)
                for a in range(0, len(rank), 100_000):
                    part = rank[a : a + 100_000]
                    yield _batch([np.full(len(part), p), np.arange(a, a + len(part)), part], _RANKS)

    return nodes.join(state.select("p", "rank").mapInArrow(run, from_arrow_schema(_RANKS)), ["p", "i"]).select("id", "rank")
