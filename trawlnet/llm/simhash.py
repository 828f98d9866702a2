"""SimHash near-duplicates (operator 3): 64-bit fingerprints, joined with themselves through binary tries.

A fingerprint bit is set if more than half of the hashes of a text's shingles have it; equal fingerprints collapse to
one node before any join. Two fingerprints within ``BUDGET`` bits agree on ``chosen`` of ``BUDGET + chosen`` blocks of
bits, so each fingerprint goes to one trie for each choice of blocks, with the chosen blocks first; ``chosen`` follows
the number of fingerprints, so that the tries stay small. In a trie, pairs of nodes are walked together: each step down
adds one to the differing bits of a pair if its nodes turn different ways, and a pair goes as soon as its budget is
exceeded, or when all below it is already one component. The walk is level by level over arrays, in pieces of bounded
size, depth first. A trie yields a spanning forest of its links, never all pairs; every link between different
fingerprints is either in it or implied by it. A trie with more than ``HOT`` fingerprints is cut into parts, and each
pair of parts is walked in a task of its own. Components of all forests follow (see ``components``).

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other; a
text with fewer words than a shingle is one shingle; the class of a row with a null id is named by the other ids, or
null; a very long text is hashed in blocks; of ties the smallest id names a class; repeated rows each give a row; an empty
table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.llm.components import components
from trawlnet.plans.arrow import map_columns
from trawlnet.plans.shared import materialise

SHINGLE = 4
BITS = 64
BUDGET = 4
SEED = 42
#: Fingerprints of one trie, beyond which it is cut into parts.
HOT = 200_000
#: Fingerprints, on average, that a trie may hold before one more block is chosen.
TRIE = 512
#: Pairs of nodes that are walked at once; shingles that are hashed at once.
WALK, HASHES = 1 << 16, 1 << 15
#: Pairs of fingerprints below which a pair of nodes is compared outright.
LEAF = 32
#: Rows that a task of the join gets, on average.
TASK_ROWS = 1_000_000
#: Ids, or fingerprints, that are broadcast at most; rows of one fingerprint beyond which they are dealt over several keys.
BROADCAST_IDS, HOT_ROWS = 1_000_000, 500_000


def fingerprint(raw: bytes) -> int:
    """SimHash of UTF-8 bytes. ``bytes.lower`` and ``bytes.split`` know A-Z and ASCII white space only."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    # word i starts at starts[i]; a shingle ends one before the start of the word after it
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[SHINGLE:] or [len(line) + 1]
    n, counts = len(ends), np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, HASHES):
        hashes = b"".join([digest(line[s : e - 1], SEED) for s, e in zip(starts[at : at + HASHES], ends[at : at + HASHES])])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fp (bigint: the 64 bits) for each row."""

    def setup() -> Callable[..., list]:
        return lambda keys, raws: [keys, np.array([fingerprint(r or b"") for r in raws], dtype=np.uint64).view(np.int64)]

    source = df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    return map_columns(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, fp bigint", setup)


class Forest:
    """Union-find over arrays; roots are the smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self._next: np.ndarray | None = None

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        changed = False
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                break
            changed = True
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
        if changed:
            self._next = None

    def one_component(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Whether both intervals hold members of one and the same component only."""
        if self._next is None:
            n = len(self.root)
            change = np.flatnonzero(self.root[1:] != self.root[:-1]) + 1
            self._next = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]
        return (self._next[alo] >= ahi) & (self._next[blo] >= bhi) & (self.root[alo] == self.root[blo])


def trie_forest(v: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Roots of the components that links within ``budget`` bits make among the sorted distinct ``v`` (uint64), over
    the tries of values that share their first ``depth`` bits."""
    n = len(v)
    forest = Forest(n)
    head = v >> np.uint64(BITS - depth)
    lo = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
    hi = np.append(lo[1:], n)
    some = hi - lo > 1
    stack = [(depth, lo[some], hi[some], lo[some], hi[some], np.zeros(some.sum(), dtype=np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > WALK:
            for at in range(0, len(alo), WALK):
                stack.append((d, *(x[at : at + WALK] for x in (alo, ahi, blo, bhi, err))))
            continue
        apart = ~forest.one_component(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, err = (x[apart] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        size = (ahi - alo) * (bhi - blo)
        leaf = size <= LEAF
        if leaf.any():
            first = np.repeat(np.flatnonzero(leaf), size[leaf])
            k = np.arange(len(first)) - np.repeat(np.cumsum(size[leaf]) - size[leaf], size[leaf])
            wide = (bhi - blo)[first]
            a, b = alo[first] + k // wide, blo[first] + k % wide
            near = (a != b) & (np.bitwise_count(v[a] ^ v[b]) <= budget)
            forest.link(a[near], b[near])
        alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or d == BITS:
            continue
        bit = np.uint64(1 << (BITS - 1 - d))
        above = ~np.uint64(0) << np.uint64(BITS - d) if d else np.uint64(0)
        amid = np.clip(np.searchsorted(v, (v[alo] & above) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(v, (v[blo] & above) | bit), blo, bhi)
        same = alo == blo
        turns = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        other = ~same
        turns.append(tuple(x[other] for x in (amid, ahi, blo, bmid, err + 1)))
        below = [np.concatenate([t[i] for t in turns]) for i in range(5)]
        # a node paired with itself needs two members; other pairs need one on each side
        ok = (below[4] <= budget) & (below[0] < below[1]) & (below[2] < below[3]) & ~((below[0] == below[2]) & (below[1] - below[0] < 2))
        stack.append((d + 1, *(x[ok] for x in below)))
    return forest.root


def block_choices(chosen: int, budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """For each choice of ``chosen`` of ``budget + chosen`` blocks: the blocks (start bit from the left, width), the
    chosen first."""
    n = budget + chosen
    cuts = [BITS * i // n for i in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [[blocks[i] for i in c] + [blocks[i] for i in range(n) if i not in c] for c in combinations(range(n), chosen)]


def _permuted(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` with the blocks in the given order."""
    out, at = F.lit(0).cast("long"), 0
    for start, width in blocks:
        mask = (1 << width) - 1
        part = F.shiftrightunsigned(fp, BITS - start - width).bitwiseAND(F.lit(mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, BITS - at - width))
        at += width
    return out


def _blocks_chosen(n: int) -> int:
    for chosen in (1, 2, 3):
        width = BITS * chosen // (BUDGET + chosen)
        if n <= TRIE << width:
            return chosen
    return 4


def _back(v: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(v), dtype=np.uint64), 0
    for start, width in blocks:
        part = (v >> np.uint64(BITS - at - width)) & np.uint64((1 << width) - 1)
        out |= part << np.uint64(BITS - start - width)
        at += width
    return out


def near_links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints ``fp`` of ``nodes`` whose components are those of all links."""
    spark = nodes.sparkSession
    n = nodes.count()
    chosen = _blocks_chosen(n)
    choices = block_choices(chosen)
    # blocks differ in width by a bit; all values of a trie share the shortest head
    width = min(sum(w for _, w in c[:chosen]) for c in choices)
    rows = nodes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), _permuted(F.col("fp"), c).alias("v")) for i, c in enumerate(choices)])).alias("x")).select("x.c", "x.v")
    rows = rows.withColumn("head", F.shiftrightunsigned("v", BITS - width))
    hot = materialise(rows.groupBy("c", "head").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
    if hot.count():
        parts = F.ceil(F.col("n") / HOT).cast("int")
        own = F.pmod(F.xxhash64("v"), parts).cast("int")
        rows = rows.join(hot, ["c", "head"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
        rows = rows.withColumn("other", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))))
        rows = rows.withColumn("part", F.least("own", "other").cast("long") * F.lit(1 << 31) + F.greatest("own", "other")).drop("own", "other", "n")
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // TASK_ROWS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
        if not got:
            return
        c, v, part = (np.concatenate([g[i] for g in got]) for i in range(3))
        v = v.view(np.uint64)
        order = np.lexsort((v, part, c))
        c, v, part = c[order], v[order], part[order]
        cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(part) != 0)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(c))):
            own = v[lo:hi]
            root = trie_forest(own, width)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                ends = [_back(x, choices[c[lo]]).view(np.int64) for x in (own[at], own[root[at]])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["u", "v"])

    return rows.select("c", "v", "part", "head").repartition(tasks, "c", "head", "part").select("c", "v", "part").mapInArrow(walk, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fp, component_id (the smallest id that links reach) for each row."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("rows")), "nodes")
    found = components(near_links(nodes))
    linked = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    classes = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return _with_classes(prints, nodes, classes, id_col).select(id_col, "fp", "component_id")


def _with_classes(prints: DataFrame, nodes: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """The class (fp, component_id) of each row: broadcast while there are few, otherwise by a shuffle in which the rows of
    a hot fingerprint are dealt over several keys."""
    if nodes.count() <= BROADCAST_IDS:
        return prints.join(F.broadcast(classes), "fp", "left")
    hot = nodes.where(F.col("rows") > HOT_ROWS).select("fp", F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("parts"))  # one in HOT_ROWS rows at most
    own = prints.join(F.broadcast(hot), "fp", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = classes.join(F.broadcast(hot), "fp", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return own.join(copies, ["fp", "part"], "left")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, that with the smallest id, with all columns. Rows that share that id
    count as one document, of which one stays; rows with a null id stay."""
    found = materialise(near_duplicates(docs, id_col, text_col), "classes")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    again = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    small = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    kept = docs.join(small(gone), id_col, "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = small(again)
    return kept.join(again, id_col, "left_anti").select(docs.columns).union(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns))
