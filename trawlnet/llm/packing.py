"""Best-fit packing (operator 9): documents into sequences of at most ``LIMIT`` tokens, hierarchically.

Documents become pieces: the ids of the text, then id 0; only what is longer than a sequence is cut, so that all but
the first piece fill a sequence. Pieces that fill one are done. The others are packed best-fit, longest first, within
each partition of the table of pieces, without a shuffle. Bins that have no room for even the least filled of all bins
are emitted, as no later round could use them; the underfull ones go up as items to a smaller number of partitions and are
packed best-fit again, until one partition is left or a round saves no bin. A partition never holds more than about
``TASK_ROWS`` pieces beyond the first round, whatever the input, and no round sees what an earlier one has emitted. Since
best-fit leaves each partition one bin at most that is filled by half or less, and no two fuller ones can be joined, an end
with several partitions leaves no more joins than partitions: one in ``TASK_ROWS`` pieces.

The ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json``. They are made from the rank file of the same
vocabulary through ``bpe``, about eight times as fast; the tests hold both against each other. The text of an added
token (``ADDED``) is that token, as the library has it by default, and parts the text on both sides.

Defined results: null text counts as empty, and an empty text is one piece of one token; a very long text is as many
pieces as it fills; of pieces of one length any may come first; repeated rows, and rows that share an id or have none,
each have their own pieces; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from trawlnet.llm import bpe
from trawlnet.plans.arrow import map_columns
from trawlnet.plans.shared import materialise

LIMIT = 2048
#: Added tokens of ``byte_bpe_50k.json`` and their ids; the rank file has none.
ADDED = {"<|endoftext|>": 50256}
_ADDED = re.compile("(" + "|".join(map(re.escape, ADDED)) + ")")
#: Pieces that a task of a later round gets, on average.
TASK_ROWS = 500_000


def cut_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids; only the first may be shorter than ``limit``."""
    first = n % limit
    return [first] * bool(first) + [limit] * (n // limit)


def encode_bytes(encoding, text: str) -> bytes:
    """The library's ids of ``text``, added tokens included, as little-endian unsigned 32-bit integers."""
    if not _ADDED.search(text):
        return bpe.encode_bytes(encoding, text)
    return b"".join(ADDED[x].to_bytes(4, "little") if x in ADDED else bpe.encode_bytes(encoding, x) for x in _ADDED.split(text))


def document_pieces(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, and with ``with_ids`` also ids (little-endian unsigned 32-bit)."""

    def setup() -> Callable[..., list]:
        encoding = bpe.encoding_for(rank_file)
        end = bytes(4)

        def run(keys: list, texts: list) -> list:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for key, text in zip(keys, texts):
                raw = encode_bytes(encoding, text or "") + end
                at = 0
                for k, n in enumerate(cut_lengths(len(raw) // 4, limit)):
                    ids = raw[4 * at : 4 * (at + n)]
                    for column, x in zip(out, (key, k, at, n, zlib.crc32(ids), ids)):
                        column.append(x)
                    at += n
            return out

        return run

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    key = source.schema[0].dataType.simpleString()
    return map_columns(source, f"`{id_col}` {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids, setup)


def best_fit(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, each in the bin that it leaves the least free.

    Bins lie in stacks by what they have free; the bits of one integer tell which stacks hold any.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    free_stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    held, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = held >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            stack = free_stacks[free]
            b = stack.pop()
            if not stack:
                held ^= 1 << free
        else:
            b, free, made = made, limit, made + 1
        bins[i], offsets[i] = b, limit - free
        free -= n
        if free:
            free_stacks[free].append(b)
            held |= 1 << free
    return bins, offsets


def _round(df: DataFrame, level: int, limit: int) -> DataFrame:
    """Pack the bins (columns bin, offset) of each partition of ``df`` into new ones; fill is a new bin's length."""
    names = [c for c in df.columns if c not in ("bin", "offset", "fill")]
    schema = StructType([df.schema[c] for c in names] + [StructField(c, LongType()) for c in ("bin", "offset", "fill")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        length = rows["length"].to_numpy()
        if level:
            _, item = np.unique(rows["bin"].to_numpy(), return_inverse=True)
            size = np.bincount(item, length).astype(np.int64)
            within = rows["offset"].to_numpy()
        else:
            item, size, within = np.arange(len(length)), length, np.zeros(len(length), dtype=np.int64)
        bins, offsets = best_fit(size, limit)
        fill = np.bincount(bins, size).astype(np.int64)
        own = (level << 52) + (TaskContext.get().partitionId() << 28)
        columns = [rows[c] for c in names] + [pa.array(x) for x in (own + bins[item], offsets[item] + within, fill[bins[item]])]
        yield from pa.Table.from_arrays(columns, schema=arrow).to_batches(max_chunksize=100_000)

    return df.mapInArrow(run, schema)


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (at least a ``length`` column, each of 1 to ``limit``) with sequence_id and offset."""
    todo, before, level = materialise(pieces, "pieces"), None, 0
    done: list[DataFrame] = []
    while True:
        packed = materialise(_round(todo, level, limit), "packed")
        task = F.shiftright("bin", 28)
        # a row for each fill, ``limit`` at most
        fills = packed.groupBy("fill").agg(F.count("*").alias("rows"), F.countDistinct("bin").alias("bins"), F.min(task).alias("lo"), F.max(task).alias("hi")).collect()
        most = limit - min((r["fill"] for r in fills), default=limit)
        left = [r for r in fills if r["fill"] <= most]
        bins, now = sum(r["bins"] for r in fills), sum(r["bins"] for r in left)
        if now < 2 or min(r["lo"] for r in left) == max(r["hi"] for r in left) or bins == before:
            done.append(packed)
            break
        is_open = F.col("fill") <= most
        done.append(packed.where(~is_open))
        todo, before, level = packed.where(is_open).repartition(-(-sum(r["rows"] for r in left) // TASK_ROWS), "bin"), now, level + 1
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out.withColumnRenamed("bin", "sequence_id").drop("fill").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    return pack(document_pieces(docs, rank_file))
