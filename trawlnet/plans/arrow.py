"""Arrow batches through Python, with a bound on the bytes handled at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of input columns that one call of a mapped function gets, unless a single row is larger.
BATCH_BYTES = 8 << 20


def pieces(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``limit`` bytes."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, n * limit // max(1, batch.nbytes))
    for at in range(0, n, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > 2 * limit:
            half = part.num_rows // 2
            yield from pieces(part.slice(0, half), limit)
            yield from pieces(part.slice(half), limit)
        else:
            yield part


def map_columns(df: DataFrame, schema: str | StructType, setup: Callable[[], Callable[..., list]]) -> DataFrame:
    """Apply a function of columns (lists) that returns columns (lists or Arrow arrays).

    ``setup`` runs once per task and returns the function, so models and tokenizers load once.
    """
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup()
        for batch in batches:
            for part in pieces(batch):
                out = f(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                arrays = [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, type=t) for x, t in zip(out, arrow.types)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)
