"""Dealing small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Estimated bytes a core below which an input of few files counts as small.
SMALL_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is small and lies in fewer files than there are cores; a file may be one row
    group, which one task reads whatever its splits. Inputs of many files, or large ones, stay as they are. Nothing is
    executed to find out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL_BYTES and len(df.inputFiles()) < cores else df
