"""Tables in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it back, so a lost executor costs
a re-read of a file and never a recomputation of the plan above it. A bucketed table also keeps its partitioning, so
joins on its key read it without a shuffle.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dirs.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="trawlnet-"))


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is there goes when the session ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it. The files go when the session ends, or by
    ``discard``."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def materialise_bucketed(df: DataFrame, tag: str, key: str, buckets: int, deal: bool = True) -> DataFrame:
    """As ``materialise``, in ``buckets`` hash buckets of ``key``. The table's name is temporary. Without ``deal``, rows
    are written from where they are, which is right for what a shuffle by ``key`` into ``buckets`` has just dealt."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    rows = df.repartition(buckets, key) if deal else df
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stored_at, out._stored_as = path, name
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the tables and files of frames that the functions above returned and that nothing reads any more, such as
    those of the round before the last one; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            if name := getattr(df, "_stored_as", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
