"""Reading and writing document lists and page stores."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trawlnet.plans.arrow import pieces

#: Rows of one file of a store.
ROWS_PER_FILE = 1_000_000


def read_docid_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: doc_id, url of whitespace-separated lines; repeated ids stay. Malformed lines go, and what follows them is
    read, as a file read in splits has no first malformed line."""
    line = F.regexp_replace("value", r"^\s+", "")
    rows = spark.read.text(path).select(F.regexp_extract(line, r"^(\d+)\s+(\S+)", 1).alias("i"), F.regexp_extract(line, r"^(\d+)\s+(\S+)", 2).alias("url"))
    return rows.where("i <> ''").select(F.col("i").cast("long").alias("doc_id"), "url")


def last_urls(listed: DataFrame, order: str) -> DataFrame:
    """SRC2: one url for each id, the one that comes last in ``order``."""
    return listed.groupBy("doc_id").agg(F.max_by("url", order).alias("url"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a store's rows; filters and columns reach the scan."""
    return spark.read.parquet(path)


def write_store(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK1: Parquet files of bounded size."""
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).mode(mode).parquet(path)


def build_store(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """SNK2, FLT1: the pages that are listed and not empty."""
    return pages.where(F.length("html") > 0).join(listed.select("doc_id"), "doc_id", "left_semi")


def read_gzip_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: path, content of gzipped files, inflated; null where a file is no gzip."""
    from trawlnet.functions.raw import gunzip

    return spark.read.format("binaryFile").load(path).select("path", gunzip(F.col("content")).alias("content"))


def write_ranks(ranks: DataFrame, path: str) -> None:
    """SNK9: doc_id, pagerank of ranks (id, rank); a table also where there are none."""
    ranks.select(F.col("id").alias("doc_id"), F.col("rank").alias("pagerank")).write.parquet(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """SRC11."""
    return spark.read.schema("doc_id bigint, pagerank double").parquet(path)


def visit_store(store: DataFrame, visitor: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """UX1: what a visitor of rows yields; each partition is visited once, in its order, by a copy of the visitor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in pieces(batch) for row in part.to_pylist())
        found = visitor(rows)
        while got := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*got), arrow.types)], schema=arrow)

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    return store.mapInArrow(run, struct)


def scan_statistics(pages: DataFrame, links: Column | None = None, every: int = 1000, id_col: str = "doc_id", text_col: str = "html") -> DataFrame:
    """SRC14, AG14: by each ``every`` document ids: documents, bytes, and links, if a column counts a row's."""
    n = links if links is not None else F.lit(0)
    rows = pages.select(F.floor(F.col(id_col) / every).alias("part"), F.octet_length(text_col).alias("_bytes"), n.cast("long").alias("_links"))
    return rows.groupBy("part").agg(F.count("*").alias("docs"), F.sum("_bytes").alias("bytes"), F.sum("_links").alias("links"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """T8: doc_id, url, title."""
    from trawlnet.functions.html import page_title

    return pages.select("doc_id", "url", page_title(F.col("html")).alias("title"))
