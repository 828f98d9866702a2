"""The inverted file as tables: postings, vocabulary, document frequencies, norms, posting lists and their sizes.

Postings stay exploded (term, doc_id, freq): one grouped count with map-side combine builds them, and every later
table is one more aggregation. Dense ids and running offsets over a global order are made from range partitions: a
local window in each, plus the totals of the partitions before it, so no single task sees all rows. Distances within a
term's postings are taken in blocks of document ids, and each block's first from the end of the block before, so a
term that is in most documents is many tasks' work; its coded list is a row for each block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlnet.functions.raw import postings_coded, postings_decoded
from trawlnet.functions.text import normalize_term, tokens, vbyte_size
from trawlnet.plans.shared import materialise
from trawlnet.plans.spread import spread

#: Document ids, or places in a list, of one block.
BLOCK = 1 << 20
#: Postings of one coded list, at most; bytes of a row group of a stored index.
LIST_ROWS, ROW_GROUP_BYTES = 1 << 16, 16 << 20


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """AG1: doc_id, term, freq."""
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    words = texts.select("doc_id", F.explode(tokens(F.col("text"))).alias("t"))
    return words.select("doc_id", normalize_term(F.col("t")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("freq"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """AG2: term, df."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def running(df: DataFrame, order: str, amount: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before each in the order of the distinct column ``order``."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_amount", amount.cast("long")).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    totals = ranged.groupBy("_part").agg(F.sum("_amount").alias("_total"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.coalesce(F.sum("_amount").over(own), F.lit(0)))
    return out.drop("_part", "_amount", "_offset")


def vocabulary(postings: DataFrame) -> DataFrame:
    """WN3: term, term_id (dense, from 0, in the order of terms)."""
    return running(postings.select("term").distinct(), "term", F.lit(1), "term_id")


def posting_lists(postings: DataFrame) -> DataFrame:
    """AG3: term, df, postings (array of doc_id, freq by doc_id)."""
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "freq"))).alias("postings")
    return postings.groupBy("term").agg(F.count("*").alias("df"), listed)


def dump(postings: DataFrame) -> DataFrame:
    """SNK8: posting lists as text."""
    text = F.array_join(F.transform("postings", lambda p: F.concat(F.lit("<"), p["doc_id"], F.lit(","), p["freq"], F.lit(">"))), " ")
    return posting_lists(postings).select("term", "df", text.alias("list"))


def gaps(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """WN1: postings with the distance from the document before, the first from 0."""
    rows = materialise(postings.withColumn("_b", F.floor(F.col("doc_id") / block)), "postings")
    ends = rows.groupBy("term", "_b").agg(F.max("doc_id").alias("_end"))
    before = F.lag("_end").over(Window.partitionBy("term").orderBy("_b"))  # a row for each block
    own = rows.withColumn("_own", F.lag("doc_id").over(Window.partitionBy("term", "_b").orderBy("doc_id")))
    joined = own.join(ends.select("term", "_b", before.alias("_before")), ["term", "_b"])
    return joined.select(*postings.columns, (F.col("doc_id") - F.coalesce("_own", "_before", F.lit(0))).alias("gap"))


def ungap(gapped: DataFrame, block: int = BLOCK) -> DataFrame:
    """WN2: document ids from gaps, given each posting's place ``pos`` in its list."""
    rows = materialise(gapped.withColumn("_b", F.floor(F.col("pos") / block)), "gaps")
    sums = rows.groupBy("term", "_b").agg(F.sum("gap").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("term").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum("gap").over(Window.partitionBy("term", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_own", own).join(sums.select("term", "_b", before.alias("_before")), ["term", "_b"])
    return joined.select(*gapped.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias("doc_id"))


def coded_lists(postings: DataFrame, rows: int = LIST_ROWS, encode: Callable[[Column], Column] = postings_coded) -> DataFrame:
    """SNK6, FN-VB3, UX4: term, block, n, data: lists in the byte-wise code, or that of ``encode`` (of an array of doc_id,
    freq), one for each ``rows`` document ids. Ids are counted within the block, from 1 up, as the code has no zero."""
    cut = F.floor(F.col("doc_id") / rows).alias("block")
    within = F.struct((F.col("doc_id") % rows + 1).alias("doc_id"), F.col("freq").cast("long").alias("freq"))
    lists = postings.groupBy("term", cut).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(within)).alias("_list"))
    return lists.select("term", "block", "n", encode(F.col("_list")).alias("data"))


def plain_postings(postings: Column) -> Column:
    """UX4: the encoding that leaves lists as they are (SNK5)."""
    return postings


def decoded_lists(coded: DataFrame, rows: int = LIST_ROWS, decode: Callable[[Column], Column] = postings_decoded) -> DataFrame:
    """Postings (term, doc_id, freq) of ``coded_lists``."""
    each = coded.select("term", "block", F.explode(decode(F.col("data"))).alias("p"))
    return each.select("term", (F.col("block") * rows + F.col("p.doc_id") - 1).alias("doc_id"), F.col("p.freq").alias("freq"))


def assign_ids(urls: DataFrame, order: str, name: str = "doc_id", start: int = 0) -> DataFrame:
    """WN4: ``urls`` with dense ids from ``start`` in the order of the distinct column ``order``."""
    return running(urls, order, F.lit(1), name).withColumn(name, F.col(name) + start)


def compressed_sizes(postings: DataFrame) -> DataFrame:
    """FN-VB1: term, df, bytes of its list in the byte-wise code. Ids are shifted by one, as the code has no zero."""
    shifted = gaps(postings.withColumn("doc_id", F.col("doc_id") + 1))
    size = F.sum(vbyte_size(F.col("gap")) + vbyte_size(F.col("freq"))).cast("long")
    return shifted.groupBy("term").agg(F.count("*").alias("df"), size.alias("bytes"))


def header_offsets(postings: DataFrame) -> DataFrame:
    """WN7: where each term's list starts, in the order of terms."""
    return running(compressed_sizes(postings), "term", F.col("bytes"), "pos")


def document_norms(postings: DataFrame, n_docs: int | Column, frequencies: DataFrame | None = None) -> DataFrame:
    """AG4, AG5: doc_id, wd, max_freq."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    idf = F.log(n.cast("double") / F.col("df"))
    rows = postings.join(frequencies if frequencies is not None else document_frequencies(postings), "term")
    top = F.greatest(F.lit(1), F.max("freq"))
    return rows.groupBy("doc_id").agg((F.sqrt(F.sum(F.pow(F.col("freq") * idf, 2.0))) / top).alias("wd"), top.alias("max_freq"))


class Index:
    """Postings, frequencies and norms of a collection, each written once to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.n_docs = docs.count()
        self.postings = materialise(term_frequencies(docs, id_col, text_col), "postings")
        self.frequencies = materialise(document_frequencies(self.postings), "frequencies")
        self._norms: DataFrame | None = None

    @property
    def norms(self) -> DataFrame:
        """Written when they are first asked for, as boolean queries need none."""
        if self._norms is None:
            self._norms = materialise(document_norms(self.postings, self.n_docs, self.frequencies), "norms")
        return self._norms


def write_index(postings: DataFrame, path: str, n_docs: int) -> None:
    """SNK4-SNK6: vocabulary, coded lists and norms as tables under ``path``, in ranges of terms and of documents, so that
    a filter on them skips all files and row groups but a few."""
    spark = postings.sparkSession
    postings = materialise(postings.select("term", "doc_id", "freq"), "postings")
    frequencies = materialise(document_frequencies(postings), "frequencies")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(df: DataFrame, name: str, *keys: str) -> None:
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/{name}")

    save(vocabulary(frequencies).join(frequencies, "term"), "vocabulary", "term")
    save(materialise(coded_lists(postings), "lists"), "lists", "term", "block")
    save(document_norms(postings, n_docs, frequencies), "norms", "doc_id")
    spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs")).write.parquet(f"{path}/total")


class StoredIndex:
    """SRC9, SRC10: an index that ``write_index`` wrote; queries decode the lists of their terms only, as their filter
    on terms reaches the scan of the lists."""

    def __init__(self, spark: SparkSession, path: str):
        self.frequencies = spark.read.parquet(f"{path}/vocabulary")
        self.postings = decoded_lists(spark.read.parquet(f"{path}/lists"))
        self.norms = spark.read.parquet(f"{path}/norms")
        self.n_docs = spark.read.parquet(f"{path}/total").first()["n_docs"]
