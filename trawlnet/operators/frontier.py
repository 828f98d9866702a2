"""The crawl frontier and crawl statistics in batch.

The frontier is a table (host, path, seq) with host states (host, next_ts, queue_len). Adding is a grouped
de-duplication and an anti-join with what is known; popping orders the hosts that are due and takes each one's first
path, as one grouped minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.functions.text import host_of, path_of

#: Seconds between two requests to a host.
POLITE_S = 30


def frontier_add(links: DataFrame, known: DataFrame | None = None, suffix: str = "", url_col: str = "url") -> DataFrame:
    """ST1, FLT3, FLT6, JN11: host, path, seq of links not yet known, each once."""
    rows = links.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col("seq"))
    rows = rows.where(F.col("host") != "").where(F.col("host").endswith(suffix))
    rows = rows.groupBy("host", "path").agg(F.min("seq").alias("seq"))
    return rows.join(known.select("host", "path"), ["host", "path"], "left_anti") if known is not None else rows


def host_queues(frontier: DataFrame) -> DataFrame:
    """AG8, SO7: host, queue_len, and the path that was queued first."""
    return frontier.groupBy("host").agg(F.count("*").alias("queue_len"), F.min_by("path", "seq").alias("next_path"), F.min("seq").alias("ts"))


def priority(policy: str) -> list[Column]:
    """SO5 largest site first (``lsf``), SO6 oldest first (``bf``); ties by host."""
    if policy == "lsf":
        return [F.desc("queue_len"), F.asc("ts"), F.asc("host")]
    if policy == "bf":
        return [F.asc("ts"), F.desc("queue_len"), F.asc("host")]
    raise ValueError(policy)


def frontier_pop(queues: DataFrame, now: Column | None = None, policy: str = "lsf", k: int | None = None) -> DataFrame:
    """ST2-ST4: the hosts that are due with the path to fetch, in order; the first ``k``, if given."""
    due = queues.where(F.col("ts") <= now) if now is not None else queues
    ordered = due.orderBy(*priority(policy))
    return ordered.limit(k) if k is not None else ordered


def hosts_grouped(pages: DataFrame, url_col: str = "url", suffix: str = "") -> DataFrame:
    """AG8: host and its number of distinct URLs."""
    host = host_of(F.col(url_col))
    return pages.where(host.endswith(suffix)).groupBy(host.alias("host")).agg(F.countDistinct(url_col).alias("urls"))


def politeness_violations(requests: DataFrame, host: str, ts: str, seconds: int = POLITE_S) -> DataFrame:
    """ST2: requests that came less than ``seconds`` after the one before to the same host."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy(host).orderBy(ts))
    return requests.withColumn("gap_us", gap).where(F.col("gap_us") < seconds * 1_000_000)


def minute_rates(log: DataFrame, ts: str = "ts") -> DataFrame:
    """AG16, ST10, ST11: events by minute."""
    return log.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def counter_samples(log: DataFrame, seconds: int = 10, ts: str = "ts") -> DataFrame:
    """ST10, T13: by spans of ``seconds`` in which the log (ts, status ``SEEN``, ``CRAW``, ``DOWN``) has rows: pages seen,
    crawled and downloaded in the span, and up to its end. A day has few spans, whose running sums are one window."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    spans = log.groupBy(F.window(ts, f"{seconds} seconds")["start"].alias("span")).agg(F.count("*").alias("seen"), n("CRAW", "DOWN").alias("crawled"), n("DOWN").alias("downloaded"))
    so_far = Window.partitionBy(F.to_date("span")).orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    days = spans.groupBy(F.to_date("span").alias("_day")).agg(*[F.sum(c).alias(f"_{c}") for c in ("seen", "crawled", "downloaded")])
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    earlier = days.select("_day", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in ("seen", "crawled", "downloaded")])
    joined = spans.withColumn("_day", F.to_date("span")).join(F.broadcast(earlier), "_day")
    totals = [(F.sum(c).over(so_far) + F.col(f"_{c}")).alias(f"total_{c}") for c in ("seen", "crawled", "downloaded")]
    return joined.select("span", "seen", "crawled", "downloaded", *totals)


def log_lines(log: DataFrame) -> DataFrame:
    """SNK10: lines of a log (ts, status, doc_id, url): seconds since 1970, status, id and URL with blanks between."""
    return log.select(F.concat_ws(" ", F.unix_timestamp(F.col("ts").cast("timestamp")), "status", "doc_id", "url").alias("value"))


def counter_deltas(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """WN5: the change of a counter from one sample of a key to the next."""
    w = Window.partitionBy(key).orderBy(order)
    return samples.withColumn("delta", F.col(value) - F.lag(value).over(w))


def pending(listed: DataFrame, downloaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST9: after a restart, the known paths (host, path) of all listed pages (doc_id, url), and those (host, path,
    seq) that are still to be fetched, in the order of their ids."""
    rows = frontier_add(listed.select("url", F.col("doc_id").alias("seq")))
    left = listed.join(downloaded.select("doc_id"), "doc_id", "left_anti").select("url", F.col("doc_id").alias("seq"))
    return rows.select("host", "path"), frontier_add(left)


def crawl_counters(log: DataFrame, queues: DataFrame, now: Column | None = None) -> DataFrame:
    """AG15, T13: one row: pages seen, crawled and downloaded by the log (status ``SEEN``, ``CRAW``, ``DOWN``), hosts,
    paths queued, and hosts that are due or wait. Both inputs are summed before they meet."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    pages = log.agg(F.count("*").alias("seen"), n("CRAW", "DOWN").alias("crawled"), n("DOWN").alias("downloaded"))
    due = F.col("ts") <= now if now is not None else F.lit(True)
    hosts = queues.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("queue_len"), F.lit(0)).alias("queued"), F.count_if(due).alias("active"), F.count_if(~due).alias("idle"))
    return pages.join(F.broadcast(hosts))


def log_rows(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """T11: ts, status, doc_id, url of handled requests (doc_id, url, downloaded)."""
    ts = now if now is not None else F.current_timestamp()
    return requests.select(ts.alias("ts"), F.when(F.col("downloaded"), "DOWN").otherwise("CRAW").alias("status"), "doc_id", "url")


def error_rows(failures: DataFrame, now: Column | None = None) -> DataFrame:
    """T12: ts, doc_id, url, msg of failed requests (doc_id, url, msg); null messages are empty."""
    ts = now if now is not None else F.current_timestamp()
    return failures.select(ts.alias("ts"), "doc_id", "url", F.coalesce("msg", F.lit("")).alias("msg"))
