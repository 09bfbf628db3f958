"""URL filters over dated lists: entries become validity intervals, captures are judged as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_intervals(entries: DataFrame) -> DataFrame:
    """list_name, pattern, valid_from, valid_to (null: still listed) from dated entries list_name, pattern, action ('add' or 'remove'), at.

    An entry holds until the next entry of the same list and pattern; at equal times an addition wins over a
    removal. Entries with a null pattern or time, or another action, have no effect; repeated ones none more.
    """
    known = entries.filter(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    states = known.groupBy("list_name", "pattern", "at").agg(F.max(F.col("action") == "add").alias("listed"))
    later = Window.partitionBy("list_name", "pattern").orderBy("at")
    return states.withColumn("valid_to", F.lead("at").over(later)).filter("listed").select("list_name", "pattern", F.col("at").alias("valid_from"), "valid_to")


def url_host(url: Column) -> Column:
    """The lower-case host of a url without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.rtrim(host, F.lit("."))
    return F.when(host != "", host)


def url_keys(url: Column, host: Column) -> Column:
    """All patterns that cover a url: its host and every parent domain, and its host followed by each path prefix that ends at a slash or at the path's end."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    paths = F.transform(F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.array_distinct(F.concat(domains, paths))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """page_id, host, blocked, n_hits, list_name, pattern, listed_at: one row per capture, also of those that no entry blocks.

    A capture is blocked by every list that has a covering pattern listed at its fetch time; the first by list
    name, pattern and time is named. Captures with a null or hostless url, or without a time, are not blocked.
    A host with most of the captures is split by adaptive skew handling, as the list side has few rows a key.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at")).withColumn("host", url_host(F.col("url")))
    keys = rows.select("row_id", "page_id", "host", "fetched_at", F.explode_outer(url_keys(F.col("url"), F.col("host"))).alias("key"))
    spans = list_intervals(entries)
    active = (F.col("key") == F.col("pattern")) & (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = keys.join(spans, active, "left")
    found = F.when(F.col("pattern").isNotNull(), F.struct("list_name", "pattern", "valid_from"))
    judged = hits.groupBy("row_id", "page_id", "host").agg(F.min(found).alias("first"), F.count("pattern").alias("n_hits"))
    return judged.select("page_id", "host", (F.col("n_hits") > 0).alias("blocked"), "n_hits", F.col("first.list_name").alias("list_name"), F.col("first.pattern").alias("pattern"), F.col("first.valid_from").alias("listed_at"))


def sample_times(pages: DataFrame) -> DataFrame:
    """Fetch times for a table without them: a second of the year 2024 fixed by page_id."""
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(366)) * 86400 + F.pmod(F.col("page_id"), F.lit(86400))))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated lists for a table without them: every host and first path step of the pages is added, removed and perhaps added again at days fixed by its MD5."""
    urls = pages.select(F.col("url"), url_host(F.col("url")).alias("host")).filter("host is not null")
    step = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    patterns = urls.select(F.explode(F.array(F.col("host"), F.when(step != "", F.concat("host", F.lit("/"), step)))).alias("pattern")).filter("pattern is not null").distinct()
    crc = F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long")
    start = crc % 200
    day = lambda d: F.timestamp_seconds(F.lit(1704067200) + d * 86400)
    entry = lambda action, d: F.struct(F.lit(action).alias("action"), day(d).alias("at"))
    dated = F.array(entry("add", start), entry("remove", start + 20 + crc % 50), F.when(crc % 3 == 0, entry("add", start + 100)))
    return patterns.filter(crc % 4 != 0).select(F.when(crc % 2 == 0, F.lit("spam")).otherwise(F.lit("adult")).alias("list_name"), "pattern", F.explode(dated).alias("e")).filter("e is not null").select("list_name", "pattern", "e.action", "e.at")
