"""URL filters by a temporal list join, in DataFrame expressions only.

A block list is a log of dated entries that add or remove a domain. Each domain's entries
become validity intervals. Captures are first reduced to distinct (host, day); a host's
parent domains and the intervals' time buckets turn "the entry active at fetch time" into an
equi-join with a range check among the few intervals of one domain and bucket; a domain
above a great many hosts is joined by broadcast. The verdicts go back to all captures by (host, day). Neither a hot host nor a long-lived entry
makes pairs of captures and entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.shared import durable

#: Days of a time bucket.
BUCKET = 32
#: Pairs of domain and bucket that are joined by broadcast, at most: each has more than one part in so many of all keys. A pair has at most half as many intervals as days.
HOT_KEYS = 4096


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without a dot at its end, an IPv6 address in its brackets; or null."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to) from entries (domain, action, day): the days, from ``valid_from`` up to but not on ``valid_to``, on which a domain is listed.

    Days are dates; ``action`` is add or remove, and another or null action, a null domain
    or a null day is passed over. On a day with both the domain is added. Repeated adds and
    removes of the same state change nothing. ``valid_to`` is null while no removal follows.
    """
    known = entries.filter(F.col("action").isin("add", "remove") & F.col("domain").isNotNull() & F.col("day").isNotNull())
    daily = known.groupBy(F.lower("domain").alias("domain"), F.col("day").cast("date").alias("day")).agg(F.max(F.col("action") == "add").alias("listed"))
    order = Window.partitionBy("domain").orderBy("day")  # at most a row for each day
    changes = daily.withColumn("was", F.coalesce(F.lag("listed").over(order), F.lit(False))).filter("listed <> was")
    return changes.withColumn("valid_to", F.lead("day").over(order)).filter("listed").select("domain", F.col("day").alias("valid_from"), "valid_to")


def parent_domains(host: Column) -> Column:
    """The host and its parent domains of at least two labels, the longest first; a single label alone is itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, n)))


def _joined(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """``keys`` with the rows of ``listed`` of their domain and bucket; pairs that very many keys have are joined by broadcast."""
    on = ["domain", "bucket"]
    sizes = durable(keys.join(listed.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.filter(F.col("n") > max(1000, total // HOT_KEYS)).select(*on)
    cold = keys.join(F.broadcast(hot), on, "left_anti").join(listed, on)
    return cold.unionByName(keys.join(F.broadcast(listed.join(F.broadcast(hot), on, "left_semi")), on).select(*cold.columns))


def apply(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture_id, host, fetched, blocked, n_entries, rule, listed_since) of each capture (capture_id, url, fetched).

    ``n_entries`` counts the listed domains that hold the capture's host on the day it was
    fetched, ``rule`` is the longest of them and ``listed_since`` the day its interval
    began. A capture without a host or day, or whose list is empty, isn't blocked. Rows
    that repeat an id each give a row.
    """
    day = F.col("fetched").cast("date")
    rows = captures.select("capture_id", host_of(F.col("url")).alias("host"), day.alias("fetched"))
    asked = durable(rows.filter("host is not null and fetched is not null").select("host", "fetched").distinct())
    bucket = lambda d: F.floor(F.unix_date(d) / BUCKET)
    first, last = asked.agg(F.min("fetched"), F.max("fetched")).first()
    if first is None:
        listed = None
    else:
        valid = intervals(entries).select("domain", "valid_from", "valid_to")
        begin, end = F.greatest("valid_from", F.lit(first)), F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
        spread = valid.filter(begin <= end).select("*", F.explode(F.sequence(bucket(begin), bucket(end))).alias("bucket"))
        keys = asked.select("host", "fetched", bucket(F.col("fetched")).alias("bucket"), F.explode(parent_domains(F.col("host"))).alias("domain"))
        spread = durable(spread)
        active = _joined(keys, spread).filter("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
        longest = F.max(F.struct(F.length("domain"), "domain", "valid_from"))
        listed = active.groupBy("host", "fetched").agg(F.count("*").alias("n_entries"), longest.alias("best"))
        listed = listed.select("host", "fetched", "n_entries", F.col("best.domain").alias("rule"), F.col("best.valid_from").alias("listed_since"))
    if listed is None:
        none = F.lit(None)
        return rows.select("*", F.lit(False).alias("blocked"), F.lit(0).cast("long").alias("n_entries"), none.cast("string").alias("rule"), none.cast("date").alias("listed_since"))
    n = F.coalesce("n_entries", F.lit(0))
    return rows.join(listed, ["host", "fetched"], "left").select("capture_id", "host", "fetched", (n > 0).alias("blocked"), n.alias("n_entries"), "rule", "listed_since")
