"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries: on a day a pattern was blocked, allowed or
taken off.  Per list and pattern each entry holds from its day until the next
entry of that pattern: validity intervals.  A capture is evaluated against the
entries that were active when it was fetched, which is an as-of join: equality on
the pattern, the fetch time within the interval.

Patterns: a host (with all hosts below it), or a host and the start of a path, as
`example.com` or `example.com/ads/`.  A URL has few such keys, so they are joined
by equality and no pattern is ever tried on all URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.llm.common import small_enough, stored

def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(host, r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment; / if there is none."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def suffixes(host: Column, labels: int) -> Column:
    """The host and the domains above it, of two labels at least and `labels` at most."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    first = F.greatest(F.lit(1), n - labels + 1)
    return F.when(host == "", F.array().cast("array<string>")).when(n < 2, F.array(host)).when(first > n - 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(first, n - 1), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def folders(path: Column, depth: int) -> Column:
    """`/`, `/a/`, `/a/b/` and so on, of `depth` slashes at most, and the path itself."""
    parts = F.split(path, "/")
    last = F.least(F.size(parts) - 1, F.lit(depth))
    starts = F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    return F.array_distinct(F.concat(starts, F.array(path)))


def keys(url: Column, labels: int = 127, depth: int = 64) -> Column:
    """All patterns that match the URL, of that many labels and slashes at most."""
    ends = suffixes(host_of(url), labels)
    paths = folders(path_of(url), depth)
    return F.array_distinct(F.concat(ends, F.flatten(F.transform(ends, lambda h: F.transform(paths, lambda p: F.concat(h, p))))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, from, until) of (list, pattern, action, since); until is null for the last entry of a pattern.

    Of entries of one list, pattern and time, the greatest action counts (remove before block before allow).  Rows with a
    null in list, pattern, action or time are left out, as are intervals of `remove`: there nothing is active.
    """
    clean = entries.where("list is not null and pattern is not null and action is not null and since is not null")
    one = clean.groupBy("list", F.lower(F.trim("pattern")).alias("pattern"), "since").agg(F.max_by("action", F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)).alias("action"))
    w = W.partitionBy("list", "pattern").orderBy("since")
    return one.withColumn("until", F.lead("since").over(w)).where("action <> 'remove'").select("list", "pattern", "action", F.col("since").alias("from"), "until")


def evaluated(captures: DataFrame, valid: DataFrame, url: str = "url", at: str = "fetched_at", most_broadcast: int = 1_000_000) -> DataFrame:
    """captures with n_active, blocked_by, allowed_by and verdict (allow, block or none) added.

    An allowing entry beats a blocking one if its pattern is as long or longer.  blocked_by and allowed_by are the longest such
    patterns, ties broken by name.  A null or unreadable URL, or a null time, has no active entry.  Repeated rows stay repeated.

    The lists are broadcast if they are small, else both sides are dealt by pattern.  Captures that share a URL and a time
    are joined once, so a common host costs a row for each different capture only.
    """
    captures = captures.drop("n_active", "blocked_by", "allowed_by", "verdict")
    valid = stored(valid, "intervals")
    small = small_enough(valid, most_broadcast)
    # No longer patterns are tried than there are, so a URL costs no more for having a thousand folders.
    size = valid.agg(F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))), F.max(F.size(F.split("pattern", "/")) - 1)).head()
    labels, depth = size[0] or 0, size[1] or 0
    lists = (F.broadcast(valid) if small else valid).withColumnRenamed("pattern", "key").withColumnRenamed("from", "__from").withColumnRenamed("until", "__until").select("key", "action", "__from", "__until")
    tried = captures.select(F.col(url).alias("u"), F.col(at).alias("t")).where("u is not null and t is not null").distinct()
    tried = tried.select("u", "t", F.explode(keys(F.col("u"), labels, depth)).alias("key"))
    active = tried.join(lists, "key").where("t >= __from and (__until is null or t < __until)")
    rank = F.struct(F.length("key").alias("n"), F.col("key").alias("k"))
    found = active.groupBy("u", "t").agg(F.count("*").alias("n_active"), F.max(F.when(F.col("action") == "block", rank)).alias("b"), F.max(F.when(F.col("action") == "allow", rank)).alias("a"))
    verdict = F.when(F.col("a.n").isNotNull() & (F.col("b.n").isNull() | (F.col("a.n") >= F.col("b.n"))), "allow").when(F.col("b.n").isNotNull(), "block").otherwise("none")
    found = found.select(F.col("u").alias(url), F.col("t").alias(at), "n_active", F.col("b.k").alias("blocked_by"), F.col("a.k").alias("allowed_by"), verdict.alias("verdict"))
    return captures.join(found, [url, at], "left").withColumns({"n_active": F.coalesce("n_active", F.lit(0)), "verdict": F.coalesce("verdict", F.lit("none"))})
