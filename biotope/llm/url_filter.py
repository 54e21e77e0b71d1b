"""URL filters by dated lists: entries become validity intervals, and every capture is held against those valid when it was fetched.

A list is a log of (list, key, action, at): "add" makes a key active, "remove" ends that. Keys are hosts, which stand for their
subdomains too ("example.com"), or hosts with a path, which stand for what is below it ("example.com/a/b"). A capture's own keys
are all suffixes of its host and all its host's path prefixes; the as-of join is an equi-join on the key and the month, within
which the fetch time decides. Intervals are cut at month ends and end at the first and last capture, so a key's old and future ones never meet a capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
#: A key that is still active ends here.
FOREVER = "9999-12-01 00:00:00"


def host(url: Column) -> Column:
    """The host in lower case without a last dot; null if the URL has none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", ""), F.lit(""))


def keys(url: Column) -> Column:
    """All keys that a URL answers to: host suffixes, and the host with every path prefix at a slash."""
    h = host(url)
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(h.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (exclusive): when each key is active.

    entries: list, key, action, at. At equal times a removal counts last; an add while active and a removal while inactive change
    nothing; rows with a null are left out; repeated rows change nothing. Keys are compared in lower case up to their first slash.
    """
    log = entries.select("list", F.concat(F.lower(F.substring_index("key", "/", 1)), F.expr("substr(key, length(substring_index(key, '/', 1)) + 1)")).alias("key"), "action", F.col("at").cast("timestamp").alias("at"))
    log = log.where("list is not null and key is not null and at is not null and action in ('add', 'remove')")
    # the last action at a time decides
    states = log.groupBy("list", "key", "at").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    order = Window.partitionBy("list", "key").orderBy("at")
    turns = states.withColumn("was", F.lag("on", 1, 0).over(order)).where("on <> was")
    return turns.withColumn("until", F.coalesce(F.lead("at").over(order), F.lit(FOREVER).cast("timestamp"))).where("on = 1").select("list", "key", F.col("at").alias("since"), "until")


def match(captures: DataFrame, entries: DataFrame, few_rows: int = BROADCAST_ROWS) -> DataFrame:
    """url, fetched_at, lists (active lists that have a key of the URL, in order), rule (the longest such key; ties: the first), for the
    distinct captures that any list matches. captures: url, fetched_at; nulls match nothing."""
    distinct = captures.select(F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at")).where("url is not null and fetched_at is not null").distinct()
    asked = distinct.select("url", "fetched_at", F.explode(keys(F.col("url"))).alias("key"), F.trunc("fetched_at", "month").alias("month"))
    valid = intervals(entries)
    time = F.col("fetched_at").cast("timestamp")
    fetched = captures.agg(F.min(time).alias("first"), F.max(time).alias("last"))
    # an interval needs no months before the first capture or after the last one
    months = F.sequence(F.trunc(F.greatest("since", "first"), "month"), F.trunc(F.least("until", "last"), "month"), F.expr("interval 1 month"))
    monthly = valid.crossJoin(F.broadcast(fetched)).where("since <= last and until > first").select("list", "key", "since", "until", F.explode(months).alias("month"))
    monthly = cut(monthly, "monthly")
    few = monthly.limit(few_rows + 1).count() <= few_rows
    if not few:
        # every URL asks for its top-level domain, which would be one key of a join for a whole country's URLs: lists have few such keys
        tops = cut(monthly.where("key not like '%.%' and key not like '%/%'").select("key").distinct(), "tops")
        if tops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            top = asked.where("key not like '%.%' and key not like '%/%'").join(F.broadcast(tops), "key", "left_semi").select(*asked.columns)
            asked = asked.where("key like '%.%' or key like '%/%'").union(top)
    at_time = (F.col("since") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("until"))
    hit = asked.join(F.broadcast(monthly) if few else monthly, ["key", "month"]).where(at_time)
    return hit.groupBy("url", "fetched_at").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.min(F.struct((-F.length("key")).alias("n"), F.col("key").alias("key")))["key"].alias("rule"))


def evaluate(captures: DataFrame, entries: DataFrame, few_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures with lists (array<string>, empty if none), rule (null if none) and blocked; all rows and columns stay, equal rows too.

    Columns of captures named lists, rule or blocked are replaced. A null URL or fetch time, and a URL without a host, is not blocked.
    Very long URLs answer to all their keys; of empty tables of entries nothing is blocked, of captures nothing returned. few_rows: list months that
    are broadcast; more are joined, where a key with very many captures is split by Spark's skew join.
    """
    found = match(captures, entries, few_rows).select(F.col("url").alias("_u"), F.col("fetched_at").alias("_t"), "lists", "rule")
    base = captures.drop("lists", "rule", "blocked")
    joined = base.join(found, (base["url"] == found["_u"]) & (base["fetched_at"].cast("timestamp") == found["_t"]), "left").drop("_u", "_t")
    return joined.withColumn("blocked", F.col("lists").isNotNull()).withColumn("lists", F.coalesce("lists", F.array().cast("array<string>")))
