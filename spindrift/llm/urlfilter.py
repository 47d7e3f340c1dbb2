"""URL filters by a temporal join: dated list entries become validity intervals, captures see those of their time.

A list is a log of dated entries: an entry is added to or removed from a category from a date on. The log of an entry
becomes half-open intervals [valid_from, valid_to). A capture is looked up by every key its URL can match: its host, the
parent domains of its host, and its host with each leading part of its path. The join is an equi-join on keys, filtered
by the capture's time.

Defined results: null URLs and URLs without a host match nothing and are allowed; captures without a time match nothing;
entries of one date are one step, and a removal on the same date as an addition wins; additions of an active entry and
removals of an inactive one change nothing; a key's host counts in lower case; addresses match as a whole, without parent
domains; list rows without key, category or date are left out; repeated captures come
back repeated. Capture columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BROADCAST_ROWS = 500_000
"""Intervals that are sent to all executors, about 100 bytes each; more are joined by a shuffle on the key."""


def host(url: Column) -> Column:
    """Lower-case host, without user, port and final dot; null if there is none.

    User data ends at the last @ before the path; a bracketed address is a host with its brackets.
    """
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)", 1)
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def is_address(host: Column) -> Column:
    """Whether a host is a bracketed or dotted address, which has no parent domains."""
    return host.rlike(r"^(\[.*|[0-9]+(\.[0-9]+){3})$")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column, deepest: Column) -> Column:
    """All keys that an entry may have to match the URL: domains, and host/path prefixes that end at a slash or the end.

    deepest is the number of path parts of the entry that has most.
    """
    h, p = host(url), path(url)
    labels, parts = F.split(h, r"\."), F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.size(labels)
    domains = F.when(is_address(h), F.array(h)).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    depth = F.least(F.size(parts), deepest)
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>")))))


def intervals(log: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) from (key, category, action, at); valid_to is null while an entry is active."""
    steps = log.where("key is not null and category is not null and at is not null and action in ('add', 'remove')")
    of = F.substring_index("key", "/", 1)
    steps = steps.withColumn("key", F.concat(F.lower(of), F.substr("key", F.length(of) + 1)))
    steps = steps.groupBy("key", "category", "at").agg(F.min(F.col("action") == "add").alias("on"))
    w = W.partitionBy("key", "category").orderBy("at")
    changed = steps.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    return changed.select("key", "category", "on", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to")).where("on").drop("on")


def evaluate(captures: DataFrame, log: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with the categories active for them at their time, the keys that matched, and whether that blocks them.

    Keys are looked up where the captures are read if there are at most BROADCAST_ROWS intervals. More are joined by a
    shuffle of the captures' keys, of which Spark splits the frequent ones. Hits are gathered by capture.
    """
    valid = materialize(intervals(log), "intervals")
    out = ["categories", "matched", "blocked"]
    kept = captures.select(*[f"`{c}`" for c in captures.columns if c not in out])
    deepest = valid.agg(F.coalesce(F.max(F.size(F.split("key", "/")) - 1), F.lit(0)), F.count("*")).first()
    seen = kept.select(F.col(url).alias("__url"), F.col(at).alias("__at")).where("__url is not null and __at is not null")
    asked = seen.select("__url", "__at", F.explode(keys(F.col("__url"), F.lit(deepest[0]))).alias("key"))
    hits = asked.join(F.broadcast(valid) if deepest[1] <= BROADCAST_ROWS else valid, "key").where((F.col("valid_from") <= F.col("__at")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))))
    found = hits.groupBy("__url", "__at").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("key")).alias("matched"))
    none = F.array().cast("array<string>")
    joined = kept.join(found, (F.col(url) == F.col("__url")) & (F.col(at) == F.col("__at")), "left").drop("__url", "__at")
    return joined.withColumn("categories", F.coalesce("categories", none)).withColumn("matched", F.coalesce("matched", none)).withColumn("blocked", F.size("categories") > 0)
