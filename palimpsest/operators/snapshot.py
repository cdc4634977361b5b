"""Reads of a version table at a timestamp.

A filter on the key may go below the ranking, a filter on ``commit_ts`` must, and
the one on ``is_delete`` comes after it. Ranking keeps one row per key on both
sides of the shuffle (WindowGroupLimit), so a key with many versions is thinned
before it is sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(df: DataFrame, by: list[str], order: str = "commit_ts") -> DataFrame:
    """The row with the largest ``order`` of each group."""
    w = W.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def bounds(key: str, start=None, end=None, start_inclusive: bool = True, end_inclusive: bool = False) -> Column:
    """A range of keys; None is unbounded. Reaches the scan as a pushed filter."""
    c, out = F.col(key), F.lit(True)
    if start is not None:
        out = out & (c >= F.lit(start) if start_inclusive else c > F.lit(start))
    if end is not None:
        out = out & (c <= F.lit(end) if end_inclusive else c < F.lit(end))
    return out


def versions_at(versions: DataFrame, ts: int) -> DataFrame:
    """Newest version per key with commit_ts <= ts, tombstones included."""
    return newest(versions.where(F.col("commit_ts") <= ts), ["k"])


def snapshot(versions: DataFrame, ts: int, **range_) -> DataFrame:
    """Live keys at ``ts``, optionally within :func:`bounds`; unordered."""
    if range_:
        versions = versions.where(bounds("k", **range_))
    return versions_at(versions, ts).where(~F.col("is_delete"))


def scan(versions: DataFrame, ts: int, **range_) -> DataFrame:
    """:func:`snapshot` in key order."""
    return snapshot(versions, ts, **range_).orderBy("k")


def get(versions: DataFrame, key, ts: int) -> DataFrame:
    """The live row of one key, or none. One key needs no shuffle by key: a top-1 of each partition and of those."""
    hit = versions.where((F.col("k") == F.lit(key)) & (F.col("commit_ts") <= ts)).orderBy(F.desc("commit_ts")).limit(1)
    return hit.where(~F.col("is_delete"))


def as_of_many(requests: DataFrame, versions: DataFrame, width: int | None = None) -> DataFrame:
    """For each request (req, k, ts) the version it sees: status, commit_ts, v.

    One union, one shuffle by key and one ordered pass with the last version so
    far, instead of a join that meets every request with every older version of
    its key. ``req`` and ``k`` must not be null.

    With ``width`` a key is cut into spans of so many timestamps that are passed
    over in parallel, so that a key with a large part of all versions is no single
    task: the last version of each span (a partial maximum) is carried into the
    key's next spans.
    """
    kind = versions.schema["v"].dataType
    ver = F.struct("commit_ts", "is_delete", "v")
    has = versions.select("k", F.col("commit_ts").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(requests.schema["req"].dataType).alias("req"), ver.alias("ver"))
    asks = requests.select("k", F.col("ts").alias("t"), F.lit(1).alias("kind"), "req", F.lit(None).cast(has.schema["ver"].dataType).alias("ver"))
    both, by = has.unionByName(asks), ["k"]
    if width:
        both, by = both.withColumn("span", F.floor(F.col("t") / width)), ["k", "span"]
    w = W.partitionBy(*by).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("at", F.last("ver", True).over(w)).where("kind = 1")
    if width:
        ends = both.groupBy("k", "span").agg(F.max(F.when(F.col("kind") == 0, F.col("t"))).alias("end"))
        before = W.partitionBy("k").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
        carry = ends.withColumn("end", F.max("end").over(before)).where("end is not null")
        carry = carry.join(versions.select("k", F.col("commit_ts").alias("end"), ver.alias("came")), ["k", "end"]).select("k", "span", "came")
        seen = seen.join(carry, ["k", "span"], "left").withColumn("at", F.coalesce("at", "came"))
    return seen.select("req", "k", F.col("t").alias("ts"), status(F.col("at")).alias("status"), F.col("at.commit_ts").alias("commit_ts"), F.when(~F.col("at.is_delete"), F.col("at.v")).cast(kind).alias("v"))


def status(version: Column) -> Column:
    """Found, Deleted or NotFound of a version struct; a tombstone is an answer, not an absence."""
    return F.when(version.isNull(), "NotFound").when(version["is_delete"], "Deleted").otherwise("Found")


def lookup_status(keys: DataFrame, versions: DataFrame, ts: int) -> DataFrame:
    """Status of each of ``keys`` (k) at ``ts``."""
    at = versions_at(versions, ts).select("k", F.struct("commit_ts", "is_delete").alias("ver"))
    return keys.select("k").distinct().join(at, "k", "left").select("k", status(F.col("ver")).alias("status"), F.col("ver.commit_ts").alias("commit_ts"))


def has_write_after(versions: DataFrame, ts: int) -> DataFrame:
    """Keys with any version after ``ts``; rewriting the same value counts."""
    return versions.where(F.col("commit_ts") > ts).select("k").distinct()


def iter_versions(versions: DataFrame, limit: int, key=None) -> DataFrame:
    """Up to ``limit`` newest versions of each key (or of one), without repeats."""
    df = versions if key is None else versions.where(F.col("k") == F.lit(key))
    w = W.partitionBy("k").orderBy(F.desc("commit_ts"))
    return df.dropDuplicates(["k", "commit_ts"]).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


def overlay(base: DataFrame, own: DataFrame) -> DataFrame:
    """A snapshot (k, v) under a transaction's own writes (k, is_delete, v): its puts win, its deletes hide."""
    mine = own.select("k", F.lit(True).alias("_mine"), F.col("is_delete").alias("_gone"), F.col("v").alias("_v"))
    both = base.select("k", "v").join(mine, "k", "full_outer")
    return both.where(~F.coalesce("_gone", F.lit(False))).select("k", F.when(F.col("_mine"), F.col("_v")).otherwise(F.col("v")).alias("v"))


def maxima(versions: DataFrame) -> DataFrame:
    """Largest commit_ts and the next timestamp to give."""
    return versions.agg(F.coalesce(F.max("commit_ts"), F.lit(0)).alias("max_commit_ts"), (F.coalesce(F.max("commit_ts"), F.lit(0)) + 1).alias("next_ts"))


def monotonic_violations(versions: DataFrame) -> DataFrame:
    """Timestamps that a key has twice: its versions would not be in strict order."""
    return versions.groupBy("k", "commit_ts").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("k", "commit_ts")
