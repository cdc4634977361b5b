"""Benchmark summaries. Percentiles are exact, over all rows; merging per-worker percentiles would not be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOW_US, HIGH_US = 1, 60_000_000


def latency_percentiles(rows: DataFrame, by: list[str], value: str = "latency_us", exact: bool = True) -> DataFrame:
    """p50, p90, p99, p999, max and mean of latencies clamped to 1 us .. 60 s.

    Exact: the smallest value with at least that share at or below it. Rows are
    counted by value before they are shuffled, and only the different values of a
    group are put in order.
    ``exact=False`` uses bounded sketches, for groups too large to sort.
    """
    x = F.greatest(F.lit(LOW_US), F.least(F.lit(HIGH_US), F.col(value))).cast("long")
    at = (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999))
    clamped = rows.select(*by, x.alias("_x"))
    mean = F.round(F.try_divide(F.sum(F.col("_x") * F.col("_n")), F.sum("_n")), 4).alias("mean")
    if not exact:
        each = clamped.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx("_x", q, 10_000).cast("long").alias(n) for n, q in at), F.max("_x").alias("max"), F.round(F.avg("_x"), 4).alias("mean"))
        return each
    counts = clamped.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)
    share = counts.withColumn("_share", F.sum("_n").over(group.orderBy("_x")) / F.sum("_n").over(group))
    return share.groupBy(*by).agg(F.sum("_n").alias("n"), *(F.min(F.when(F.col("_share") >= q, F.col("_x"))).alias(n) for n, q in at), F.max("_x").alias("max"), mean)


def multi_run_medians(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The upper median of each value over the runs of a group (a row per run)."""
    median = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *(F.when(F.count(c) > 0, median(c)).alias(f"median_{c}") for c in values))


def amplification(rows: DataFrame) -> DataFrame:
    """Physical over logical bytes by label: 1 without logical bytes, null if the physical are unknown."""
    p, n = F.sum("physical"), F.sum("logical")
    return rows.groupBy("label").agg(p.alias("physical"), n.alias("logical"), F.when(p.isNull(), None).when(n == 0, 1.0).otherwise(p / n).alias("amplification"))


def failure_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
