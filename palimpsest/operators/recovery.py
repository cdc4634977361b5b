"""Replay of a typed log (schema.LOG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay_log(log: DataFrame) -> DataFrame:
    """(k, commit_ts, is_delete, v) that the log installs.

    ``kv`` and ``batch`` records count at once. A ``write`` counts if its
    transaction began before it and committed after it, and takes the commit's
    timestamp; an ``abort`` in between drops it. Orphans and unfinished ones drop.
    """
    now = log.where("rec in ('kv', 'batch')").select("k", "commit_ts", "is_delete", "v")
    begin = log.where("rec = 'begin'").groupBy("txn").agg(F.min("pos").alias("begun"))
    end = log.where("rec in ('commit', 'abort')").groupBy("txn").agg(F.min(F.struct("pos", "rec", F.col("commit_ts").alias("ts"))).alias("fin"))
    writes = log.where("rec = 'write'").select("txn", "pos", "k", "is_delete", "v")
    done = writes.join(begin, "txn").join(end, "txn").where("begun < pos and pos < fin.pos and fin.rec = 'commit'")
    return now.unionByName(done.select("k", F.col("fin.ts").alias("commit_ts"), "is_delete", "v"))


def log_maxima(log: DataFrame) -> DataFrame:
    """Largest timestamp and transaction id of all records, orphans included."""
    return log.agg(F.coalesce(F.max("commit_ts"), F.lit(0)).alias("max_ts"), F.coalesce(F.max("txn"), F.lit(0)).alias("max_txn"))


def survives_crash(log: DataFrame, synced: int) -> DataFrame:
    """What a crash leaves: records up to the last synced position."""
    return log.where(F.col("pos") <= synced)


def commits_per_fsync(log: DataFrame) -> DataFrame:
    """Commits (of transactions and batches), group flushes, and their ratio, 0 without flushes."""
    n, f = F.count_if(F.col("rec").isin("commit", "batch", "kv")), F.count_distinct("batch_id")
    return log.agg(n.alias("commits"), f.alias("fsyncs"), F.coalesce(n / F.nullif(f, F.lit(0)), F.lit(0.0)).alias("commits_per_fsync"))
