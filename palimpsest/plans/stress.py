"""Stress histories of overlapping transactions, many seeds at once, and what a commit rule makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import uniform
from palimpsest.operators import history
from palimpsest.plans.workload import cut


def stress_history(spark: SparkSession, seeds: int, batches: int = 10, per_batch: int = 4, keys: int = 5, ops: int = 3) -> tuple[DataFrame, DataFrame]:
    """(ops, txns) of ``seeds`` histories: in each batch ``per_batch`` transactions begin together and then commit in turn.

    An operation goes to the transaction's own key seven times in ten; it is a
    read with probability 0.8 in even and 0.3 in odd rounds. ``history`` numbers
    the seeds; keys are of one history only, and so are transactions.
    """
    t = spark.range(seeds * batches * per_batch)
    i = F.col("id")
    seat, batch, seed = i % per_batch, F.floor(i / per_batch) % batches, F.floor(i / (per_batch * batches))
    t = t.select(i.alias("txn"), seed.alias("history"), batch.alias("batch"), seat.alias("seat"))
    clock = F.col("batch") * (2 * per_batch)
    txns = t.select("txn", "history", (clock + F.col("seat")).alias("begin_ts"), (clock + per_batch + F.col("seat")).alias("commit_ts"))
    each = t.select("txn", "history", "batch", "seat", F.explode(F.sequence(F.lit(0), F.lit(ops - 1))).alias("n"))
    own = uniform(11, F.col("txn"), F.col("n"), 1) < 0.7
    key = F.when(own, F.col("seat") % keys).otherwise(F.floor(uniform(11, F.col("txn"), F.col("n"), 2) * keys))
    share = F.when(F.col("batch") % 2 == 0, 0.8).otherwise(0.3)
    op = F.when(uniform(11, F.col("txn"), F.col("n"), 3) < share, "r").otherwise("w")
    return each.select("txn", F.col("n").cast("long").alias("op_no"), F.format_string("h%d:k%d", F.col("history"), key.cast("long")).alias("k"), op.alias("op")), txns


def stress(ops: DataFrame, txns: DataFrame, mode: str = "ssi") -> DataFrame:
    """Per history: transactions, aborts, abort rate, and committed transactions on or between dependency cycles."""
    done = cut(history.replay(ops, txns, mode, "history"))
    good = done.where("committed").select("txn")
    left = history.in_cycles(history.adjacent_edges(ops.join(good, "txn", "left_semi"), txns.join(good, "txn", "left_semi")), txns.join(good, "txn", "left_semi"))
    cyclic = left.join(done.select("txn", "history"), "txn").groupBy("history").agg(F.count(F.lit(1)).alias("_c"))
    gone = F.count_if(~F.col("committed"))
    per = done.groupBy("history").agg(F.count(F.lit(1)).alias("n_txns"), gone.alias("n_aborted"), (gone / F.count(F.lit(1))).alias("abort_rate"))
    return per.join(cyclic, "history", "left").select("history", "n_txns", "n_aborted", "abort_rate", F.coalesce("_c", F.lit(0)).alias("n_cyclic"))
