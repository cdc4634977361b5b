"""Relations of the engine derived from the benchmark tables: a version log, a transaction history, files and a typed log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _key(c):
    return F.concat(F.lit("user:"), F.lpad(c.cast("string"), 8, "0"))


def version_log(spark: SparkSession, sf_dir: str, upto: int | None = None, after: int | None = None) -> DataFrame:
    """each event is a version of its user, an error event a delete. ``upto`` and ``after`` bound commit_ts and reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if upto is not None:
        e = e.where(F.col("event_id") <= upto - 1)
    if after is not None:
        e = e.where(F.col("event_id") > after - 1)
    gone = F.col("event_type") == "error"
    return e.select(_key(F.col("user_id")).alias("k"), (F.col("event_id") + 1).alias("commit_ts"), gone.alias("is_delete"), F.when(~gone, F.round("value", 2)).alias("v"))


def last_ts(spark: SparkSession, sf_dir: str) -> int:
    """Largest commit_ts of the version log, from file statistics where they answer."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.coalesce(F.max("event_id"), F.lit(-1)) + 1).first()[0]


def history_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """four events make a transaction over 40 keys."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type").isin("view", "click"), "r").when(F.col("event_type") == "error", "d").otherwise("w")
    return e.select(F.floor(F.col("event_id") / 4).alias("txn"), F.col("event_id").alias("op_no"), _key(F.col("user_id") % 40).alias("k"), op.alias("op"))


def history_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 4).alias("txn")).distinct()
    late = F.col("txn") % 4
    return t.select("txn", (10 * F.col("txn")).alias("begin_ts"), (10 * (F.col("txn") + late) + 5 + late).alias("commit_ts"))


def typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each event is three log positions: its transaction (four events) begins, writes, and ends; some abort, some never end, some never began."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _key(F.col("user_id")).alias("k"), "event_type", F.round("value", 2).cast("string").alias("v"), F.floor(F.col("event_id") / 4).alias("txn"))
    i, step = F.col("event_id"), F.col("event_id") % 4
    none, gone = F.lit(None), F.col("event_type") == "error"
    rows = [F.struct((3 * i + 1).alias("pos"), F.lit("write").alias("rec"), F.col("k").alias("k"), F.when(~gone, F.col("v")).alias("v"), gone.alias("is_delete"), none.cast("long").alias("commit_ts"), none.cast("long").alias("batch_id"))]
    ends = F.when(F.col("txn") % 7 == 0, "abort").otherwise("commit")
    edge = lambda pos, rec, ts, batch: F.struct(pos.alias("pos"), rec.alias("rec"), none.cast("string").alias("k"), none.cast("string").alias("v"), none.cast("boolean").alias("is_delete"), ts.alias("commit_ts"), batch.alias("batch_id"))
    rows.append(edge(F.when((step == 0) & (F.col("txn") % 11 != 0), 3 * i), F.lit("begin"), none.cast("long"), none.cast("long")))
    rows.append(edge(F.when((step == 3) & (F.col("txn") % 5 != 0), 3 * i + 2), ends, F.when(F.col("txn") % 7 != 0, F.col("txn") + 1), F.when(F.col("txn") % 7 != 0, F.floor(F.col("txn") / 3))))
    return e.select("txn", F.explode(F.array(*rows)).alias("r")).where("r.pos is not null").select("r.pos", "r.rec", "txn", "r.k", "r.v", "r.is_delete", "r.commit_ts", "r.batch_id")


def file_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three levels: ranges of parts' keys as sizes grow."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    level = F.when(F.col("p_partkey") % 10 == 0, 0).when(F.col("p_partkey") % 10 < 4, 1).otherwise(2)
    low = F.lpad((F.col("p_partkey") * 7 % 1000).cast("string"), 6, "0")
    high = F.lpad((F.col("p_partkey") * 7 % 1000 + F.col("p_size")).cast("string"), 6, "0")
    return p.select(level.cast("int").alias("level"), F.col("p_partkey").alias("file_num"), (F.col("p_retailprice") * 100).cast("long").alias("size"), low.alias("min_key"), high.alias("max_key"))


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: a latency per line item; runs by quarter of the order key, workers by supplier, returns are aborts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select((F.col("l_orderkey") % 4).cast("int").alias("run_id"), (F.col("l_suppkey") % 16).cast("int").alias("worker"), F.col("l_linestatus").alias("op"), F.floor("l_extendedprice").cast("long").alias("latency_us"), (F.col("l_returnflag") == "R").alias("aborted"))
