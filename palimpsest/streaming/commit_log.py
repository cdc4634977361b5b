"""The store's commit log as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.schema import versions
from palimpsest.sources.files import Files

ENTRY = "txn long, ts long, writes array<array<string>>"


def tail(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(k, commit_ts, is_delete, v, txn, nth) of each log entry of a store as it appears; ``nth`` counts the writes of a transaction from 0.

    An entry is a file that is renamed into place, so it is read whole or not at
    all. Flushes leave the log as it is; a stream sees all entries that no vacuum
    has removed. What was removed, and what was loaded in bulk, is in the parts:
    start a new consumer with :func:`backlog`.
    """
    raw = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_trigger).json(f"{path}/log")
    each = raw.select("txn", F.col("ts").alias("commit_ts"), F.posexplode("writes").alias("nth", "w"))
    return each.select(F.unbase64(F.col("w")[0]).alias("k"), "commit_ts", (F.col("w")[1] == "true").alias("is_delete"), F.unbase64(F.col("w")[2]).alias("v"), "txn", "nth")


def backlog(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The versions of a store's parts, and the largest timestamp in them of which the log may have been removed: what a new consumer reads before it follows :func:`tail` beyond that timestamp."""
    files = Files(spark, path.rstrip("/"))
    name = next((n for n in ("MANIFEST", "MANIFEST.old") if files.exists(n)), None)
    parts = json.loads(files.read(name))["parts"] if name else []
    if not parts:
        return spark.createDataFrame([], versions()), 0
    rows = spark.read.schema(versions()).parquet(*(f"{path.rstrip('/')}/parts/{p['name']}" for p in parts))
    return rows, rows.agg(F.max("commit_ts")).first()[0]


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ts, gone, v = state.get if state.exists else (-1, True, None)
    before = ts
    for df in batches:
        top = df.loc[df.commit_ts.idxmax()]
        if top.commit_ts > ts:
            ts, gone, v = int(top.commit_ts), bool(top.is_delete), None if top.is_delete else top.v
    if ts > before:
        state.update((ts, gone, v))
        yield pd.DataFrame({"k": [key[0]], "commit_ts": [ts], "is_delete": [gone], "v": [v]})


def newest_per_key(stream: DataFrame) -> DataFrame:
    """The newest version of each key, told whenever it changes (update mode).

    Versions may come in any order: the state keeps the largest timestamp, and a
    tombstone stays in it so that an older put arriving late can't revive a key.
    """
    kind = stream.schema["v"].dataType.simpleString()
    key = stream.schema["k"].dataType.simpleString()
    return stream.groupBy("k").applyInPandasWithState(_newest, f"k {key}, commit_ts long, is_delete boolean, v {kind}", f"commit_ts long, is_delete boolean, v {kind}", "update", GroupStateTimeout.NoTimeout)


def commits_per_window(stream: DataFrame, size: int) -> DataFrame:
    """Commits and versions per ``size`` timestamps: group commit as a windowed count over the log's own clock."""
    return stream.groupBy(F.floor(F.col("commit_ts") / size).alias("window")).agg(F.count_if(F.col("nth") == 0).alias("commits"), F.count(F.lit(1)).alias("versions"))


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second"):
    """Hand each micro-batch to ``sink`` with its number; equal numbers are the same batch again, so sinks can be made idempotent."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(sink).start()
