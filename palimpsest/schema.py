"""Relations of the engine. Keys order as unsigned bytes, so BINARY keys sort as in the store; ASCII STRING keys sort the same."""

from __future__ import annotations

from pyspark.sql import types as T


def versions(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    """One row per version. A delete is a row of its own; an empty or null value is not a delete."""
    return T.StructType(
        [
            T.StructField("k", key or T.BinaryType(), False),
            T.StructField("commit_ts", T.LongType(), False),
            T.StructField("is_delete", T.BooleanType(), False),
            T.StructField("v", value or T.BinaryType(), True),
        ]
    )


TXNS = T.StructType([T.StructField("txn", T.LongType(), False), T.StructField("begin_ts", T.LongType(), False), T.StructField("commit_ts", T.LongType(), True), T.StructField("status", T.StringType(), True)])
OPS = T.StructType([T.StructField("txn", T.LongType(), False), T.StructField("op_no", T.LongType(), False), T.StructField("k", T.StringType(), False), T.StructField("op", T.StringType(), False)])
LOG = T.StructType(
    [
        T.StructField("pos", T.LongType(), False), T.StructField("rec", T.StringType(), False), T.StructField("txn", T.LongType(), True), T.StructField("k", T.StringType(), True),
        T.StructField("v", T.StringType(), True), T.StructField("is_delete", T.BooleanType(), True), T.StructField("commit_ts", T.LongType(), True), T.StructField("batch_id", T.LongType(), True),
    ]
)
FILES = T.StructType([T.StructField("level", T.IntegerType(), False), T.StructField("file_num", T.LongType(), False), T.StructField("size", T.LongType(), False), T.StructField("min_key", T.StringType(), False), T.StructField("max_key", T.StringType(), False)])
