"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a grid by the quantiles of all rows,
so that each dimension's cells are about equally full, rows are ordered by the
Hilbert index of their cell, and the order is cut into runs of equal counts.
Each shard then holds a compact region in every dimension, so that the min/max
statistics of its files prune reads that filter on any of them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, materialise, small_batches
from .hilbert import hilbert_index

BITS = 8
SHARDS = 8
#: Rows of a partition are counted in the low bits of monotonically_increasing_id().
ROW_BITS = 33


def on_scale(value: Column, kind: str) -> Column:
    """``value`` as a long: a ``number`` as it is, a ``category`` by its hash (null: that of an empty text)."""
    if kind == "number":
        return F.coalesce(value, F.lit(0)).cast("long")
    return F.xxhash64(F.coalesce(value.cast("string"), F.lit("")))


def grid(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """For each column the bounds of its 2**BITS cells, quantiles of all rows (of a sketch, one row per task)."""
    at = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    row = df.agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in columns)).first()
    return [np.array(row[c] or [], np.int64) for c in columns]


def _keys(batches, dims: list[str], bounds: list[np.ndarray], out: str):
    for batch in batches:
        points = np.stack([np.searchsorted(b, batch.column(c).to_numpy(zero_copy_only=False)) for c, b in zip(dims, bounds, strict=True)], 1)
        key = pa.array(hilbert_index(points.astype(np.uint64), BITS), pa.int64())
        rest = [i for i, n in enumerate(batch.schema.names) if n not in dims]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), key], names=[*(batch.schema.names[i] for i in rest), out])


def with_curve_key(df: DataFrame, dims: list[str], out: str) -> DataFrame:
    """``df`` with its Hilbert index over ``dims`` (long columns, not null) in their place."""
    rest = [f for f in df.schema if f.name not in dims]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{out}` long"])
    return small_batches(df).mapInArrow(partial(_keys, dims=dims, bounds=grid(df, dims), out=out), schema)


def cut_runs(rows: DataFrame, order: list[str], n_shards: int) -> DataFrame:
    """``rows`` sorted by ``order`` and cut into ``n_shards`` runs whose counts are at most one apart: columns ``shard`` and ``slot``.

    The sorted rows are written once, with their place inside their range
    partition; the counts of the partitions (as many as there are partitions)
    then make the places global. ``order`` should end in columns that tell equal
    keys apart, so that a hot key is spread over several ranges.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (place,) = fresh(rows, "place")
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    done = materialise(ranged, "runs")
    part = F.shiftright(F.col(place), ROW_BITS)
    counts = sorted((r.p, r.n) for r in done.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    base, total = [], 0
    for p, n in counts:
        base.append((p, total))
        total += n
    p_, b_, rank = fresh(done, "run_part", "run_base", "run_rank")
    offsets = spark.createDataFrame(base or [(0, 0)], f"{p_} long, {b_} long")
    ranked = done.join(F.broadcast(offsets), part == F.col(p_)).withColumn(rank, F.col(b_) + F.col(place).bitwiseAND((1 << ROW_BITS) - 1))
    starts = [s * total // n_shards for s in range(n_shards)]
    shard = sum((F.when(F.col(rank) >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0))
    ranked = ranked.withColumn("shard", shard.cast("int"))
    first = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("shard") + 1)
    return ranked.withColumn("slot", F.col(rank) - first).drop(place, p_, b_, rank)


def hilbert_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, str] | None = None, n_shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``curve_key``, ``shard`` and ``slot`` of each row of ``docs``; no text is shuffled.

    ``dims``: column -> ``category`` or ``number``; by default language, source and size.
    Size is the UTF-8 bytes of the text plus 1 (null: 1, the crc of an empty
    text). Null metadata share a cell. Equal texts in a cell are neighbours.
    Repeated rows get places of their own, and are told apart by row, so they
    fill no range alone. An empty table gives an empty one.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    dims = {"lang": "category", "source": "category", "size": "number"} if dims is None else dims
    scales = {f"dim{i}": on_scale(size if c == "size" else F.col(c), kind) for i, (c, kind) in enumerate(dims.items())}
    slim = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), *(v.alias(n) for n, v in scales.items()))
    keyed = with_curve_key(slim, list(scales), "curve_key").select("doc_id", "size", "text_crc32", "curve_key", F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    return cut_runs(keyed, ["curve_key", "text_crc32", "size", "doc_id", "row"], n_shards).drop("row")


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", n_shards: int = SHARDS, **options) -> None:
    """Write ``docs``, all columns, as Parquet, one folder a shard, sorted by slot.

    The columns ``shard`` and ``slot`` are added, with a ``_`` before the name
    where ``docs`` has such a column in any case. Rows meet their shard by
    ``id_col``; null or repeated ids raise a ValueError before anything is written.
    """
    if not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        raise ValueError(f"{id_col} has null or repeated values")
    shard, slot = fresh(docs, "shard", "slot")
    at = hilbert_shards(docs, id_col=id_col, n_shards=n_shards, **options).select(F.col("doc_id").alias(id_col), F.col("shard").alias(shard), F.col("slot").alias(slot))
    docs.join(at, id_col).select(*docs.columns, shard, slot).repartition(shard, (F.col(slot) / 100_000).cast("int")).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
