"""Learned index and Bloom filter over sorted keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.encodings import digest_u128

EPSILON, MIN_KEYS = 64, 256


def segments(keys: list[int], first: int = 0, epsilon: int = EPSILON) -> list[tuple[int, int, float]]:
    """(key_start, start_pos, slope) of greedy segments: each position is within ``epsilon`` of the line.

    From a segment's first key the slopes that fit narrow with each further key;
    when none is left, or the key repeats the first, a segment begins.
    """
    out: list[tuple[int, int, float]] = []
    start = pos0 = low = high = None
    for i, key in enumerate(keys):
        if start is not None and (dx := key - start) > 0:
            lo, hi = max(low, (i - pos0 - epsilon) / dx), min(high, (i - pos0 + epsilon) / dx)
            if lo <= hi:
                low, high = lo, hi
                continue
        if start is not None:
            out.append((start, first + pos0, (low + high) / 2 if high < float("inf") else 0.0))
        start, pos0, low, high = key, i, 0.0, float("inf")
    if start is not None:
        out.append((start, first + pos0, (low + high) / 2 if high < float("inf") else 0.0))
    return out


def predict(segment: tuple[int, int, float], key: int) -> int:
    start, pos, slope = segment
    return pos + max(0, round(slope * (key - start)))


def _built(batches: Iterator[pa.RecordBatch], epsilon: int):
    """Segments of a sorted partition, fed by runs so that only one run is held."""
    for batch in batches:
        pos = batch.column("pos").to_pylist()
        keys = [digest_u128(k) for k in batch.column("k").to_pylist()]
        found = segments(keys, pos[0] if pos else 0, epsilon)
        yield pa.RecordBatch.from_pydict({"key_start": pa.array([s.to_bytes(16, "big") for s, *_ in found], pa.binary()), "start_pos": pa.array([p for _, p, _ in found], pa.int64()), "slope": pa.array([x for *_, x in found], pa.float64())})


def positions(keys: DataFrame, materialise=None) -> DataFrame:
    """Distinct binary keys ``k`` with their place ``pos`` in the global order, without a single-task sort.

    Rows are range-partitioned and numbered inside the partition; partition
    counts, one row each, make the numbers global.
    """
    done = keys.select("k").distinct().repartitionByRange("k").sortWithinPartitions("k").withColumn("_id", F.monotonically_increasing_id())
    done = materialise(done) if materialise else done.checkpoint()
    part = F.shiftright("_id", 33)
    base = done.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return done.withColumn("_p", part).join(F.broadcast(base.select("_p", "_base")), "_p").select("k", (F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("pos"))


def pgm_build(placed: DataFrame, epsilon: int = EPSILON, min_keys: int = MIN_KEYS) -> DataFrame | None:
    """(key_start, start_pos, slope) over ``placed`` (k, pos). None below ``min_keys``, where a plain search does.

    Segments break at batch and partition edges too, which costs a few more but
    keeps every error within ``epsilon``.
    """
    if len(placed.select("k").head(min_keys)) < min_keys:
        return None
    ranged = placed.repartitionByRange("k").sortWithinPartitions("k")
    return ranged.mapInArrow(partial(_built, epsilon=epsilon), "key_start binary, start_pos long, slope double")


def _searched(batches: Iterator[pa.RecordBatch], table: list[tuple[int, int, float]], n: int, epsilon: int):
    from bisect import bisect_right

    starts = [s for s, *_ in table]
    for batch in batches:
        lo, hi, at = [], [], []
        for k in batch.column("k").to_pylist():
            x = digest_u128(k)
            i = max(0, bisect_right(starts, x) - 1)
            p = predict(table[i], x)
            at.append(p)
            lo.append(max(0, min(n, p - epsilon)))
            hi.append(max(0, min(n, p + epsilon + 1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in (at, lo, hi))], names=[*batch.schema.names, "predicted", "lo", "hi"])


def pgm_search(keys: DataFrame, index: DataFrame | None, n: int, epsilon: int = EPSILON, most: int = 1_000_000, materialise=None) -> DataFrame:
    """``predicted`` and the window [lo, hi) of places for each of ``keys`` (k); the whole range without an index.

    The index is many times smaller than the keys; it is collected while it has at
    most ``most`` segments. Beyond, keys and segments are ranged together, and a
    key takes the last segment before it: in its range or, at the head of one,
    from the ranges before, which are a row each. Equal keys are spread over
    several ranges if they are many.
    """
    if index is None:
        return keys.withColumns({"predicted": F.lit(0).cast("long"), "lo": F.lit(0).cast("long"), "hi": F.lit(n).cast("long")})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema), "predicted long, lo long, hi long"])
    if (size := index.limit(most + 1).count()) <= most and size:
        table = sorted((int.from_bytes(r.key_start, "big"), r.start_pos, r.slope) for r in index.collect())
        share = keys.sparkSession.sparkContext.broadcast(table)
        return keys.mapInArrow(lambda it: _searched(it, share.value, n, epsilon), schema)
    padded = keys.withColumns({"_x": F.substring(F.concat("k", F.unhex(F.lit("00" * 16))), 1, 16), "_salt": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))})
    seg = index.select(F.col("key_start").alias("_x"), F.lit(-1).cast("long").alias("_salt"), F.struct("key_start", "start_pos", "slope").alias("_s"))
    ranged = padded.unionByName(seg, allowMissingColumns=True).repartitionByRange("_x", "_salt").withColumn("_p", F.spark_partition_id())
    ranged = materialise(ranged) if materialise else ranged.checkpoint()
    last = ranged.where("_s is not null").groupBy("_p").agg(F.max_by("_s", "_x").alias("_s"))
    ends = ranged.select("_p").distinct().join(last, "_p", "left").select("_p", F.last("_s", True).over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    w = W.partitionBy("_p").orderBy("_x", "_salt").rowsBetween(W.unboundedPreceding, 0)
    both = ranged.withColumn("_s", F.last("_s", True).over(w)).where("k is not null").join(F.broadcast(ends), "_p").withColumn("_s", F.coalesce("_s", "_before"))
    return both.drop("_x", "_salt", "_p", "_before").mapInPandas(lambda it: _windows(it, n, epsilon), schema)


def _windows(batches: Iterator[pd.DataFrame], n: int, epsilon: int):
    for df in batches:
        p = [predict((int.from_bytes(s["key_start"], "big"), s["start_pos"], s["slope"]), digest_u128(k)) if s else 0 for k, s in zip(df.k, df._s, strict=True)]
        none = [s is None for s in df._s]
        df = df.drop(columns="_s")
        df["predicted"] = p
        df["lo"] = [0 if x else max(0, min(n, v - epsilon)) for v, x in zip(p, none, strict=True)]
        df["hi"] = [n if x else max(0, min(n, v + epsilon + 1)) for v, x in zip(p, none, strict=True)]
        yield df


def bloom_params(n: Column, p: Column) -> tuple[Column, Column]:
    """Bits (at least 64) and hash functions (1 to 30) for ``n`` keys at false-positive rate ``p``."""
    m = F.greatest(F.lit(64), F.ceil(-F.greatest(n, F.lit(1)) * F.ln(p) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0)))))
    k = F.greatest(F.lit(1), F.least(F.lit(30), F.round(m / F.greatest(n, F.lit(1)) * F.ln(F.lit(2.0))).cast("long")))
    return m.cast("long"), k.cast("long")


def bloom_size(n: int, p: float = 0.01) -> tuple[int, int]:
    n = max(n, 1)
    m = max(64, ceil(-n * log(p) / log(2) ** 2))
    return m, min(30, max(1, int(m / n * log(2) + 0.5)))


def _probes(keys: list[bytes], m: int, k: int) -> np.ndarray:
    """Bits of each key by double hashing."""
    import xxhash

    pairs = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in keys], np.uint64).reshape(-1, 2)
    i = np.arange(k, dtype=np.uint64)
    return (pairs[:, :1] + i * (pairs[:, 1:] | np.uint64(1))) % np.uint64(m)


def _bits(batches, m: int, k: int):
    bits = np.zeros(m, bool)
    for batch in batches:
        if batch.num_rows:
            bits[_probes(batch.column("k").to_pylist(), m, k).ravel()] = True
    words = np.packbits(np.pad(bits, (0, -m % 64)), bitorder="little").view("<i8")
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], names=["word", "bits"])


def bloom_build(keys: DataFrame, n: int, p: float = 0.01) -> DataFrame:
    """(word, bits): the filter's non-zero 64-bit words, each partition's ORed together; column ``k`` binary.

    A partition holds the whole bit array (about 1.2 bytes a key at 1 %), so
    large key sets take one filter per range, as files have.
    """
    m, k = bloom_size(n, p)
    return keys.select("k").mapInArrow(partial(_bits, m=m, k=k), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))


def fill_ratio(bloom: DataFrame, n: int, p: float = 0.01) -> DataFrame:
    return bloom.agg((F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)) / bloom_size(n, p)[0]).alias("fill_ratio"))


def bloom_probe(keys: DataFrame, bloom: DataFrame, n: int, p: float = 0.01) -> DataFrame:
    """``keys`` with ``may_contain``. The filter is broadcast; its size follows from ``n`` and ``p`` and must be under 256 MB."""
    m, k = bloom_size(n, p)
    if m > 1 << 31:
        raise ValueError("build one filter per key range")
    words = np.zeros(-(-m // 64), np.int64)
    table = bloom.toArrow()
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    share = keys.sparkSession.sparkContext.broadcast(words)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema), "may_contain boolean"])

    def probe(batches):
        w = share.value.view(np.uint64)
        for batch in batches:
            at = _probes(batch.column("k").to_pylist(), m, k)
            hit = ((w[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "may_contain"])

    return keys.mapInArrow(probe, schema)
