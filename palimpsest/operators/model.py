"""Model against actual state, and invariants as queries that return violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def model_state(ops: DataFrame) -> DataFrame:
    """Last state per key of puts and deletes (op_no, k, is_delete, v). A partial maximum per key."""
    last = ops.groupBy("k").agg(F.max(F.struct("op_no", "is_delete", "v")).alias("s"))
    return last.select("k", "s.is_delete", "s.v")


def counts(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(~F.col("is_delete")).alias("live_keys"), F.count(F.lit(1)).alias("all_keys"))


def compare(model: DataFrame, actual: DataFrame) -> DataFrame:
    """Per key of the model (k, is_delete, v) or the actual store (k, v): ``verdict``.

    matching, mismatch (both have it, values differ), missing_from_actual, or
    unexpected_in_actual (deleted in or unknown to the model).
    """
    live = model.where("not is_delete").select("k", F.col("v").alias("want"), F.lit(True).alias("_m"))
    both = live.join(actual.select("k", F.col("v").alias("got"), F.lit(True).alias("_a")), "k", "full_outer")
    verdict = F.when(F.col("_a").isNull(), "missing_from_actual").when(F.col("_m").isNull(), "unexpected_in_actual").when(F.col("want").eqNullSafe(F.col("got")), "matching").otherwise("mismatch")
    return both.select("k", "want", "got", verdict.alias("verdict"))


def compare_summary(compared: DataFrame) -> DataFrame:
    """Counts of verdicts; an unexpected key is counted as a mismatch as well."""
    v = F.col("verdict")
    return compared.agg(
        F.count_if(v == "matching").alias("matching"), F.count_if(v.isin("mismatch", "unexpected_in_actual")).alias("mismatches"),
        F.count_if(v == "missing_from_actual").alias("missing_from_actual"), F.count_if(v == "unexpected_in_actual").alias("unexpected_in_actual"),
    )


def durability_violations(model: DataFrame, actual: DataFrame) -> DataFrame:
    """Model keys whose actual value is another; deleted equals absent."""
    got = actual.select("k", F.col("v").alias("got"), F.lit(True).alias("_a"))
    wrong = F.when(F.col("is_delete"), F.col("_a").isNotNull()).otherwise(F.col("_a").isNull() | ~F.col("v").eqNullSafe(F.col("got")))
    return model.join(got, "k", "left").where(wrong).select("k", "is_delete", F.col("v").alias("want"), "got")


def phantom_keys(candidates: DataFrame, written: DataFrame, actual: DataFrame) -> DataFrame:
    """Candidate keys that were never written and are there all the same."""
    return candidates.select("k").distinct().join(written.select("k"), "k", "left_anti").join(actual.select("k"), "k", "left_semi")


def read_your_writes_violations(ops: DataFrame) -> DataFrame:
    """Reads (op_no, k, op in put/delete/get, v) that differ from the last write of the key before them."""
    w = W.partitionBy("k").orderBy("op_no").rowsBetween(W.unboundedPreceding, -1)
    seen = ops.withColumn("last", F.last(F.when(F.col("op") != "get", F.struct("op", "v")), True).over(w)).where("op = 'get'")
    want = F.when(F.col("last.op") == "put", F.col("last.v"))
    return seen.select("op_no", "k", want.alias("want"), F.col("v").alias("got")).where(~F.col("want").eqNullSafe(F.col("got")))


def scan_order_violations(rows: DataFrame) -> DataFrame:
    """Places (scan, pos, k) where a scan's key is not after the one before it."""
    w = W.partitionBy("scan").orderBy("pos")
    return rows.withColumn("before", F.lag("k").over(w)).where(F.col("before") >= F.col("k")).select("scan", "pos", "before", "k")


def scan_differences(want: DataFrame, got: DataFrame) -> DataFrame:
    """Positions (pos, k, v) where two scans differ, in key, value or length."""
    a, b = (df.select("pos", F.struct("k", "v").alias(n)) for df, n in ((want, "want"), (got, "got")))
    return a.join(b, "pos", "full_outer").where(~F.col("want").eqNullSafe(F.col("got")))


def spot_check(model: DataFrame, actual: DataFrame, share: int, seed: int = 0) -> DataFrame:
    """:func:`durability_violations` of a seeded sample of one key in ``share``."""
    return durability_violations(model.where(F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(share)) == 0), actual)


def verify_recovery(model: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys checked, missing and incorrect after recovery."""
    v = F.col("verdict")
    return compare(model, actual).where(v != "unexpected_in_actual").agg(F.count(F.lit(1)).alias("checked"), F.count_if(v == "missing_from_actual").alias("missing"), F.count_if(v == "mismatch").alias("incorrect"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per named query of violations: how many, and whether it passed."""
    out = None
    for name, df in checks.items():
        row = df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations")).withColumn("passed", F.col("violations") == 0)
        out = row if out is None else out.unionByName(row)
    return out


def lost_synced(ops: DataFrame, synced: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys whose last synced write (k, op_no of ``synced``) is neither there nor overwritten since."""
    last = model_state(ops.join(synced.select("k", F.col("op_no").alias("upto")), "k").where("op_no <= upto"))
    return durability_violations(last.join(ops.join(synced.select("k", F.col("op_no").alias("upto")), "k").where("op_no > upto").select("k"), "k", "left_anti"), actual)
