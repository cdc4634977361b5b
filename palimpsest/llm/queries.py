"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .base import documents
from .decontaminate import leaks
from .license_scan import license_scan
from .lm_scoring import brown_scores
from .near_dedup import near_duplicates
from .packing import pack
from .quality import RATES, quality_rules
from .secret_scan import secret_scan
from .sharding import hilbert_shards
from .token_counts import token_counts
from .url_filters import url_verdicts


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op2_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(documents(spark, sf_dir))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert_shards(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_key")


def op4_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2, percent=80)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rejected", *RATES)


def op10_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_curve_packing": op1_curve_packing,
        "op2_brown_scores": op2_brown_scores,
        "op3_hilbert_shards": op3_hilbert_shards,
        "op4_redirect_verdicts": op4_redirect_verdicts,
        "op5_lsh_forest_dedup": op5_lsh_forest_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_license_scan": op7_license_scan,
        "op8_secret_scan": op8_secret_scan,
        "op9_quality_rules": op9_quality_rules,
        "op10_spaced_seed_leaks": op10_spaced_seed_leaks,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_redirect_verdicts": sql.OP4, "op5_lsh_forest_dedup": sql.OP5, "op9_quality_rules": sql.OP9, "op10_spaced_seed_leaks": sql.OP10}
