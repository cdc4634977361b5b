"""A training-data pipeline: documents in, packed sequences out.

Stages in order: documents that fail the quality rules (their own or their
host's) go; one document of each group of near-duplicates stays; documents that
overlap a benchmark go; secrets are cut out of the texts; what is left is packed.

Each stage takes all rows of the one before, with columns of any number beside
those of documents, and all but the last return the columns they were given.
Null and empty texts are texts without words; an empty table stays empty. Texts
may be of any length. Rows that repeat are judged alike, but for near_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.base import documents, materialise
from palimpsest.llm.decontaminate import without_leaks
from palimpsest.llm.near_dedup import keep_one
from palimpsest.llm.packing import pack
from palimpsest.llm.quality import keep_good
from palimpsest.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail a rule themselves, which those without words do, or whose host is rejected; a null host never is."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of 0.8 or more on shingles of five words connect, by smallest id; texts without words all stay."""
    return keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap an item of the ``benchmark`` table; null and empty items and texts overlap nothing."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of each secret and ``n_chars`` kept true; null texts stay null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document; a null or empty text is its end token alone. Repeated rows are packed one by one."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL can neither encode tokens nor run the guess-cost model; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of ``documents``; each stage's table is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
