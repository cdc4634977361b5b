"""Host-level quality rules.

Every document is judged by rules on its own words. The failures of each rule
are then added up by host, their rates are shrunk towards the corpus with a beta
prior fitted to all hosts (empirical Bayes), and a host whose shrunk rate passes
a limit takes all its documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import types as T

from .base import fresh, map_texts, materialise, small

MIN_WORDS = 50
#: The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
RULES = ("short", "repetitive", "symbols", "dup_lines", "word_length")
#: A host is rejected when a rule's shrunk failure rate is above this.
MAX_RATE = 0.75
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean, fails int"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    key, size = ids[:n], len(seen)
    for k in range(1, width):
        if k > 1 or size * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + ids[k : k + n]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(count[back] > 1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple:
    """The values of FEATURES for one text."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    short, repetitive = n < MIN_WORDS, 100 * repeat > 50 * n
    failed = (short, repetitive, 10 * symbols > chars, 10 * dup > 3 * len(lines), n > 0 and not 2 * n <= chars <= 15 * n)
    return n, chars, symbols, dup, repeat, len(lines), short or repetitive, sum(1 << i for i, x in enumerate(failed) if x)


def _measure_all(texts: list[bytes]) -> dict:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return dict(zip(names, zip(*map(measure, texts), strict=True) if texts else [[] for _ in names], strict=True))


def document_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id``, ``host`` and FEATURES of each row of ``docs``; a null text has no words."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return map_texts(slim, _measure_all, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, host string, {FEATURES}", keep=["doc_id", "host"])


def host_verdicts(features: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per host: documents, failures and shrunk rate of each rule, and ``rejected``.

    The beta prior of a rule has the corpus rate m as mean. Its strength follows
    from the variance of the hosts' rates beyond that of sampling, by moments,
    within 2 and 10,000 pseudo-documents. Documents without a host (null) belong
    to none and get no host verdict.
    """
    hosts = features.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col("fails").bitwiseAND(1 << i).cast("boolean").cast("long")).alias(f"k_{r}") for i, r in enumerate(RULES))
    )
    mean = hosts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("hosts"), *((F.sum(f"k_{r}") / F.sum("n")).alias(f"m_{r}") for r in RULES),
                     *(F.sum(F.pow(F.col(f"k_{r}"), 2) / F.col("n")).alias(f"q_{r}") for r in RULES))
    both = hosts.crossJoin(F.broadcast(mean))  # one row
    worst = []
    for r in RULES:
        m, k = F.col(f"m_{r}"), F.col(f"k_{r}")
        spread = F.col(f"q_{r}") / F.col("total") - m * m - m * (1 - m) * F.col("hosts") / F.col("total")
        strength = F.greatest(F.lit(2.0), F.least(F.lit(1e4), F.when(spread > 0, m * (1 - m) / spread - 1).otherwise(F.lit(1e4))))
        both = both.withColumn(f"rate_{r}", (k + m * strength) / (F.col("n") + strength))
        worst.append(F.col(f"rate_{r}"))
    return both.select("host", "n", *(f"k_{r}" for r in RULES), *(f"rate_{r}" for r in RULES), (F.greatest(*worst) > max_rate).alias("rejected"))


def with_host_verdict(df: DataFrame, host: str, verdicts: DataFrame, out: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Join ``verdicts`` (host, rejected) back as the boolean column ``out``, and its columns ``more``.

    Broadcast while the list is small by check, else a shuffle join, in which
    adaptive execution splits the rows of a large host.
    """
    h, flag = fresh(df, "verdict_host", "verdict_flag")
    side = verdicts.select(F.col("host").alias(h), F.col("rejected").alias(flag), *more)
    if small(verdicts.select("host"), text="host"):
        side = F.broadcast(side)
    return df.join(side, F.col(host).cast("string") == F.col(h), "left").withColumn(out, F.coalesce(F.col(flag), F.lit(False))).drop(h, flag)


RATES = tuple(f"rate_{r}" for r in RULES)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per row of ``docs``: its features, ``base_failed``, its host's shrunk rates (to 9 places) and verdict, and ``kept``.

    ``kept`` is false if the document fails the base rules or its host is
    rejected. Null text: no words, so it fails. Null host: own rules only, null
    rates. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    features = materialise(document_features(docs, id_col=id_col, text_col=text_col, host_col=host_col), "quality")
    hosts = materialise(host_verdicts(features, max_rate), "hosts")
    verdicts = hosts.select("host", "rejected", *(F.round(r, 9).alias(r) for r in RATES))
    return with_host_verdict(features, "host", verdicts, "host_rejected", RATES).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def _failed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        raw = pc.fill_null(pc.cast(texts, pa.large_binary()), b"").to_pylist()
        yield pa.array([measure(x)[6] for x in raw], to_arrow_type(T.BooleanType()))


def base_failed(text: Column) -> Column:
    return F.arrow_udf(_failed, "boolean", F.ArrowUDFType.SCALAR_ITER)(text)


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs``, all columns, without the documents that :func:`quality_rules` rejects.

    Two passes over the texts and no shuffle of them: the first leaves counts per
    host, the second filters in place. Null and empty texts fail as those without
    words; a null host is never rejected. Repeated rows are judged alike, and an
    empty table stays empty.
    """
    slim = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(host_col).alias("source"), F.col(text_col).alias("text"))
    rejected = materialise(host_verdicts(document_features(slim), max_rate).where("rejected").select("host", "rejected"), "hosts")
    (flag,) = fresh(docs, "host_rejected")
    good = with_host_verdict(docs, host_col, rejected, flag).where(~F.col(flag)).drop(flag)
    return good.where(~base_failed(F.col(text_col)))
