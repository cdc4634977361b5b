"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast table with the token counts of the most frequent
pre-tokens; it is bounded by FREQUENT entries. Tier two is each worker's cache
of what the tokenizer library says of the other pre-tokens. No pre-token is
shuffled: a first pass leaves at most PER_TASK words of each task to pick the
table from. The table only saves time; the counts never depend on it.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from functools import partial
from operator import itemgetter

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_texts, small_batches, text_batches
from .pretokens import LONGEST, Encoder

TOKENIZER = "byte_bpe_50k.json"
FREQUENT, PER_TASK = 32_768, 4_096
LIMIT = 512


def _frequent_words(batches):
    """At most PER_TASK frequent words of a task with their counts, kept within 32 x PER_TASK counters."""
    import pyarrow as pa

    seen: Counter = Counter()
    for _, texts in text_batches(batches):
        for text in texts:
            seen.update(text.split())
            if len(seen) > 32 * PER_TASK:
                seen = Counter(dict(heapq.nlargest(8 * PER_TASK, seen.items(), key=itemgetter(1))))
    top = heapq.nlargest(PER_TASK, ((w, n) for w, n in seen.items() if len(w) < LONGEST), key=itemgetter(1))
    yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent_pretokens(docs: DataFrame, path: str, *, text_col: str = "text", size: int = FREQUENT) -> dict[str, int]:
    """Token counts of about ``size`` frequent pre-tokens, from all texts."""
    words = small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(_frequent_words, "word binary, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    own, seen = Encoder(path, len), Counter()
    if own.plain:
        for r in top:
            for piece in own.find(" " + bytes(r.word).decode(errors="ignore")):
                seen[piece] += r.n
    pieces = [w for w, _ in seen.most_common(size) if len(w) <= LONGEST]
    own.encode(pieces, sum)
    return {w: own.table[w] for w in pieces if w in own.table}


_ENCODERS: dict = {}


def _setup(path: str, run: str, shared) -> Encoder:
    key = (path, run)
    if key not in _ENCODERS:  # the worker's cache outlives its tasks
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, len, shared.value)
    return _ENCODERS[key]


def _count(texts: list[bytes], encoder: Encoder, limit: int) -> dict:
    n = encoder.encode([t.decode() for t in texts], sum)
    return {"n_bytes": list(map(len, texts)), "n_tokens": n, "over_limit": [x > limit for x in n]}


def _pieces(texts: list[bytes], model, limit: int) -> dict:
    n = [len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)]
    return {"n_bytes": list(map(len, texts)), "n_tokens": n, "over_limit": [x > limit for x in n]}


def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, frequent: dict[str, int] | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row of ``docs``.

    The count is that of the tokenizer file at ``path`` (``.json``: tokenizers,
    ``.model``: sentencepiece), whole texts, no added special tokens; special
    strings inside a text count as the library has them by default. Null and
    empty texts have 0 tokens. Repeated rows give repeated rows, an empty table an empty
    one. Long texts are worked on in parts, so that time and memory do not depend
    on how text is dealt to documents. ``frequent`` may carry the table of an
    earlier run, else one pass over ``docs`` makes it.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    if path.endswith(".model"):
        return map_texts(slim, partial(_pieces, limit=limit), schema, keep=["doc_id"], setup=partial(_sentencepiece, path))
    if frequent is None:
        frequent = frequent_pretokens(docs, path, text_col=text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent)
    return map_texts(slim, partial(_count, limit=limit), schema, keep=["doc_id"], setup=partial(_setup, path, uuid.uuid4().hex, table))
