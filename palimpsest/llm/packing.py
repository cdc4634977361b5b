"""Packing along a space-filling curve.

Each document becomes a hashed vector of its token counts, projected to a few
dimensions; the Hilbert index of the projection puts similar documents next to
each other. Documents are range-sorted by that index and laid end to end into
sequences, so that a sequence holds neighbours of the curve. A document is cut
where a sequence is full. What is left at the end of a range is cut into powers
of two, which need no padding.
"""

from __future__ import annotations

import zlib
from functools import partial
from math import sqrt

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import materialise, slices, small_batches, text_batches
from .hilbert import hilbert_index
from .pretokens import FastIds

TOKENIZER = "byte_bpe_50k.json"
LENGTH, END_ID = 1024, 0
DIMS, BITS = 4, 15
#: Sequences of a range are numbered in the low bits of their id.
SEQUENCE_BITS = 40
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit integers (the finaliser of splitmix)."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signs(n: int) -> np.ndarray:
    """For each of n features a hashed row of DIMS signs."""
    h = _mix(np.arange(n))
    return np.stack([((h >> np.uint64(7 * k + 3)) & np.uint64(1)).astype(np.float32) * 2 - 1 for k in range(DIMS)], 1)


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert index of projected vectors, on a grid that is even for standard normal values."""
    from numpy.polynomial.polynomial import polyval

    x = np.abs(vectors) / sqrt(2)  # error function after Abramowitz and Stegun 7.1.28
    erf = 1 - polyval(x, [1, 0.0705230784, 0.0422820123, 0.0092705272, 0.0001520143, 0.0002765672, 0.0000430638]) ** -16.0
    u = 0.5 + 0.5 * np.sign(vectors) * erf
    return hilbert_index(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


_ENCODERS: dict = {}


def _encoder(path: str) -> tuple:
    if path not in _ENCODERS:  # kept for the worker's later tasks
        e = FastIds(path)
        n = max(e.size, END_ID + 1)
        _ENCODERS[path] = e, signs(n), np.dtype("<u2" if n <= 1 << 16 else "<u4")
    return _ENCODERS[path]


def _tokenised(batches, path: str):
    encoder, table, kind = _encoder(path)
    end = np.array([END_ID], "<u4")
    for batch, texts in text_batches(batches):
        rows, vectors = [], np.zeros((len(texts), DIMS), np.float32)
        for i, ids in enumerate(encoder.encode([t.decode() for t in texts])):
            kinds, counts = np.unique(ids, return_counts=True)
            if len(kinds):
                w = np.log1p(counts).astype(np.float32)
                vectors[i] = w @ table[kinds] / np.sqrt(w @ w)
            rows.append(np.concatenate((ids, end)).astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(curve_keys(vectors), pa.int64()), pa.array(map(zlib.crc32, rows), pa.int64()), pa.array(rows, pa.binary())],
            names=["doc_id", "curve_key", "tie", "ids"],
        )


def _packed(batches, path: str, length: int, schema):
    """Lay documents end to end; only the open sequence (fewer than ``length`` ids) is held."""
    _, _, kind = _encoder(path)
    sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
    room, held, out = length, [], []

    def flush():
        nonlocal out
        cols = list(zip(*out, strict=True)) or [()] * len(schema)
        out = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def place(pieces):
        nonlocal sequence
        at = 0
        for doc, total, start, ids in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at))
            at += len(ids)
        sequence += 1

    for batch in slices(batches):
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids, at = np.frombuffer(raw, kind).astype("<u4"), 0
            while at < len(ids):
                piece = ids[at : at + room]
                held.append((doc, len(ids), at, piece))
                at += len(piece)
                room -= len(piece)
                if not room:
                    place(held)
                    room, held = length, []
        if len(out) > 20_000:
            yield flush()
    left = length - room
    while left:  # the rest of the range: its largest power of two, and so on
        size, now = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            doc, total, start, ids = held.pop(0)
            now.append((doc, total, start, ids[:size]))
            if len(ids) > size:
                held.insert(0, (doc, total, start + size, ids[size:]))
            size -= len(now[-1][3])
        place(now)
    yield flush()


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``curve_key``-ordered.

    A document's ids are those of the tokenizer file, then END_ID, so null and
    empty texts have one. Sequences hold ``length`` ids, or a power of two at the
    end of a range; none needs padding. Equal documents share a curve key and
    are told apart by hash, id and row, so a hot key is spread over several
    ranges. Repeated rows are packed as documents of their own; an empty table
    gives an empty one.

    The ids are written once, with their key, into the shared folder, so that
    the sampling of ranges and the sort don't tokenise again.
    """
    return pack_ids(tokenised(docs, id_col=id_col, text_col=text_col, path=path), path=path, length=length)


def tokenised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id``, ``curve_key``, ``tie`` and ``ids`` (little-endian, 2 bytes where the vocabulary fits) of each row."""
    slim = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(partial(_tokenised, path=path or public_tokenizers.path(TOKENIZER)), f"doc_id {kind}, curve_key long, tie long, ids binary")


def pack_ids(ids: DataFrame, *, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The second half of :func:`pack`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    struct = T.StructType.fromDDL(f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, {PIECE}")
    order = ["curve_key", "tie", "doc_id"]
    ranged = materialise(ids, "ids").withColumn("tie", F.xxhash64("tie", "doc_id", F.monotonically_increasing_id())).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "ids").mapInArrow(partial(_packed, path=path or public_tokenizers.path(TOKENIZER), length=length, schema=to_arrow_schema(struct)), struct)
