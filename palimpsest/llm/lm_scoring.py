"""Brown class-based bigram model: word classes by exchange clustering.

Every word of the training texts has a class. First, units are exchanged between
classes one by one, on their bigrams in the whole training text: each of the
CORE commonest words is a unit, all other words share ENDINGS units by their last
bytes, and the end of a text is one. From there all KNOWN commonest words are
exchanged by themselves: in each round the classes of its neighbours are counted
for each word (sparse, and shuffled by word), and each word moves to its best
class, side by side, for which the neighbours stay in the classes they had; only
words of HEAVY occurrences or more, or of a share of LARGE in their class, which
change the bigrams of classes by much, do so one after the other within a batch. Rounds go on until no word moves, the likelihood falls
or ROUNDS are over; the classes of the best round are taken, and the model tells
whether it converged. All other words, as many as the corpus has, get their best
class from the summed classes of their known neighbours, in one shuffle by word.
What is known of a word's neighbours is shrunk towards those of its ending, which
count for PRIOR occurrences: a word that stands once would else learn its one
place by heart. Only words that never stood in the training texts have the class
of their ending. The probability of a word is

    P(class | class before) * P(word | class)

with both factors smoothed. The tables of known words are bounded and broadcast.

Texts are split once, into chunks of some TOKENS: a row has the words of many
texts as codes, and each distinct word once. What is said of a word is then said
once for a chunk: counts, ranks, neighbours. Rows that meet by word (counts,
rare words) are packed, all words of a chunk in a bucket of hashes as one row;
the class of a rare word goes back to its chunks the same way, and each chunk is
scored as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial
from math import ceil, log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import discard, materialise, small_batches, text_batches

#: Words that are units; hashes of the last three bytes of a word; classes (class 0 is the end of a text alone).
CORE, ENDINGS, CLASSES = 767, 256, 64
UNITS = CORE + ENDINGS + 1
#: Words of the broadcast tables, and their longest in bytes; other words are rare and joined.
KNOWN, LONGEST = 200_000, 64
#: Added to word counts in the base score, and within a class; weight of the class distribution in transitions.
ALPHA, EMIT, BETA = 0.1, 0.5, 5.0
#: Sweeps of the exchange of the core; rounds of that of all known words.
SWEEPS, ROUNDS = 12, 2
#: Words of as many occurrences, or of that share of their class, are left out of the bigrams of classes before they choose.
HEAVY, LARGE = 1000, 0.01
#: Cells of a word: classes after it, classes before it, itself.
CELLS = 2 * CLASSES + 1
#: Occurrences that the neighbours of its ending count for in the choice of a word's class.
PRIOR = 10.0
#: A chunk is full beyond as many tokens, or bytes of words; its row passes through heaps and batches as a whole.
TOKENS, BYTES = 600_000, 16 << 20
#: Tokens whose bigrams are counted at once.
AT_ONCE = 2_000_000
#: A row of a chunk is a page of Parquet by itself: pages are compressed outside the heap, and would else hold 100 rows.
PAGES = {"parquet.page.size.row.check.min": "1"}
#: Words of chunks in a bucket of hashes, on average; distinct words of a bucket that are placed at once.
BUCKET, BLOCK = 100_000, 8192
#: Counts are told apart up to this one to find the commonest words.
COMMON = 65_536

#: A row of a chunk: each distinct word once (packed), with its count, hash and ending, and its texts in a row, as places in that list.
CHUNK = "chunk long, held_out boolean, docs long, tokens long, kinds long, doc_id array<{kind}>, ids binary, n binary, lens binary, data binary, hash binary, tail binary"


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _words(lens, data) -> pa.Array:
    """The words of lengths ``lens`` (uint32) that stand in a row in ``data``."""
    ends = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _laid_out(words: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """What :func:`_words` takes."""
    if not len(words):
        return np.zeros(0, np.uint32), pa.py_buffer(b"")
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.diff(ends).astype(np.uint32), (words.buffers()[2] or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0]))


def _cut(values, sizes: np.ndarray) -> pa.Array:
    """The bytes of ``values`` in rows of ``sizes`` elements (bytes of a buffer)."""
    step = values.itemsize if isinstance(values, np.ndarray) else 1
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64) * step)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _one(values) -> pa.Array:
    return _cut(values, np.array([len(values)]))


def _rows_by(batches, key: str):
    """(key, rows as (batch, place)) of rows sorted by key."""
    at, held = None, []
    for batch in batches:
        for i, k in enumerate(batch.column(key).to_pylist()):
            if held and k != at:
                yield at, held
                held = []
            at = k
            held.append((batch, i))
    if held:
        yield at, held


def _values(rows, name: str, kind) -> np.ndarray:
    """The packed values of all ``rows``, one after the other."""
    return np.frombuffer(b"".join(batch.column(name)[i].as_buffer() for batch, i in rows), kind)


def _all_words(rows) -> pa.Array:
    return _words(_values(rows, "lens", np.uint32), b"".join(batch.column("data")[i].as_buffer() for batch, i in rows))


def _each(batches):
    return ((batch, i) for batch in batches for i in range(batch.num_rows))


def _bucketed(hash_: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of words by bucket; of each bucket that has some its number, and how many."""
    bucket = hash_ % buckets
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return order, bucket[first], np.diff(np.append(first, len(bucket)))


def _ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


def _chunks(batches, kind, most: int):
    """Texts as rows of CHUNK; an id of -1 stands before the first text and after each. Held-out texts have chunks of their own."""
    at, held = TaskContext.get().partitionId() << 33, {}

    def flush(out):
        nonlocal at
        words, doc_ids, sizes, _ = held.pop(out)
        coded = pa.concat_arrays(words).dictionary_encode()
        sizes = np.concatenate(sizes)
        ids = np.full(len(coded) + len(sizes) + 1, -1, np.int32)
        text = np.ones(len(ids), bool)
        text[np.concatenate(([0], np.cumsum(sizes + 1)))] = False
        ids[text] = code = coded.indices.to_numpy()
        kinds = coded.dictionary
        lens, data = _laid_out(kinds)
        each = kinds.to_pylist()
        doc_id = pa.concat_arrays(doc_ids)
        cols = [pa.array([at]), pa.array([out]), pa.array([len(sizes)]), pa.array([len(ids) - 1]), pa.array([len(kinds)]), pa.ListArray.from_arrays(pa.array([0, len(doc_id)], pa.int32()), doc_id), _one(ids), _one(np.bincount(code, minlength=len(kinds)).astype(np.uint32)), _one(lens), _one(data), _one(np.fromiter(map(crc32, each), np.uint32, len(each))), _one(np.fromiter(map(_ending, each), np.uint8, len(each)))]
        at += 1
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in CHUNK.split(", ")])

    for batch, texts in text_batches(batches):
        outs = batch.column("held_out").to_pylist()
        for out in set(outs):
            split, sizes = [], []
            for text, x in zip(texts, outs, strict=True):
                if x == out:
                    words = text.lower().split()
                    split += words
                    sizes.append(len(words))
            so_far = held.setdefault(out, [[], [], [], np.zeros(2, np.int64)])
            so_far[0].append(pa.array(split, pa.binary()))
            so_far[1].append(batch.column("doc_id").cast(kind).filter(pa.array([x == out for x in outs])))
            so_far[2].append(np.array(sizes, np.int64))
            so_far[3] += len(split), sum(map(len, split))
            if so_far[3][0] > most or so_far[3][1] > BYTES:
                yield flush(out)
    for out in list(held):
        yield flush(out)


def _to_count(batches, buckets: int):
    """The words of each chunk and their counts, by bucket."""
    for row in _each(batches):
        order, bucket, size = _bucketed(_values([row], "hash", np.uint32), buckets)
        lens, data = _laid_out(_all_words([row]).take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), _cut(_values([row], "n", np.uint32)[order], size), _cut(lens, size), _cut(data, _sums(lens, size))], names=["bucket", "n", "lens", "data"])


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of runs of ``sizes`` elements."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _counted(batches):
    """Of rows sorted by bucket: a row per bucket, with each word once."""
    for _, rows in _rows_by(batches, "bucket"):
        coded = _all_words(rows).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), _values(rows, "n", np.uint32), len(coded.dictionary)).astype(np.int64)
        lens, data = _laid_out(coded.dictionary)
        yield pa.RecordBatch.from_arrays([pa.array([len(n)]), _one(n), _one(lens), _one(data)], names=["kinds", "n", "lens", "data"])


def _how_common(batches, longest: int):
    """How many words of up to ``longest`` bytes have each count; those from COMMON on are one."""
    for row in _each(batches):
        n = np.minimum(_values([row], "n", np.int64), COMMON)[_values([row], "lens", np.uint32) <= longest]
        kinds = np.bincount(n)
        n = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(kinds[n])], names=["n", "kinds"])


def _unpacked(batches, least: int, longest: int | None, names: list[str]):
    """A row per word of ``least`` occurrences or more."""
    for row in _each(batches):
        cols = [_all_words([row]), pa.array(_values([row], "n", np.int64))]
        if "label" in names:
            cols.append(pa.array(_values([row], "label", np.uint8).astype(np.int32)))
        out = pa.RecordBatch.from_arrays(cols, names=names)
        yield out if longest is None else out.filter(pa.array((_values([row], "n", np.int64) >= least) & (_values([row], "lens", np.uint32) <= longest)))


def _ranked(batches, known):
    """Chunks with ids in place of codes: a known word's rank, then the end, then the chunk's rare words, which alone stay in the list of its words."""
    known = known.value
    for batch in batches:
        for i in range(batch.num_rows):
            row = (batch, i)
            words = _all_words([row])
            rank = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int32)
            far = rank < 0
            kinds = int(far.sum())
            rank[far] = len(known) + 1 + np.arange(kinds)
            ids = np.append(rank, np.int32(len(known)))[_values([row], "ids", np.int32)]
            lens, data = _laid_out(words.filter(pa.array(far)))
            new = {"kinds": pa.array([kinds]), "ids": _one(ids), "n": _one(b""), "lens": _one(lens), "data": _one(data), "hash": _one(_values([row], "hash", np.uint32)[far]), "tail": _one(_values([row], "tail", np.uint8)[far])}
            one = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([new.get(x, one.column(x)) for x in one.schema.names], names=one.schema.names)


def _flat(ids: np.ndarray, tail: np.ndarray, end: int) -> np.ndarray:
    """Ids where a rare word is ``end`` + 1 + its ending."""
    far = np.flatnonzero(ids > end)
    ids = ids.copy()
    ids[far] = tail[ids[far] - end - 1] + np.int32(end + 1)
    return ids


def _pieces(batches, end: int):
    """The ids of chunks in a row, of some AT_ONCE tokens at a time."""
    held, size = [], 0
    for row in _each(batches):
        u = _flat(_values([row], "ids", np.int32), _values([row], "tail", np.uint8), end)
        held.append(u[1:] if held else u)  # the end before is that of the chunk before
        size += len(u)
        if size > AT_ONCE:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _unit_bigrams(batches, units, end: int):
    unit, cells = units.value.astype(np.int32), np.zeros(UNITS * UNITS, np.int64)
    for u in _pieces(batches, end):
        x = unit[u]
        cells += np.bincount(x[:-1] * UNITS + x[1:], minlength=UNITS * UNITS)
    at = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(cells[at], pa.int64())], names=["cell", "n"])


def _tally(code: np.ndarray):
    """Of codes (id * CELLS + cell) each once: id, cell as a byte, count as uint32."""
    code.sort()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    n = np.diff(np.append(first, len(code)))
    id_, cell = np.divmod(code[first], CELLS)
    return id_, cell.astype(np.uint8), n.astype(np.uint32)


def _packed(code: np.ndarray):
    """Of codes (id * CELLS + cell): ids, their cells as bytes, the counts as uint32."""
    id_, cell, n = _tally(code)
    first = np.flatnonzero(np.diff(id_, prepend=-1))
    size = np.diff(np.append(first, len(id_)))
    return id_[first], _cut(cell, size), _cut(n, size)


def _contexts(batches, tables, end: int, sums_only: bool):
    """Sums (id -1): class bigrams, then the cells of each ending; and the cells of each known word beyond the core (a row per word and piece)."""
    label, unit = (x.astype(np.int32) for x in tables.value)
    sums, by_ending = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(ENDINGS * CELLS, np.int64)
    schema = pa.schema([("id", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("cell", pa.int32()), ("n", pa.int64())])
    for u in _pieces(batches, end):
        a, b = u[:-1], u[1:]
        c = label[u]
        sums += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        first, then = (a >= CORE) & (a != end), (b >= CORE) & (b != end) & ((a != b) | (b > end))
        ids = np.concatenate((a[first], b[then]))
        cells = np.concatenate((np.where((a == b) & (a < end), 2 * CLASSES, c[1:])[first], CLASSES + c[:-1][then]))
        by_ending += np.bincount((unit[ids] - CORE) * CELLS + cells, minlength=ENDINGS * CELLS)
        own = ids < end
        if own.any() and not sums_only:
            ids, cells, counts = _packed(ids[own] * CELLS + cells[own])
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), cells, counts, none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
    sums = np.concatenate((sums, by_ending))
    at = np.flatnonzero(sums)
    none = pa.nulls(len(at)).cast(pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1), pa.int32()), none, none, pa.array(at, pa.int32()), pa.array(sums[at])], schema=schema)


def _dense(batch: pa.RecordBatch, at: np.ndarray, n: int) -> np.ndarray:
    """The cells of the batch's rows, summed into ``n`` rows by their places ``at``."""
    size = pc.binary_length(batch.column("cells")).to_numpy()
    cell = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8)
    count = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint32)
    return np.bincount(np.repeat(at, size) * CELLS + cell, count, n * CELLS).reshape(n, CELLS)


def _by_key(batches, key: str):
    """(keys, cells) of rows sorted by key, some keys at a time and each key once."""
    held = None
    for batch in batches:
        for i in range(0, batch.num_rows, 8192):
            part = batch.slice(i, 8192)
            names = part.column(key)
            new = np.concatenate(([True], pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)))
            keys = [names[j].as_py() for j in np.flatnonzero(new).tolist()]
            cells = _dense(part, np.cumsum(new) - 1, len(keys))
            if held and held[0][-1] == keys[0]:
                cells[0] += held[1][-1]
                held = held[0][:-1], held[1][:-1]
            if held and held[0]:
                yield held
            held = keys, cells
    if held:
        yield held


def _moved(batches, tables):
    """Of rows sorted by id: the ids that are likelier in another class than their own, and the best class."""
    label, unit, start, usual = tables.value
    follow, size = followers(start), start.sum(0)
    for keys, cells in _by_key(batches, "id"):
        ids = np.array(keys)
        r, p, self_ = cells[:, :CLASSES], cells[:, CLASSES : 2 * CLASSES], cells[:, 2 * CLASSES]
        n = np.maximum(r.sum(1), p.sum(1)) + self_
        own, more = label[ids].astype(np.int64), usual[unit[ids] - CORE] * prior_share(n)[:, None]
        value = likelihoods(r + more[:, :CLASSES], p + more[:, CLASSES:], self_, p.sum(1) + self_ + PRIOR * prior_share(n), follow, size)
        best, row = value.argmax(1), np.arange(len(ids))
        best = np.where(value[row, best] > value[row, own] + 1e-9, best, own)
        m = start.copy()
        for i in np.flatnonzero((n >= HEAVY) | (n >= LARGE * size[own])).tolist():
            k = own[i]
            m[k] -= r[i]
            m[:, k] -= p[i]
            m[k, k] -= self_[i]
            gain = _gain(m, r[i] + more[i, :CLASSES], p[i] + more[i, CLASSES:], self_[i])
            t = int(np.argmax(gain))
            best[i] = t = t if gain[t] > gain[k] + 1e-9 else k
            m[t] += r[i]
            m[:, t] += p[i]
            m[t, t] += self_[i]
        far = best != own
        yield pa.RecordBatch.from_arrays([pa.array(ids[far], pa.int32()), pa.array(best[far], pa.int32())], names=["id", "label"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gain(m: np.ndarray, r: np.ndarray, p: np.ndarray, self_: float) -> np.ndarray:
    """What each class gains in likelihood from a word that is left out of the class bigrams ``m``; ``r`` and ``p``: classes after and before it."""
    out, into = m.sum(1), m.sum(0)
    gain = (_xlogx(m + r) - _xlogx(m)).sum(1) + (_xlogx(m + p[:, None]) - _xlogx(m)).sum(0)
    d = np.diag(m)
    gain += _xlogx(d + r + p + self_) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + p)
    gain -= _xlogx(out + r.sum() + self_) - _xlogx(out) + _xlogx(into + p.sum() + self_) - _xlogx(into)
    gain[0] = -np.inf
    return gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit, by exchange clustering on unit bigram counts.

    Units start by rank in classes 1 and up; the last unit (end) keeps class 0 to
    itself. Each sweep moves each unit, the commonest first, to the class where
    the likelihood of class bigrams is highest, until none moves.
    """
    n = len(bigrams)
    total = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-total[: n - 1], kind="stable")
    label = np.zeros(n, np.int64)
    label[order] = 1 + np.arange(n - 1) % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), label] = 1
    right, left = bigrams @ one, bigrams.T @ one  # unit by class: what follows, what precedes
    m = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            k, self_ = label[u], bigrams[u, u]
            r, p = right[u].copy(), left[u].copy()
            r[k] -= self_
            p[k] -= self_
            m[k] -= r
            m[:, k] -= p
            m[k, k] -= self_
            gain = _gain(m, r, p, self_)
            t = int(np.argmax(gain))
            if gain[t] <= gain[k] + 1e-9:
                t = k
            m[t] += r
            m[:, t] += p
            m[t, t] += self_
            if t != k:
                moved += 1
                label[u] = t
                right[:, k] -= bigrams[:, u]
                right[:, t] += bigrams[:, u]
                left[:, k] -= bigrams[u]
                left[:, t] += bigrams[u]
        if not moved:
            break
    return label


def prior_share(n):
    """What share of PRIOR counts for a word of ``n`` occurrences."""
    return PRIOR / (PRIOR + n)


def followers(m: np.ndarray) -> np.ndarray:
    """log of the probability of a class after a class."""
    size = m.sum(0)
    return np.log((m + BETA * (size + 1) / (size.sum() + CLASSES)) / (m.sum(1, keepdims=True) + BETA))


def likelihoods(r: np.ndarray, p: np.ndarray, self_: np.ndarray, n: np.ndarray, follow: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of words with ``r`` and ``p`` (classes after and before), ``self_`` (after themselves) and ``n`` occurrences the log-likelihood in each class, but for the end's, whose bigrams they don't change."""
    share = np.log((size + 1) / (size.sum() + CLASSES))
    value = r @ follow.T + p @ follow + self_[:, None] * np.diag(follow) + (n - p.sum(1) - self_)[:, None] * share - n[:, None] * np.log(size + 1)
    value[:, 0] = -np.inf
    return value


def usual_neighbours(by_ending: np.ndarray) -> np.ndarray:
    """Classes after and before an occurrence of a word with each ending, PRIOR times."""
    cells = by_ending[:, : 2 * CLASSES].copy()
    for side in (cells[:, :CLASSES], cells[:, CLASSES:]):
        side *= PRIOR / np.maximum(side.sum(1, keepdims=True), 1)
    return cells


def exchange_words(ids: DataFrame, label: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """After rounds in which all known words but the core move: ``label`` (class of each known word, the end, and each ending), the class bigrams, :func:`usual_neighbours`, and how many moved in each round; 0 in the end if it converged."""
    spark = ids.sparkSession
    parts, end, share = int(spark.conf.get("spark.sql.shuffle.partitions")), len(label) - 1 - ENDINGS, spark.sparkContext.broadcast
    best, moved = None, []
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS or end <= CORE
        seen = ids.mapInArrow(partial(_contexts, tables=share((label, unit)), end=end, sums_only=last), "id int, cells binary, counts binary, cell int, n long")
        seen = seen if last else materialise(seen, "contexts")
        sums = np.zeros(CLASSES * CLASSES + ENDINGS * CELLS)
        for r in seen.where("id < 0").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most as many rows as cells
            sums[r.cell] = r.n
        m, usual = sums[: CLASSES * CLASSES].reshape(CLASSES, CLASSES), usual_neighbours(sums[CLASSES * CLASSES :].reshape(ENDINGS, CELLS))
        value = _xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum()
        if best is not None and value <= best[0]:
            break
        best = value, label, m, usual
        if last:
            break
        rows = seen.where("id >= 0").select("id", "cells", "counts").repartition(parts, "id").sortWithinPartitions("id")
        moves = rows.mapInArrow(partial(_moved, tables=share((label, unit, m, usual))), "id int, label int").toArrow()  # a row per known word that moves
        moved.append(moves.num_rows)
        discard(seen)
        if not moves.num_rows:
            break
        label = label.copy()
        label[moves.column("id").to_numpy()] = moves.column("label").to_numpy()
    return *best[1:], moved


def _rare_contexts(batches, labels, end: int, buckets: int):
    """The rare words of each chunk by bucket: their places in its list and endings; of texts that are not held out the cells of their known neighbours, and how often they stand there."""
    label = labels.value.astype(np.int64)
    for row in _each(batches):
        hash_, tail = _values([row], "hash", np.uint32), _values([row], "tail", np.uint8)
        if not len(hash_):
            continue
        order, bucket, n = _bucketed(hash_, buckets)
        size, cells, counts = np.zeros(len(order), np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        if not row[0].column("held_out")[row[1]].as_py():
            ids = _values([row], "ids", np.int32)
            u, at, place = _flat(ids, tail, end), np.flatnonzero(ids > end), np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            word = place[ids[at] - end - 1]
            (after, x), (before, y) = ((z <= end, z[z <= end]) for z in (u[at + 1], u[at - 1]))
            id_, cells, counts = _tally(np.concatenate((word * CELLS + 2 * CLASSES, word[after] * CELLS + label[x], word[before] * CELLS + CLASSES + label[y])))
            size = np.bincount(id_, minlength=len(order)).astype(np.uint8)
        lens, data = _laid_out(_all_words([row]).take(pa.array(order)))
        chunk, many = row[0].column("chunk")[row[1]].as_py(), _sums(size, n)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(n), chunk)), _cut(order.astype(np.int32), n), _cut(tail[order], n), _cut(lens, n), _cut(data, _sums(lens, n)), _cut(size, n), _cut(cells, many), _cut(counts, many)], names=["bucket", "chunk", "place", "tail", "lens", "data", "size", "cells", "counts"])


#: Columns of chunks for :func:`_rare_contexts`, its rows, and those of what is said of rare words.
RARE = ("chunk", "held_out", "ids", "lens", "data", "hash", "tail")
CONTEXTS = "bucket int, chunk long, place binary, tail binary, lens binary, data binary, size binary, cells binary, counts binary"
PLACED = "bucket int, chunk long, place binary, n binary, label binary, lens binary, data binary, cell int, m double"


def _placed_rows(**cols):
    """Rows of PLACED; columns that are not given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    schema, n = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, PLACED.split(", "))]), len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def _told(rows, n: np.ndarray, label: np.ndarray):
    """What goes back to each chunk: of its words in this bucket the counts and classes."""
    size = np.array([len(batch.column("place")[i].as_buffer()) // 4 for batch, i in rows])
    return _placed_rows(chunk=pa.array([batch.column("chunk")[i].as_py() for batch, i in rows]), place=_cut(_values(rows, "place", np.int32), size), n=_cut(n.astype(np.int64), size), label=_cut(label.astype(np.uint8), size))


def _placed(batches, tables):
    """Of rows sorted by bucket: the count and best class of each word, as rows of the bucket and of each chunk; in the end (cells) what this adds to the bigrams of classes, which had the words in the classes of their endings, then occurrences and words by class."""
    follow, size, usual, classes = tables.value
    extra, times, kinds = np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES), np.zeros(CLASSES)
    for bucket, rows in _rows_by(batches, "bucket"):
        coded = _all_words(rows).dictionary_encode()
        word, words = coded.indices.to_numpy(), coded.dictionary
        e, n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        e[word] = _values(rows, "tail", np.uint8)
        of = np.repeat(word, _values(rows, "size", np.uint8))
        order = np.argsort(of, kind="stable")
        of, cell, count = of[order].astype(np.int64), _values(rows, "cells", np.uint8)[order], _values(rows, "counts", np.uint32)[order]
        for a in range(0, len(words), BLOCK):
            b = min(a + BLOCK, len(words))
            i, j = np.searchsorted(of, (a, b))
            cells = np.bincount((of[i:j] - a) * CELLS + cell[i:j], count[i:j], (b - a) * CELLS).reshape(b - a, CELLS)
            r, p, k = cells[:, :CLASSES], cells[:, CLASSES : 2 * CLASSES], cells[:, 2 * CLASSES]
            more = usual[e[a:b]] * prior_share(k)[:, None]
            to = likelihoods(r + more[:, :CLASSES], p + more[:, CLASSES:], 0 * k, k + PRIOR * prior_share(k), follow, size).argmax(1)
            had = classes[e[a:b]]
            n[a:b], best[a:b] = k, np.where(k > 0, to, had)  # words of held-out texts alone go by their ending
            moved = np.eye(CLASSES)[best[a:b]] - np.eye(CLASSES)[had]
            extra += moved.T @ r + p.T @ moved
        yield _told(rows, n[word], best[word])
        seen = n > 0
        times += np.bincount(best[seen], n[seen], CLASSES)
        kinds += np.bincount(best[seen], minlength=CLASSES)
        lens, data = _laid_out(words.filter(pa.array(seen)))
        yield _placed_rows(bucket=pa.array([bucket]), n=_one(n[seen]), label=_one(best[seen].astype(np.uint8)), lens=_one(lens), data=_one(data))
    sums = np.concatenate((extra.ravel(), times, kinds))
    at = np.flatnonzero(sums)
    yield _placed_rows(cell=pa.array(at), m=pa.array(sums[at]))


def _looked_up(batches, endings: np.ndarray):
    """Of rows sorted by bucket, the model's first: the count and class of the words of each chunk, as the model has them."""
    for _, rows in _rows_by(batches, "bucket"):
        mine = [x for x in rows if x[0].column("chunk")[x[1]].as_py() is None]
        rows = rows[len(mine) :]
        if rows:
            n, label = (np.append(_values(mine, x, kind), 0).astype(np.int64) for x, kind in (("n", np.int64), ("label", np.uint8)))
            at = pc.fill_null(pc.index_in(_all_words(rows), value_set=_all_words(mine)), -1).to_numpy()
            yield _told(rows, n[at], np.where(at < 0, endings[_values(rows, "tail", np.uint8)], label[at]))


@dataclass
class BrownModel:
    """What training leaves: tables of bounded size, and ``placed`` (packed, in ``buckets`` by hash) of all other training words."""

    placed: DataFrame = field(repr=False)
    buckets: int
    tokens: int
    types: int
    documents: int
    known: dict[bytes, int] = field(repr=False)  # word -> rank
    times: np.ndarray = field(repr=False)  # by rank; the last is the end
    label: np.ndarray = field(repr=False)  # by rank
    endings: np.ndarray = field(repr=False)  # class of a word that is not in the training texts
    transition: np.ndarray = field(repr=False)  # log10, class before by class
    emission: np.ndarray = field(repr=False)  # log10 of the divisor, by class
    moved: list[int] = field(default_factory=list)  # known words that moved, by round
    base: float = 0.0  # log10 of the divisor

    @property
    def rare(self) -> DataFrame:
        """(word, n, label) of all training words that are not known."""
        rows = self.placed.where("bucket is not null").select("n", "label", "lens", "data")
        return rows.mapInArrow(partial(_unpacked, least=0, longest=None, names=["word", "n", "label"]), "word binary, n long, label int")

    @property
    def converged(self) -> bool:
        return not self.moved or self.moved[-1] == 0


def split_texts(docs: DataFrame, *, id_col: str | None, text_col: str) -> DataFrame:
    """The rows of ``docs`` as chunks (:data:`CHUNK`), written once; without ``id_col`` no row is held out or has an id."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_, out = (F.col(id_col), held_out(F.col(id_col))) if id_col else (F.lit(None).cast("long"), F.lit(False))
    slim = small_batches(docs).select(id_.alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType
    return materialise(slim.mapInArrow(partial(_chunks, kind=to_arrow_type(kind), most=TOKENS), CHUNK.format(kind=kind.simpleString())), "chunks", **PAGES)


def as_ids(chunks: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Chunks by the ranks of ``known``, written once; ``chunks`` (of :func:`split_texts`) are deleted."""
    words = chunks.sparkSession.sparkContext.broadcast(pa.array(list(known), pa.binary()))
    ids = materialise(chunks.mapInArrow(partial(_ranked, known=words), chunks.schema), "ids", **PAGES)
    discard(chunks)
    return ids


def by_bucket(rows: DataFrame, *then: Column) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", *then)


def bucket_count(chunks: DataFrame) -> int:
    """For about BUCKET words of chunks each, and some for each partition of a shuffle."""
    kinds = chunks.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    return max(ceil(kinds / BUCKET), 4 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def count_words(chunks: DataFrame) -> DataFrame:
    """The distinct words of all ``chunks`` and their counts, a packed row per bucket; ``kinds``: how many."""
    rows = chunks.select("n", "lens", "data", "hash").mapInArrow(partial(_to_count, buckets=bucket_count(chunks)), "bucket int, n binary, lens binary, data binary")
    return materialise(by_bucket(rows).mapInArrow(_counted, "kinds long, n binary, lens binary, data binary"), "words")


def known_words(counts: DataFrame) -> dict[bytes, int]:
    """The KNOWN commonest words and how often they stand; the commonest first."""
    left, least = KNOWN, COMMON + 1
    for r in counts.select("n", "lens").mapInArrow(partial(_how_common, longest=LONGEST), "n long, kinds long").groupBy("n").agg(F.sum("kinds").alias("kinds")).orderBy(F.desc("n")).collect():  # at most COMMON rows
        if left <= 0:
            break
        left, least = left - r.kinds, r.n
    rows = counts.select("n", "lens", "data").mapInArrow(partial(_unpacked, least=least, longest=LONGEST, names=["word", "n"]), "word binary, n long")
    top = rows.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    return dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))


def fit_ids(ids: DataFrame, counts: DataFrame, known: dict[bytes, int]) -> BrownModel:
    """Train on the rows of ``ids`` (:func:`as_ids` by ``known``) that are not held out; ``counts``: :func:`count_words` of them."""
    spark, all_ids = ids.sparkSession, ids
    share, end = spark.sparkContext.broadcast, len(known)
    types = counts.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    ids = all_ids.where("not held_out").select("ids", "tail")
    documents, tokens = all_ids.where("not held_out").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    home = np.fromiter(map(_ending, known), np.int64, end) + CORE
    home[:CORE] = np.arange(min(end, CORE))
    unit = np.concatenate((home, [UNITS - 1], CORE + np.arange(ENDINGS)))
    cells = ids.mapInArrow(partial(_unit_bigrams, units=share(unit), end=end), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most UNITS x UNITS rows
    bigrams = np.zeros(UNITS * UNITS)
    bigrams[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    label, m, usual, moved = exchange_words(ids, exchange(bigrams.reshape(UNITS, UNITS))[unit].astype(np.uint8), unit)
    times = np.append(np.fromiter(known.values(), np.int64, end), documents)
    size, follow = m.sum(0), followers(m)
    label, endings = label[: end + 1], label[end + 1 :].astype(np.int64)
    buckets = bucket_count(all_ids)
    seen = all_ids.select(*RARE).mapInArrow(partial(_rare_contexts, labels=share(label), end=end, buckets=buckets), CONTEXTS)
    placed = materialise(by_bucket(seen).mapInArrow(partial(_placed, tables=share((follow, size, usual, endings))), PLACED), "placed")
    sums = np.zeros(CLASSES * CLASSES + 2 * CLASSES)
    for r in placed.where("cell is not null").groupBy("cell").agg(F.sum("m").alias("m")).collect():  # at most as many rows as cells
        sums[r.cell] = r.m
    m += sums[: CLASSES * CLASSES].reshape(CLASSES, CLASSES)
    size = np.bincount(label, times, CLASSES) + sums[-2 * CLASSES : -CLASSES]
    kinds = np.bincount(label[:-1], minlength=CLASSES) + sums[-CLASSES:]
    prior = (size + 1) / (tokens + CLASSES)
    transition = np.log10((m + BETA * prior) / (m.sum(1, keepdims=True) + BETA))
    emission = np.log10(size + EMIT * (kinds + 1))
    all_ = int(types) + int(documents > 0)
    return BrownModel(placed, buckets, tokens, all_, documents, {w: i for i, w in enumerate(known)}, times, label, endings, transition, emission, moved, log10(tokens + ALPHA * (all_ + 1)))


def fit(docs: DataFrame, *, text_col: str = "text") -> BrownModel:
    """Train on all rows of ``docs``; null and empty texts are only an end."""
    chunks = split_texts(docs, id_col=None, text_col=text_col)
    counts = count_words(chunks)
    known = known_words(counts)
    return fit_ids(as_ids(chunks, known), counts, known)


def _scored(batches, model, end: int, schema: pa.Schema):
    """Of rows sorted by chunk, what is told of its rare words before its texts: a row per text."""
    times, label, transition, emission, base, tokens = model.value
    for chunk, rows in _rows_by(batches, "chunk"):
        (batch, i), told = rows[-1], rows[:-1]
        ids, kinds, place = _values(rows[-1:], "ids", np.int32), batch.column("kinds")[i].as_py(), _values(told, "place", np.int32)
        if len(place) != kinds:
            raise RuntimeError(f"{len(place)} of {kinds} rare words of chunk {chunk} are told")
        n, c = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
        n[place], c[place] = _values(told, "n", np.int64), _values(told, "label", np.uint8)
        n, c = np.concatenate((times, n)), np.concatenate((label, c))
        inner = np.log10(n + EMIT) - emission[c]
        inner[end] = 0.0  # the end is sure within its class
        by_class = c[ids]
        step, token, known = transition[by_class[:-1], by_class[1:]] + inner[ids[1:]], np.log10(n + ALPHA)[ids[1:]], (n > 0)[ids[1:]]
        first = np.flatnonzero(ids == end)[:-1]  # the end before each text
        size = np.diff(np.append(first, len(ids) - 1))
        cols = [batch.column("doc_id").slice(i, 1).flatten(), pa.array(np.full(len(first), batch.column("held_out")[i].as_py())), pa.array(size), pa.array(np.add.reduceat(known, first, dtype=np.int64)), pa.array(np.full(len(first), tokens)), pa.array(np.add.reduceat(token, first) - size * base), pa.array(np.add.reduceat(step, first))]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)


def score_ids(ids: DataFrame, told: DataFrame, model: BrownModel) -> DataFrame:
    """The scores of all texts of ``ids``; ``told``: rows of PLACED for each chunk that has rare words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = ids.schema["doc_id"].dataType.elementType
    tables = ids.sparkSession.sparkContext.broadcast((model.times, model.label.astype(np.int64), model.transition, model.emission, model.base, model.tokens))
    rows = ids.select("chunk", "kinds", "held_out", "doc_id", "ids").unionByName(told.where("chunk is not null").select("chunk", "place", "n", "label"), allowMissingColumns=True)
    rows = rows.repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk").sortWithinPartitions("chunk", F.col("ids").isNotNull())
    schema = T.StructType.fromDDL(f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rows.mapInArrow(partial(_scored, model=tables, end=len(model.known), schema=to_arrow_schema(schema)), schema)


def score(docs: DataFrame, model: BrownModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row of ``docs``.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` that of
    the class model; the end of the document is a token. Null and empty texts
    are an end alone. Repeated rows give repeated rows, an empty table an empty
    one. Perplexity is 10 ** (-score / n_tokens).
    """
    ids = as_ids(split_texts(docs, id_col=id_col, text_col=text_col), model.known)
    asked = ids.select(*RARE).withColumn("held_out", F.lit(True)).mapInArrow(partial(_rare_contexts, labels=ids.sparkSession.sparkContext.broadcast(model.label), end=len(model.known), buckets=model.buckets), CONTEXTS)
    rows = model.placed.where("bucket is not null").select("bucket", "n", "label", "lens", "data").unionByName(asked.select("bucket", "chunk", "place", "tail", "lens", "data"), allowMissingColumns=True)
    told = by_bucket(rows, F.col("chunk").isNotNull()).mapInArrow(partial(_looked_up, endings=model.endings), PLACED)
    return score_ids(ids, told, model)


def brown_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`fit` on the rows that :func:`held_out` leaves, then :func:`score` of all rows; texts are split once, and rare words meet once, for both."""
    chunks = split_texts(docs, id_col=id_col, text_col=text_col)
    counts = count_words(chunks.where("not held_out"))
    known = known_words(counts)
    ids = as_ids(chunks, known)
    model = fit_ids(ids, counts, known)
    return score_ids(ids, model.placed, model)
