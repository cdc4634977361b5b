"""Analysis of transaction histories: ``ops`` (txn, k, op in r/w/d) and ``txns`` (txn, begin_ts, commit_ts).

Operations are reduced to one row per transaction and key before any join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of the edges of all pairs: writers of a key in a block, and copies of the blocks.
BLOCK, SPREAD = 256, 16


def read_set(ops: DataFrame) -> DataFrame:
    return ops.where("op = 'r'").select("txn", "k").distinct()


def write_set(ops: DataFrame) -> DataFrame:
    """Puts and deletes, one row per transaction and key."""
    return ops.where("op in ('w', 'd')").select("txn", "k").distinct()


def last_writes(ops: DataFrame) -> DataFrame:
    """The last write of each transaction to each key."""
    w = W.partitionBy("txn", "k").orderBy(F.desc("op_no"))
    return ops.where("op in ('w', 'd')").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _timed(sets: DataFrame, txns: DataFrame, p: str) -> DataFrame:
    ts = txns.where("commit_ts is not null").select("txn", "begin_ts", "commit_ts")
    return sets.join(ts, "txn").select(F.col("txn").alias(f"{p}"), F.col("begin_ts").alias(f"{p}_begin"), F.col("commit_ts").alias(f"{p}_commit"), "k")


def _writer_links(sets: DataFrame, ops: DataFrame, txns: DataFrame, inside: Callable[[Column], Column]) -> DataFrame:
    """Each row of ``sets`` (k and more) beside every ``writer`` of k whose commit is ``inside``, which holds up to a time or from one on.

    Writers of a key stand in blocks of BLOCK in commit order, so blocks are taken
    whole but for one at the edge, and only pairs that count are made. Rows are
    dealt out over SPREAD copies of the blocks, so no key is a single task.
    """
    at = W.partitionBy("k").orderBy("writer_commit", "writer")
    numbered = _timed(write_set(ops), txns, "writer").withColumn("_block", F.floor((F.row_number().over(at) - 1) / BLOCK))
    blocks = numbered.groupBy("k", "_block").agg(F.sort_array(F.collect_list(F.struct("writer_commit", "writer"))).alias("_all"))
    blocks = blocks.select("k", F.col("_all.writer_commit").alias("_at"), F.col("_all.writer").alias("_ids"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_copy"))
    blocks = blocks.withColumns({"_lo": F.col("_at")[0], "_hi": F.element_at("_at", -1)})
    parts = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.withColumn("_copy", F.pmod(F.xxhash64(*sets.columns), F.lit(SPREAD)).cast("int")).repartition(parts, "k", "_copy")
    near = dealt.join(blocks.repartition(parts, "k", "_copy").hint("merge"), ["k", "_copy"]).where(inside(F.col("_lo")) | inside(F.col("_hi")))
    whole = inside(F.col("_lo")) & inside(F.col("_hi"))
    part = F.filter("_ids", lambda _, i: inside(F.get("_at", i)))
    return near.select(*sets.columns, F.explode(F.when(whole, F.col("_ids")).otherwise(part)).alias("writer"))


def ww_edges(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """(src, dst, k): src wrote k and committed before dst did. Every pair that shares a key, as the definition asks; :func:`adjacent_edges` is the linear form."""
    both = _writer_links(_timed(write_set(ops), txns, "b"), ops, txns, lambda t: t < F.col("b_commit"))
    return both.select(F.col("writer").alias("src"), F.col("b").alias("dst"), "k")


def wr_edges(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """src wrote k, dst read it and began at or after src's commit."""
    both = _writer_links(_timed(read_set(ops), txns, "b"), ops, txns, lambda t: t <= F.col("b_begin")).where("writer <> b")
    return both.select(F.col("writer").alias("src"), F.col("b").alias("dst"), "k")


def rw_edges(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """src read k and began before dst, a writer of k, committed."""
    both = _writer_links(_timed(read_set(ops), txns, "a"), ops, txns, lambda t: t > F.col("a_begin")).where("a <> writer")
    return both.select(F.col("a").alias("src"), F.col("writer").alias("dst"), "k")


def concurrent_rw(ops: DataFrame, txns: DataFrame, width: int = 64) -> DataFrame:
    """rw edges between transactions that overlap in time, one row per (src, dst).

    The range condition becomes an equi-join on key and time bucket, so a hot key
    meets only what is near in time; the bucket where the later of the two began
    is the one that counts, so no pair comes twice. ``width`` should be about the
    usual length of a transaction.
    """
    spread = lambda df, p: df.withColumn("slot", F.explode(F.sequence(F.floor(F.col(f"{p}_begin") / width), F.floor(F.col(f"{p}_commit") / width))))
    a, b = spread(_timed(read_set(ops), txns, "a"), "a"), spread(_timed(write_set(ops), txns, "b"), "b")
    hit = "a <> b and a_begin < b_commit and b_begin < a_commit"
    first = F.col("slot") == F.floor(F.greatest("a_begin", "b_begin") / width)
    return a.join(b, ["k", "slot"]).where(hit).where(first).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def pivots(ops: DataFrame, txns: DataFrame, width: int = 64) -> DataFrame:
    """Transactions with both an incoming and an outgoing concurrent rw edge: two semi-joins, no paths."""
    e = concurrent_rw(ops, txns, width)
    into, out = e.select(F.col("dst").alias("txn")).distinct(), e.select(F.col("src").alias("txn")).distinct()
    return into.join(out, "txn", "left_semi")


def dangerous(ops: DataFrame, txns: DataFrame, width: int = 64) -> DataFrame:
    """Pivots whose incoming and outgoing edges can be chosen to end in different transactions: not one and the same on both sides."""
    e = concurrent_rw(ops, txns, width)
    ends = lambda c, other, p: e.groupBy(F.col(c).alias("txn")).agg(F.min(other).alias(f"{p}_lo"), F.max(other).alias(f"{p}_hi"))
    both = ends("dst", "src", "in").join(ends("src", "dst", "out"), "txn")
    return both.where("not (in_lo = in_hi and out_lo = out_hi and in_lo = out_lo)").select("txn")


def si_conflicts(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Transactions that wrote a key of which another committed a version between their begin and commit.

    Per key in commit order it is enough to look at the version just before: if
    any committed after this one's begin, so did the last.
    """
    w = W.partitionBy("k").orderBy("commit_ts")
    timed = write_set(ops).join(txns.where("commit_ts is not null").select("txn", "begin_ts", "commit_ts"), "txn")
    return timed.withColumn("before", F.lag("commit_ts").over(w)).where("before > begin_ts").select("txn").distinct()


def adjacent_edges(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """(src, dst, dep): edges between neighbouring versions only; linear in the operations.

    Each reader is tied to the version it sees and to the next one, each version
    to the next. The rest of ww, wr and rw edges are paths of these, so cycles
    are the same. Both neighbours come from running frames, one in each direction:
    a frame that is open to the end would be read anew for every row.
    """
    ts = txns.where("commit_ts is not null").select("txn", "begin_ts", "commit_ts")
    w = write_set(ops).join(ts, "txn").select("k", F.col("commit_ts").alias("t"), F.lit(0).alias("kind"), F.col("txn").alias("writer"), F.lit(None).cast("long").alias("reader"))
    r = read_set(ops).join(ts, "txn").select("k", F.col("begin_ts").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("writer"), F.col("txn").alias("reader"))
    by = ("t", "kind", "writer", "reader")  # a total order, so that one direction is the other's reverse
    back = W.partitionBy("k").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("k").orderBy(*map(F.desc, by)).rowsBetween(W.unboundedPreceding, -1)
    seen = w.unionByName(r).withColumn("prev", F.last("writer", True).over(back)).withColumn("next", F.last("writer", True).over(ahead))
    pair = lambda s, d, dep: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(dep).alias("dep"))
    each = F.when(F.col("kind") == 0, F.array(pair("prev", "writer", "ww"))).otherwise(F.array(pair("prev", "reader", "wr"), pair("reader", "next", "rw")))
    return seen.select(F.explode(each).alias("e")).select("e.*").where("src is not null and dst is not null and src <> dst").distinct()


def segments(rows: DataFrame, start: str, end: str, closed: bool = True, cells: int = 1024) -> DataFrame:
    """``rows`` with ``segment``: the least ``start`` of the run of intervals it belongs to.

    A run ends where no interval reaches the next ``start``; with ``closed``,
    touching is reaching. Rows are dealt by cells of their start, about ``cells``
    in all, and what earlier cells reach, a row per cell, is broadcast; so no task
    sorts the whole table.
    """
    low, high = rows.agg(F.min(start), F.max(start)).first()
    width = ((high or 0) - (low or 0)) // cells + 1
    placed = rows.withColumn("_cell", F.floor((F.col(start) - F.lit(low or 0)) / width))
    before = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # over a row per cell
    reach = placed.groupBy("_cell").agg(F.max(end).alias("_end")).select("_cell", F.max("_end").over(before).alias("_reach"))
    here = W.partitionBy("_cell").orderBy(start)
    sofar = F.greatest(F.max(end).over(here.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    apart = F.col(start) > sofar if closed else F.col(start) >= sofar
    cut = placed.join(F.broadcast(reach), "_cell").withColumn("_cut", F.when(sofar.isNull() | apart, F.col(start)))
    carried = cut.groupBy("_cell").agg(F.max("_cut").alias("_last")).select("_cell", F.max("_last").over(before).alias("_came"))
    own = F.max("_cut").over(here.rowsBetween(W.unboundedPreceding, 0))
    return cut.join(F.broadcast(carried), "_cell").withColumn("segment", F.coalesce(own, "_came")).drop("_cell", "_reach", "_cut", "_came")


def cycle_members(src: list, dst: list) -> list:
    """Nodes of the strongly connected components of more than one node, by Tarjan's method without recursion."""
    out: dict = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
    order, low, open_, stack, found = {}, {}, set(), [], []
    for root in out:
        if root in order:
            continue
        todo = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        open_.add(root)
        while todo:
            node, ahead = todo[-1]
            for x in ahead:
                if x not in order:
                    order[x] = low[x] = len(order)
                    stack.append(x)
                    open_.add(x)
                    todo.append((x, iter(out.get(x, ()))))
                    break
                if x in open_:
                    low[node] = min(low[node], order[x])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == order[node]:
                    group = [stack.pop()]
                    while group[-1] != node:  # from the end: what lies below may be the whole history
                        group.append(stack.pop())
                    open_.difference_update(group)
                    if len(group) > 1:
                        found += group
    return found


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of edges sorted by segment; only the open segment is held."""
    held = None
    for batch in batches:
        held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
        done = held[held.segment != held.segment.iloc[-1]] if len(held) else held
        if len(done):
            yield pd.DataFrame({"txn": pd.Series(cycle_members(done.src.tolist(), done.dst.tolist()), dtype="int64")})
            held = held[held.segment == held.segment.iloc[-1]]
    if held is not None and len(held):
        yield pd.DataFrame({"txn": pd.Series(cycle_members(held.src.tolist(), held.dst.tolist()), dtype="int64")})


def in_cycles(edges: DataFrame, txns: DataFrame) -> DataFrame:
    """The transactions that lie on a cycle of ``edges`` (src, dst), exactly.

    A cycle comes back in commit order, so all its gaps lie under edges that lead
    back. Runs of such overlapping edges cut the history into segments, in which
    components are found one by one; a segment is held in one task, and rounds,
    checkpoints and limits are not needed.
    """
    at = txns.where("commit_ts is not null").select("txn", "commit_ts")
    side = lambda c: at.select(F.col("txn").alias(c), F.col("commit_ts").alias(f"{c}_at"))
    timed = edges.select("src", "dst").where("src <> dst").distinct().join(side("src"), "src").join(side("dst"), "dst")
    back = timed.where("dst_at <= src_at").select(F.lit(None).cast("long").alias("txn"), F.col("dst_at").alias("lo"), F.col("src_at").alias("hi"))
    dots = at.select("txn", F.col("commit_ts").alias("lo"), F.col("commit_ts").alias("hi"))
    of = segments(back.unionByName(dots), "lo", "hi").where("txn is not null").select("txn", "segment")
    both = timed.join(of.withColumnsRenamed({"txn": "src"}), "src").join(of.withColumnsRenamed({"txn": "dst", "segment": "_to"}), "dst").where("segment = _to")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.select("segment", "src", "dst").repartition(parts, "segment").sortWithinPartitions("segment").mapInPandas(_members, "txn long")


def _replayed(batches: Iterator[pd.DataFrame], mode: str) -> Iterator[pd.DataFrame]:
    """Decide commits in order. Held: transactions that a later one may still overlap, and the last commit of keys."""
    now = None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.history, r.segment) != now:
                now, kept, last, readers, writers = (r.history, r.segment), {}, {}, {}, {}
            reads, writes = set(r.reads) if r.reads is not None else set(), set(r.writes) if r.writes is not None else set()
            why = None
            if any(last.get(k, -1) > r.begin_ts for k in writes):
                why = "write-write"
            late = lambda t: kept[t][1] > r.begin_ts  # noqa: E731, B023
            outs = {t for k in reads for t in writers.get(k, ()) if late(t)}
            ins = {t for k in writes for t in readers.get(k, ()) if mode == "case1" or late(t)}
            if why is None and mode == "case1" and outs and ins:
                why = "serialization"
            if why is None and mode == "ssi" and ((outs and ins) or any(kept[t][3] for t in outs) or any(kept[t][2] for t in ins)):
                why = "serialization"
            out.append((r.history, r.txn, why is None, why))
            if why is None:
                for t in outs:
                    kept[t][2] = True
                for t in ins:
                    kept[t][3] = True
                kept[r.txn] = [r.begin_ts, r.commit_ts, bool(ins), bool(outs), reads, writes]
                for k in reads:
                    readers.setdefault(k, set()).add(r.txn)
                for k in writes:
                    writers.setdefault(k, set()).add(r.txn)
                    last[k] = r.commit_ts
            if mode != "case1" and len(kept) > 64:  # nobody to come began before this
                for t in [t for t, x in kept.items() if x[1] <= r.oldest]:
                    x = kept.pop(t)
                    for k in x[4]:
                        readers[k].discard(t)
                    for k in x[5]:
                        writers[k].discard(t)
        yield pd.DataFrame(out, columns=["history", "txn", "committed", "reason"]).astype({"committed": bool})


def replay(ops: DataFrame, txns: DataFrame, mode: str = "ssi", history: str | None = None) -> DataFrame:
    """(history, txn, committed, reason): which transactions a manager would let commit, in commit order.

    ``si``: a written key must have no version after begin. ``ssi``: and no path
    a -> b -> c of concurrent rw edges may arise among committed transactions
    (c may be a), wherever the new one stands in it. ``case1``: only the new
    transaction as the middle counts, and readers of any time. Reads count as
    made at begin.

    A decision hangs on those before it, so a history is a sequential stream: it
    is read batch by batch in commit order and only transactions that may still
    overlap are held. Where no transaction is open a history is cut with no loss
    (not for ``case1``), and its pieces run in parallel, as do independent
    histories (column ``history`` of ``txns``; a piece is cut where no history has
    a transaction open).
    """
    if mode not in ("si", "ssi", "case1"):
        raise ValueError(mode)
    h = F.col(history) if history else F.lit(0)
    sets = ops.groupBy("txn").agg(F.collect_set(F.when(F.col("op") == "r", F.col("k"))).alias("reads"), F.collect_set(F.when(F.col("op") != "r", F.col("k"))).alias("writes"))
    w = W.partitionBy("history", "segment").orderBy(F.desc("commit_ts")).rowsBetween(W.unboundedPreceding, -1)
    timed = txns.where("commit_ts is not null").select(h.cast("long").alias("history"), "txn", "begin_ts", "commit_ts")
    timed = timed.withColumn("segment", F.lit(0).cast("long")) if mode == "case1" else segments(timed, "begin_ts", "commit_ts", closed=False)
    parts = int(txns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = timed.join(sets, "txn", "left").withColumn("oldest", F.coalesce(F.min("begin_ts").over(w), F.lit((1 << 63) - 1)))
    ready = ready.repartition(parts, "history", "segment").sortWithinPartitions("history", "segment", "commit_ts")
    return ready.mapInPandas(lambda it: _replayed(it, mode), "history long, txn long, committed boolean, reason string")


def violations(txns: DataFrame) -> DataFrame:
    """Rows that break an invariant: commit timestamps are unique, and after begin."""
    twice = txns.where("commit_ts is not null").groupBy("commit_ts").agg(F.count(F.lit(1)).alias("n"), F.min("txn").alias("txn")).where("n > 1").select("txn", F.lit("commit_ts not unique").alias("broken"))
    return twice.unionByName(txns.where("commit_ts <= begin_ts").select("txn", F.lit("commit before begin").alias("broken")))


def graph_size(edges: DataFrame, txns: DataFrame) -> DataFrame:
    """Transactions and different edges, a row."""
    n = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("n_edges"))
    return txns.agg(F.count(F.lit(1)).alias("n_txns")).crossJoin(n)  # one row each


def abort_rate(outcomes: DataFrame) -> DataFrame:
    """Transactions, aborts and their share, 0 when there are none; of a boolean column ``committed``."""
    gone = F.count_if(~F.col("committed"))
    return outcomes.agg(F.count(F.lit(1)).alias("n_txns"), gone.alias("n_aborted"), F.coalesce(F.try_divide(gone, F.count(F.lit(1))), F.lit(0.0)).alias("abort_rate"))
