"""DataFrame operators against small literal cases and a brute-force store."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import gc, history, learned, metrics, model, recovery, snapshot
from palimpsest.plans import workload
from palimpsest.queries import queries
from palimpsest.schema import LOG

VERSIONS = "k string, commit_ts long, is_delete boolean, v double"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["", "foo", "foop", "a", "b", "zz"]) + str(rng.randrange(4)), ts, rng.random() < 0.25, None) for ts in rng.sample(range(1, 400), 200)]
    return [(k, ts, gone, None if gone else float(ts)) for k, ts, gone, _ in rows]


def brute(log, ts):
    out = {}
    for k, t, gone, v in sorted(log, key=lambda r: r[1]):
        if t <= ts:
            out[k] = None if gone else v
    return out


def test_snapshots_and_ranges(spark, log):
    df = spark.createDataFrame(log, VERSIONS).cache()
    for ts in (0, 1, 77, 200, 500):
        live = {k: v for k, v in brute(log, ts).items() if v is not None}
        assert {r.k: r.v for r in snapshot.snapshot(df, ts).collect()} == live
        for lo, hi, li, ri in itertools.product((None, "a1", "foo2"), (None, "foop0", "zz1"), (True, False), (True, False)):
            want = sorted(k for k in live if (lo is None or k > lo or li and k == lo) and (hi is None or k < hi or ri and k == hi))
            if ts == 200:
                assert [r.k for r in snapshot.scan(df, ts, start=lo, end=hi, start_inclusive=li, end_inclusive=ri).collect()] == want
    for k in ("foo1", "none"):
        got = snapshot.get(df, k, 200).first()
        assert (got.v if got else None) == brute(log, 200).get(k)


def test_binary_keys_order_as_bytes(spark):
    keys = [b"\x7f", b"\x7f\x00", b"\xff", b"foo", b"foop"]
    df = spark.createDataFrame([(bytearray(k), 1, False, None) for k in keys], "k binary, commit_ts long, is_delete boolean, v binary")
    assert [bytes(r.k) for r in snapshot.scan(df, 1).collect()] == sorted(keys)
    assert [bytes(r.k) for r in snapshot.scan(df, 1, start=bytearray(b"\x7f"), end=bytearray(b"\x80")).collect()] == [b"\x7f", b"\x7f\x00"]


@pytest.mark.parametrize("width", [None, 1, 37, 1000])
def test_as_of_many(spark, log, width):
    rng = random.Random(2)
    asks = [(i, rng.choice([r[0] for r in log] + ["none"]), rng.randrange(420)) for i in range(100)]
    got = snapshot.as_of_many(spark.createDataFrame(asks, "req int, k string, ts long"), spark.createDataFrame(log, VERSIONS), width).collect()
    assert len(got) == 100
    for r in got:
        mine = max((x for x in log if x[0] == r.k and x[1] <= r.ts), key=lambda x: x[1], default=None)
        want = ("NotFound", None, None) if mine is None else ("Deleted" if mine[2] else "Found", mine[1], mine[3])
        assert (r.status, r.commit_ts, r.v) == want


def test_collection_8_8(spark, log):
    df = spark.createDataFrame([("k", t, False, 0.0) for t in (100, 80, 60, 40, 20)], VERSIONS)
    assert sorted(r.commit_ts for r in gc.gc_keep(df, 50).collect()) == [40, 60, 80, 100]
    assert sorted(r.commit_ts for r in gc.gc_marked(df, 50).where("keep").collect()) == [40, 60, 80, 100]
    df = spark.createDataFrame(log, VERSIONS)
    for w in (0, 150, 400):
        kept = [(r.k, r.commit_ts, r.is_delete, r.v) for r in gc.gc_keep(df, w).collect()]
        for ts in range(w, 420, 30):
            assert brute(kept, ts) == brute(log, ts)
        assert len(kept) == len(log) - sum(r.n_dropped for r in gc.gc_dropped_counts(df, w).collect())


def test_compaction_files(spark, log, tmp_path):
    df = spark.createDataFrame(log, VERSIONS)
    gc.compact(df, 150, str(tmp_path / "c"), parts=2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == gc.gc_keep(df, 150).count()


def test_picking_compactions(spark):
    f = lambda *rows: spark.createDataFrame(rows, "level int, file_num long, size long, min_key string, max_key string")
    mb = 1 << 20
    assert gc.pick_compaction(f((0, 1, 1, "a", "c"), (1, 2, mb, "b", "d"))) is None
    got = gc.pick_compaction(f(*((0, i, 1, "a", "c") for i in range(4)), (1, 9, mb, "c", "d"), (1, 10, mb, "e", "f")))
    assert got == {"level": 0, "target": 1, "inputs": [0, 1, 2, 3], "overlaps": [9]}
    got = gc.pick_compaction(f((1, 1, 40 * mb, "a", "b"), (1, 2, 41 * mb, "c", "d"), (2, 3, mb, "d", "e"), (2, 4, mb, "f", "g")))
    assert got == {"level": 1, "target": 2, "inputs": [2], "overlaps": [3]}


def test_overlaps_are_made_once_and_from_lists(spark):
    rng = random.Random(8)  # wide and narrow ranges, equal keys, ends before starts, equal numbers, files without a number, more files than a list holds
    rows = [(rng.randrange(4), n % 590 if n else None, lo := rng.randrange(40), lo + rng.choice([0, 1, 9, 30]) - (5 if n % 97 == 1 else 0)) for n in range(600)]
    files = spark.createDataFrame([(level, n, f"{lo:03d}", f"{hi:03d}" if hi >= 0 else "") for level, n, lo, hi in rows], "level int, file_num long, min_key string, max_key string")
    ends = [(*r, max(r[3], -1)) for r in rows]
    less = lambda a, b: a is not None and b is not None and a < b
    hit = lambda a, b: (a[0] == b[0] and less(a[1], b[1]) or b[0] == a[0] + 1) and a[2] <= b[4] and b[2] <= a[4]
    order = lambda rows: sorted(rows, key=str)
    want = order((a[0], a[1], b[0], b[1]) for a in ends for b in ends if hit(a, b))
    for cells in (1, 2, 7, 1024):
        assert order(tuple(r) for r in gc.file_overlaps(files, cells).collect()) == want
    assert gc.file_overlaps(files.limit(0)).count() == 0
    # 2,000 files over 50 keys, each of them over 30 cells: lists are sent to the cells, not every file
    wide = spark.range(2000).selectExpr("0 level", "id file_num", "lpad(id % 50, 3, '0') min_key", "lpad(id % 50 + 30, 3, '0') max_key")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = gc.file_overlaps(wide)
        assert len(got.collect()) == sum(abs(a % 50 - b % 50) <= 30 for a in range(2000) for b in range(a))
        nodes = [got._jdf.queryExecution().executedPlan()]
        for p in nodes:
            nodes += [p.children().apply(i) for i in range(p.children().size())]
        assert sum(p.metrics().apply("shuffleRecordsWritten").value() for p in nodes if p.nodeName() == "Exchange") < 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_watermark(spark):
    t = spark.createDataFrame([(1, 5, None, "Active"), (2, 3, 9, "Committed")], "txn long, begin_ts long, commit_ts long, status string")
    assert gc.gc_watermark(t).first()[0] == 5 and gc.gc_watermark(t.where("txn = 2")).first()[0] == 10 and gc.gc_watermark(t.limit(0)).first()[0] == 1


def histories(n, txns, keys, seed):
    rng = random.Random(seed)
    for _ in range(n):
        ts = rng.sample(range(1, 100), 2 * txns)
        yield [(i, *sorted(ts[2 * i : 2 * i + 2]), {rng.randrange(keys) for _ in range(rng.randrange(3))}, {rng.randrange(keys) for _ in range(rng.randrange(3))}) for i in range(txns)]


def cyclic(h, done):
    """Whether committed transactions have a dependency cycle; edges between neighbouring versions and their readers."""
    edges = set()
    for k in {k for t in h for k in t[3] | t[4]}:
        w = sorted((t for t in h if t[0] in done and k in t[4]), key=lambda t: t[2])
        edges |= {(a[0], b[0]) for a, b in itertools.combinations(w, 2)}
        for r in (t for t in h if t[0] in done and k in t[3]):
            for x in w:
                if x[0] != r[0]:
                    edges.add((x[0], r[0]) if x[2] <= r[1] else (r[0], x[0]))
    left = set(done)
    while True:
        stay = {x for x in left if any(a == x and b in left for a, b in edges) and any(b == x and a in left for a, b in edges)}
        if stay == left:
            return bool(left), edges
        left = stay


def frames(spark, hs):
    ops = [(100 * n + t, 0, f"h{n}k{k}", op) for n, h in enumerate(hs) for t, _, _, r, w in h for op, ks in (("r", r), ("w", w)) for k in ks]
    txns = [(100 * n + t, b, c, n) for n, h in enumerate(hs) for t, b, c, *_ in h]
    return spark.createDataFrame(ops, "txn long, op_no long, k string, op string"), spark.createDataFrame(txns, "txn long, begin_ts long, commit_ts long, h long")


def test_replay_never_commits_a_cycle(spark):
    hs = list(histories(400, 6, 3, 1))
    ops, txns = frames(spark, hs)
    out = {m: history.replay(ops, txns, m, "h").where("committed").collect() for m in ("si", "case1", "ssi")}
    bad = {m: sum(cyclic(h, {r.txn - 100 * n for r in rows if r.history == n})[0] for n, h in enumerate(hs)) for m, rows in out.items()}
    assert bad["ssi"] == 0 < bad["si"]
    assert len(out["ssi"]) < len(out["si"])


def test_read_only_anomaly_8_1(spark):
    h = [(0, 1, 6, {"B"}, {"A"}), (1, 2, 3, set(), {"B"}), (2, 4, 7, {"A", "B"}, set())]
    ops, txns = frames(spark, [h])
    done = {m: {r.txn for r in history.replay(ops, txns, m, "h").where("committed").collect()} for m in ("case1", "ssi")}
    assert done == {"case1": {0, 1, 2}, "ssi": {0, 1}} and cyclic(h, done["case1"])[0]


def test_stress_histories(spark):
    from palimpsest.plans.stress import stress, stress_history

    ops, txns = stress_history(spark, 60)
    got = {m: stress(ops, txns, m).collect() for m in ("si", "ssi")}
    assert sum(r.n_cyclic for r in got["ssi"]) == 0 < sum(r.n_cyclic for r in got["si"])
    assert len(got["ssi"]) == 60 and {r.n_txns for r in got["ssi"]} == {40} and all(0 < r.abort_rate < 0.9 for r in got["ssi"])


def test_edges_and_cycles_like_brute_force(spark):
    for h in histories(8, 7, 3, 5):
        ops, txns = frames(spark, [h])
        want, edges = cyclic(h, {t[0] for t in h})
        got = {(r.src, r.dst) for df in (history.ww_edges(ops, txns), history.wr_edges(ops, txns)) for r in df.collect()} | {(r.src, r.dst) for r in history.rw_edges(ops, txns).collect() if dict((t[0], t[1]) for t in h)[r.src] < dict((t[0], t[2]) for t in h)[r.dst]}
        assert got == edges
        assert (history.in_cycles(history.adjacent_edges(ops, txns), txns).count() > 0) == want


def test_adjacent_edges_in_one_pass_over_a_key(spark):
    rng = random.Random(3)  # one key; timestamps of writers and readers may be equal
    rows = [(i, b := rng.randrange(60), b + rng.randrange(1, 9), rng.choice("rwd")) for i in range(80)]
    ops = spark.createDataFrame([(i, i, "k", op) for i, _, _, op in rows], "txn long, op_no long, k string, op string")
    txns = spark.createDataFrame([(i, b, c) for i, b, c, _ in rows], "txn long, begin_ts long, commit_ts long")
    line = sorted((c, 0, i) if op != "r" else (b, 1, i) for i, b, c, op in rows)
    want = set()
    for at, (_, kind, i) in enumerate(line):
        prev = next((x for _, n, x in reversed(line[:at]) if not n), None)
        after = next((x for _, n, x in line[at + 1 :] if not n), None)
        want |= {(prev, i, "wr" if kind else "ww")} if prev is not None else set()
        want |= {(i, after, "rw")} if kind and after is not None else set()
    got = history.adjacent_edges(ops, txns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()  # it would be read anew for each row


PAIRS = {
    "rw": (history.rw_edges, lambda a, b: a[3] == "r" and b[3] != "r" and a[1] < b[2]),
    "ww": (history.ww_edges, lambda a, b: a[3] != "r" and b[3] != "r" and a[2] < b[2]),
    "wr": (history.wr_edges, lambda a, b: a[3] != "r" and b[3] == "r" and b[1] >= a[2]),
}


@pytest.mark.parametrize("kind", PAIRS)
def test_all_pairs_of_a_hot_key(spark, kind):
    rng = random.Random(5)  # more writers than two blocks hold, equal timestamps, transactions that read and write, and one that did not commit
    rows = [(i, b := rng.randrange(2_000), b + rng.randrange(1, 90), op) for i in range(800) for op in rng.choice(["r", "w", "d", "rw"])]
    txns = {i: (i, b, c if i else None) for i, b, c, _ in rows}
    rows = [(i, txns[i][1], txns[i][2], op) for i, _, _, op in rows]
    ops = spark.createDataFrame([(i, n, "hot" if i < 790 else "cold", op) for n, (i, _, _, op) in enumerate(rows)], "txn long, op_no long, k string, op string")
    edges, holds = PAIRS[kind]
    got = edges(ops, spark.createDataFrame([*txns.values()], "txn long, begin_ts long, commit_ts long"))
    done = [r for r in rows if r[2] is not None]
    want = sorted((a[0], b[0], "hot" if a[0] < 790 else "cold") for a in done for b in done if a[0] != b[0] and (a[0] < 790) == (b[0] < 790) and holds(a, b))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert got.where("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def test_edge_counts_read_no_frame_to_the_end(spark):
    counts = queries()["edge_counts"](spark, "/root/testdata/sf0.001")
    assert "unboundedfollowing" not in counts._jdf.queryExecution().executedPlan().toString().lower()
    h = [(i, 10 * i, 10 * i + 15, {"k"}, {"k"} if i % 2 else set()) for i in range(40)]
    ops, txns = frames(spark, [h])[:2]
    e = {(r.src, r.dst) for r in history.adjacent_edges(ops, txns).collect()}
    assert history.graph_size(history.adjacent_edges(ops, txns), txns).first().asDict() == {"n_txns": 40, "n_edges": len(e)}


def test_concurrent_edges_for_any_width(spark):
    hs = list(histories(5, 8, 3, 9))
    ops, txns = frames(spark, hs)
    want = {(100 * n + a[0], 100 * n + b[0]) for n, h in enumerate(hs) for a in h for b in h if a is not b and a[3] & b[4] and a[1] < b[2] and b[1] < a[2]}
    for width in (1, 7, 64, 1000):
        assert {(r.src, r.dst) for r in history.concurrent_rw(ops, txns, width).collect()} == want
    pivots = {b for _, b in want} & {a for a, _ in want}
    assert {r.txn for r in history.pivots(ops, txns).collect()} == pivots


def test_log_replay(spark):
    rows = [
        (1, "begin", 1, None, None, None, None, None), (2, "write", 1, "a", "x", False, None, None), (3, "commit", 1, None, None, None, 5, 1),
        (4, "begin", 2, None, None, None, None, None), (5, "write", 2, "b", "y", False, None, None), (6, "abort", 2, None, None, None, None, None),
        (7, "begin", 3, None, None, None, None, None), (8, "write", 3, "c", "z", False, None, None),
        (9, "write", 4, "d", "w", False, None, None), (10, "commit", 4, None, None, None, 9, 1),
        (11, "kv", None, "e", "1", False, 6, 2), (12, "batch", None, "f", "2", False, 7, 2), (13, "batch", None, "g", None, True, 7, 2),
    ]
    log = spark.createDataFrame(rows, LOG)
    assert sorted((r.k, r.commit_ts, r.is_delete, r.v) for r in recovery.replay_log(log).collect()) == [("a", 5, False, "x"), ("e", 6, False, "1"), ("f", 7, False, "2"), ("g", 7, True, None)]
    assert recovery.log_maxima(log).first().max_ts == 9
    assert recovery.survives_crash(log, 2).count() == 2
    r = recovery.commits_per_fsync(log).first()
    assert (r.commits, r.fsyncs, r.commits_per_fsync) == (5, 2, 2.5) and recovery.commits_per_fsync(log.limit(0)).first().commits_per_fsync == 0


def test_model_queries(spark):
    ops = spark.createDataFrame([(1, "a", False, "1"), (2, "a", False, "2"), (3, "b", True, None), (4, "c", False, None), (5, "d", False, "4")], "op_no long, k string, is_delete boolean, v string")
    m = model.model_state(ops)
    actual = spark.createDataFrame([("a", "2"), ("b", "zombie"), ("c", None), ("ghost", "x")], "k string, v string")
    s = model.compare_summary(model.compare(m, actual)).first()
    assert (s.matching, s.mismatches, s.missing_from_actual, s.unexpected_in_actual) == (2, 2, 1, 2)
    assert sorted(r.k for r in model.durability_violations(m, actual).collect()) == ["b", "d"]
    assert [r.k for r in model.phantom_keys(actual, ops, actual).collect()] == ["ghost"]
    assert [(r.check, r.passed) for r in model.report({"p": model.phantom_keys(actual, ops, actual), "q": model.durability_violations(m.limit(0), actual)}).collect()] == [("p", False), ("q", True)]
    c = model.counts(m).first()
    assert (c.live_keys, c.all_keys) == (3, 4)
    r = model.verify_recovery(m, actual).first()
    assert (r.checked, r.missing, r.incorrect) == (3, 1, 0)
    reads = spark.createDataFrame([(1, "a", "put", "1"), (2, "a", "get", "1"), (3, "a", "delete", None), (4, "a", "get", "1"), (5, "b", "get", None)], "op_no long, k string, op string, v string")
    assert [r.op_no for r in model.read_your_writes_violations(reads).collect()] == [4]
    scans = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 0, "z"), (2, 1, "y")], "scan int, pos int, k string")
    assert sorted((r.scan, r.pos) for r in model.scan_order_violations(scans).collect()) == [(1, 2), (2, 1)]
    a, b = (spark.createDataFrame(x, "pos int, k string, v string") for x in ([(0, "a", "1"), (1, "b", "2")], [(0, "a", "1"), (1, "b", "3"), (2, "c", "4")]))
    assert sorted(r.pos for r in model.scan_differences(a, b).collect()) == [1, 2]
    assert model.spot_check(m, actual, 1).count() == 2


def test_learned_index_holds_its_error(spark):
    rng = random.Random(3)
    keys = sorted({rng.randrange(1 << 40).to_bytes(6, "big") for _ in range(3000)} | {b"\xff" * 20 + bytes([i]) for i in range(5)})
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    placed = learned.positions(df, workload.cut).cache()
    assert [(bytes(r.k), r.pos) for r in placed.orderBy("pos").collect()] == [(k, i) for i, k in enumerate(keys)]
    index = learned.pgm_build(placed, epsilon=16)
    n = index.count()
    assert 1 <= n < 600
    for most in (10**6, 0):
        got = learned.pgm_search(placed, index, len(keys), 16, most=most).where("pos < lo or pos >= hi").count()
        assert got == 0
    many = placed.unionByName(placed.where("pos = 1500").select(F.explode(F.array_repeat("k", 2000)).alias("k"), "pos"))
    got = learned.pgm_search(many, index, len(keys), 16, most=0, materialise=workload.cut)
    assert got.count() == len(keys) + 2000 and got.where("pos < lo or pos >= hi or hi - lo > 33").count() == 0
    assert learned.pgm_build(placed.limit(10)) is None
    assert learned.pgm_search(placed.limit(1), None, 9).first().hi == 9


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(5000).selectExpr("cast(concat('key', id) as binary) k")
    bloom = learned.bloom_build(df, 5000)
    assert learned.bloom_probe(df, bloom, 5000).where("not may_contain").count() == 0
    false = learned.bloom_probe(spark.range(5000).selectExpr("cast(concat('other', id) as binary) k"), bloom, 5000).where("may_contain").count()
    assert false < 100 and 0.4 < learned.fill_ratio(bloom, 5000).first()[0] < 0.6
    m, k = spark.range(1).select(*learned.bloom_params(F.lit(5000), F.lit(0.01))).first()
    assert (m, k) == learned.bloom_size(5000)


def test_summaries(spark):
    rows = spark.createDataFrame([("r", x, x % 2 == 0) for x in range(1, 101)] + [("w", 0, False), ("w", 10**9, True)], "op string, latency_us long, aborted boolean")
    got = {r.op: r for r in metrics.latency_percentiles(rows, ["op"]).collect()}
    assert (got["r"].p50, got["r"].p90, got["r"].p99, got["r"].max, got["r"].mean) == (50, 90, 99, 100, 50.5) and (got["w"].p50, got["w"].max) == (1, 60_000_000)
    runs = spark.createDataFrame([("x", 3), ("x", 1), ("x", 2), ("x", 9), ("y", None)], "l string, v long")
    assert {r.l: r.median_v for r in metrics.multi_run_medians(runs, ["l"], ["v"]).collect()} == {"x": 3, "y": None}
    amp = spark.createDataFrame([("a", 10, 4), ("b", None, 4), ("c", 5, 0)], "label string, physical long, logical long")
    assert {r.label: r.amplification for r in metrics.amplification(amp).collect()} == {"a": 2.5, "b": None, "c": 1.0}
    assert history.abort_rate(rows.select((~F.col("aborted")).alias("committed")).limit(0)).first().abort_rate == 0


def test_cycle_members_like_brute_force():
    rng = random.Random(6)
    for n in (3, 8, 20):
        for _ in range(60):
            edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))}
            edges = [(a, b) for a, b in edges if a != b]
            reach = set(edges)
            while True:
                more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
                if not more:
                    break
                reach |= more
            assert sorted(history.cycle_members(*zip(*edges, strict=True)) if edges else []) == sorted(x for x in range(n) if (x, x) in reach)


def test_cycle_members_below_a_long_way():
    n = 120_000  # a chain of two-cycles: each is found with the whole way below it on the stack
    src, dst = [*range(n), *range(1, n, 2)], [*range(1, n + 1), *range(0, n, 2)]
    began = time.process_time()
    assert sorted(history.cycle_members(src, dst)) == list(range(n))
    assert time.process_time() - began < 15


@pytest.mark.parametrize("cells", [1, 7, 1024])
def test_segments_like_brute_force(spark, cells):
    rng = random.Random(cells)
    rows = [(i, a := rng.randrange(400), a + rng.choice([0, 1, 3, 20])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    for closed in (True, False):
        want, reach, now = {}, None, None
        for i, a, b in sorted(rows, key=lambda r: r[1]):
            if reach is None or a > reach or (not closed and a == reach and now != a):
                now = a
            reach = b if reach is None else max(reach, b)
            want[i] = now
        got = {r.id: r.segment for r in history.segments(df, "a", "b", closed, cells).collect()}
        assert {k: v for k, v in got.items() if closed} == {k: v for k, v in want.items() if closed}
        assert len(got) == 120
    assert history.segments(df.limit(0), "a", "b").count() == 0


def test_cycles_over_long_ways(spark):
    """A long chain without a cycle, and one that comes back over all of it."""
    ops_edges = [(i, i + 1) for i in range(300)]
    txns = spark.createDataFrame([(i, 10 * i, 10 * i + 5) for i in range(301)], "txn long, begin_ts long, commit_ts long")
    chain = spark.createDataFrame(ops_edges, "src long, dst long")
    assert history.in_cycles(chain, txns).count() == 0
    back = spark.createDataFrame([*ops_edges, (300, 0), (40, 38)], "src long, dst long")
    assert history.in_cycles(back, txns).count() == 301
    two = spark.createDataFrame([*ops_edges, (40, 38), (200, 199)], "src long, dst long")
    assert sorted(r.txn for r in history.in_cycles(two, txns).collect()) == [38, 39, 40, 199, 200]
