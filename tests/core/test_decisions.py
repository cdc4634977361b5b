
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import gc, history, metrics, snapshot
from palimpsest.plans.simulation import SCENARIOS, run_all
from palimpsest.sources.errors import IoError
from palimpsest.sources.store import Db, Options

VERSIONS = "k string, commit_ts long, is_delete boolean, v string"


@pytest.fixture
def db(spark, tmp_path):
    with Db.open(spark, str(tmp_path / "db")) as db:
        yield db


def put(db, **rows):
    return db.transact(lambda t: [t.put(k.encode(), v) for k, v in rows.items()])


def test_8_4_two_threads_never_both_win(db):
    put(db, k=b"0")
    ts, out, gate = [db.begin(), db.begin()], [], threading.Barrier(2)

    def go(t):
        t.put(b"k", b"x")
        gate.wait()
        out.append(t.commit().aborted)

    threads = [threading.Thread(target=go, args=(t,)) for t in ts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out) == [False, True]


def test_8_5_watermark_never_passes_a_live_begin(db):
    t = db.begin()
    assert db.gc_watermark() == t.begin_ts
    t.rollback()


def test_8_6_prefix_keys(db):
    put(db, foo=b"1", foop=b"2")
    db.flush()
    assert [k for k, _ in db.begin().scan()] == [b"foo", b"foop"]


def test_8_9_flush_runs_when_called(db):
    put(db, a=b"1")
    assert not db._manifest["parts"]
    db.flush()
    assert len(db._manifest["parts"]) == 1 and not db._pending


def test_8_10_options_are_used(spark, tmp_path):
    with Db.open(spark, str(tmp_path / "o"), Options(memtable_size=1)) as db:
        put(db, a=b"1")
        assert len(db._manifest["parts"]) == 1


def test_8_13_collection_always_has_a_watermark(spark):
    df = spark.createDataFrame([("k", t, False, str(t)) for t in (1, 2, 3)], VERSIONS)
    assert gc.gc_keep(df, 1).count() == 3 and gc.dedup_latest(df).count() == 1


def test_8_14_versions_in_two_parts(db):
    put(db, k=b"1")
    old = db.begin()
    db.flush()
    put(db, k=b"2")
    db.flush()
    assert old.get(b"k") == b"1" and db.begin().get(b"k") == b"2"


def test_8_15_only_concurrent_readers_count(db):
    put(db, a=b"1", b=b"1")
    t = db.begin()
    t.get(b"a")
    assert not t.commit().aborted
    for _ in range(3):
        u = db.begin()
        u.get(b"b"), u.put(b"a", b"2")
        assert not u.commit().aborted
    assert len(db._committed) == 0


def test_8_18_percentiles_are_of_all_rows(spark):
    rows = spark.createDataFrame([("a", 0, 1)] * 99 + [("b", 0, 1000)], "op string, worker int, latency_us long")
    assert metrics.latency_percentiles(rows, ["worker"]).first().p99 == 1


def test_8_19_and_8_23_all_faults_are_applied(spark):
    kinds = run_all(spark, range(30), [SCENARIOS["chaos"]]).select(F.explode(F.json_object_keys("faults"))).distinct()
    assert {r[0] for r in kinds.collect()} == {"crash", "lost_part", "extra_part", "disk_full", "slow", "skew"}


def test_8_20_flushed_entries_are_not_replayed(spark, tmp_path):
    path = str(tmp_path / "r")
    with Db.open(spark, path) as db:
        put(db, a=b"1")
        db.flush()
    with Db.open(spark, path) as db:  # the log is left to streams until a vacuum
        assert not db._pending and db.versions().count() == 1
        assert db.vacuum(consumed=1) == ["log/00000000000000000001.json"]
    with Db.open(spark, path) as db:
        assert not db._pending and db.versions().count() == 1


def test_8_21_a_failed_write_blocks_nobody(db, monkeypatch):
    put(db, a=b"1")
    t = db.begin()
    t.put(b"a", b"2")
    create = db._files.create

    def broken(name, text):
        raise IoError("disk")

    monkeypatch.setattr(db._files, "create", broken)
    with pytest.raises(IoError):
        t.commit()
    monkeypatch.setattr(db._files, "create", create)
    assert db.begin().get(b"a") == b"1"
    assert not put(db, b=b"3").aborted


def test_8_3_strictly_later(spark):
    df = spark.createDataFrame([("k", 5, False, "x"), ("k", 6, False, "x")], VERSIONS)
    assert snapshot.has_write_after(df, 5).count() == 1 and snapshot.has_write_after(df, 6).count() == 0


def test_8_2_reads_after_an_overlapping_commit_count(spark):
    ops = spark.createDataFrame([(1, 0, "x", "r"), (1, 1, "y", "r"), (1, 2, "x", "w"), (2, 0, "x", "r"), (2, 1, "y", "r"), (2, 2, "y", "w")], "txn long, op_no long, k string, op string")
    txns = spark.createDataFrame([(1, 1, 9), (2, 2, 5)], "txn long, begin_ts long, commit_ts long")
    assert {r.txn: r.committed for r in history.replay(ops, txns).collect()} == {1: False, 2: True}
