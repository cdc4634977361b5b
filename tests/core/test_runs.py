from itertools import count

from palimpsest.operators import history, metrics
from palimpsest.plans import runs
from palimpsest.plans.stress import stress_history
from palimpsest.plans.workload import YcsbConfig, cut
from palimpsest.sources.store import Db

SMALL = YcsbConfig(records=60, scan_length=3)


def ticks():
    c = count()
    return lambda: next(c) / 1000


def test_runs_by_one_and_by_several(spark, tmp_path):
    path = str(tmp_path / "s")
    with Db.open(spark, path) as db:
        runs.load(db, SMALL)
        rows, seconds = runs.run(db, "A", 20, ticks(), config=SMALL)
        assert rows.count() == 20 and seconds > 0 and rows.where("aborted").count() == 0 and rows.where("latency_us != 1000").count() == 0
        rows, seconds = runs.run(db, "F", 6, ticks(), workers=3, warmup=2, config=SMALL)
        assert rows.groupBy("worker").count().where("count = 6").count() == 3
        one = runs.summary("F", rows, seconds).first()
        assert one.n == 18 and one.aborts == rows.where("aborted").count() and one.ops_per_sec > 0
        assert runs.run(db, "E", 3, ticks(), config=SMALL)[0].count() == 3
        db.flush()
        assert runs.space_amplification(db) > 1
    times = runs.cold_start(spark, path, b"user000000000007", ticks())
    assert times["open_s"] > 0 and times["first_read_s"] > 0
    with Db.open(spark, path) as db, db.begin() as t:
        assert len(t.get(b"user000000000007")) == 100


def test_several_runs(spark):
    done = runs.multi_run(spark, "C", 2, 3, ticks(), config=SMALL)
    assert metrics.multi_run_medians(done, ["workload"], ["p50", "ops_per_sec"]).first().n_runs == 2


def test_stress_through_the_store_decides_like_the_replay(spark, tmp_path):
    ops, txns = map(cut, stress_history(spark, 3, batches=6))
    want = {r.txn: r.committed for r in history.replay(ops, txns, "ssi", "history").collect()}
    for crashes in (False, True):
        fate = cut(runs.stress(spark, str(tmp_path / f"x{crashes}"), ops, txns, crashes))
        assert {r.txn: r.committed for r in fate.collect()} == want and 0 < sum(want.values()) < len(want)
        assert fate.where("lost > 0").count() == 0 and runs.cyclic(ops, txns, fate).count() == 0
