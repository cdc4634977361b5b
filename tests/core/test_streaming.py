import random

from palimpsest.operators.snapshot import newest
from palimpsest.sources import jsonl
from palimpsest.sources.store import Db
from palimpsest.streaming.commit_log import backlog, commits_per_window, newest_per_key, publish, tail


def drain(stream, name, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_tail_equals_batch(spark, tmp_path):
    path = str(tmp_path / "db")
    rng = random.Random(1)
    with Db.open(spark, path) as db:
        for i in range(30):
            db.transact(lambda t, i=i: (t.put(b"k%d" % rng.randrange(6), b"%d" % i), t.delete(b"d%d" % rng.randrange(3))))
        want = sorted((bytes(r.k), r.commit_ts, r.is_delete, r.v and bytes(r.v)) for r in newest(db.versions(), ["k"]).collect())
        drain(newest_per_key(tail(spark, path, files_per_trigger=7)), "newest_kv")
        got = newest(spark.table("newest_kv"), ["k"]).collect()
        assert sorted((bytes(r.k), r.commit_ts, r.is_delete, r.v and bytes(r.v)) for r in got) == want
        drain(commits_per_window(tail(spark, path), 1000), "windows", "complete")
        assert tuple(spark.table("windows").first())[1:] == (30, 60)
        seen = []
        q = publish(tail(spark, path), lambda df, n: seen.append((n, df.count())), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        assert sum(n for _, n in seen) == 60


def test_flush_leaves_the_log_to_streams(spark, tmp_path):
    path = str(tmp_path / "db")
    with Db.open(spark, path) as db:
        for i in range(8):
            db.transact(lambda t, i=i: t.put(b"k%d" % i, b"v"))
            if i == 4:
                db.flush()
        drain(tail(spark, path), "all_eight", "append")
        assert spark.table("all_eight").count() == 8
        assert len(db.vacuum(consumed=3)) == 3
        rows, ts = backlog(spark, path)
        assert rows.count() == 5 and ts > 0
        drain(tail(spark, path).where(f"commit_ts > {ts}"), "the_rest", "append")
        assert spark.table("the_rest").count() == 3


def test_late_versions_do_not_revive(spark, tmp_path):
    rows = [[("a", 5, True, None), ("b", 1, False, "x")], [("a", 3, False, "old"), ("b", 2, False, "y")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "k string, commit_ts long, is_delete boolean, v string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, commit_ts long, is_delete boolean, v string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    drain(newest_per_key(s), "late")
    got = newest(spark.table("late"), ["k"]).collect()
    assert sorted((r.k, r.commit_ts, r.is_delete, r.v) for r in got) == [("a", 5, True, None), ("b", 2, False, "y")]


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    jsonl.append(df, str(tmp_path / "m"))
    jsonl.append(df, str(tmp_path / "m"))
    assert jsonl.read(spark, str(tmp_path / "m"), df.schema).count() == 2
