"""The engine's queries over the benchmark tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.encodings import digest_halves
from palimpsest.operators import gc, history, learned, metrics, model, recovery, snapshot
from palimpsest.plans import fixtures as fx
from palimpsest.plans import simulation, stress, workload
from palimpsest.sources.store import Db

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# --- relations, in SQL
V = """v AS (SELECT concat('user:', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS k, event_id + 1 AS commit_ts, event_type = 'error' AS is_delete,
  CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 2) END AS v FROM events),
t AS (SELECT CAST(floor(count(*) / 2) AS BIGINT) AS half, CAST(floor(count(*) * 7 / 10) AS BIGINT) AS w FROM events)"""
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC) AS rn FROM v, t WHERE commit_ts <= half) WHERE rn = 1"
H = """ops AS (SELECT CAST(floor(event_id / 4) AS BIGINT) AS txn, event_id AS op_no, concat('user:', lpad(CAST(user_id % 40 AS VARCHAR), 8, '0')) AS k,
  CASE WHEN event_type IN ('view', 'click') THEN 'r' WHEN event_type = 'error' THEN 'd' ELSE 'w' END AS op FROM events),
txns AS (SELECT DISTINCT CAST(floor(event_id / 4) AS BIGINT) AS txn, 10 * CAST(floor(event_id / 4) AS BIGINT) AS begin_ts,
  10 * (CAST(floor(event_id / 4) AS BIGINT) + CAST(floor(event_id / 4) AS BIGINT) % 4) + 5 + CAST(floor(event_id / 4) AS BIGINT) % 4 AS commit_ts FROM events),
r AS (SELECT DISTINCT txn, k, begin_ts, commit_ts FROM ops JOIN txns USING (txn) WHERE op = 'r'),
w AS (SELECT DISTINCT txn, k, begin_ts, commit_ts FROM ops JOIN txns USING (txn) WHERE op <> 'r'),
rw AS (SELECT DISTINCT a.txn AS src, b.txn AS dst FROM r a JOIN w b USING (k) WHERE a.txn <> b.txn AND a.begin_ts < b.commit_ts AND b.begin_ts < a.commit_ts)"""
LOG = """e AS (SELECT event_id AS i, concat('user:', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS k, event_type = 'error' AS gone, round(value, 2) AS v, CAST(floor(event_id / 4) AS BIGINT) AS txn FROM events),
wr AS (SELECT 3 * i + 1 AS pos, txn, k, gone, v FROM e),
be AS (SELECT 3 * i AS pos, txn FROM e WHERE i % 4 = 0 AND txn % 11 <> 0),
en AS (SELECT 3 * i + 2 AS pos, txn, txn % 7 = 0 AS aborts FROM e WHERE i % 4 = 3 AND txn % 5 <> 0)"""
FILES = """f AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 10 < 4 THEN 1 ELSE 2 END AS level, p_partkey AS file_num, CAST(trunc(p_retailprice * 100) AS BIGINT) AS size,
  lpad(CAST(p_partkey * 7 % 1000 AS VARCHAR), 6, '0') AS min_key, lpad(CAST(p_partkey * 7 % 1000 + p_size AS VARCHAR), 6, '0') AS max_key FROM part)"""
# the model sees all events, the actual store misses some and has some wrong or extra
M = """o AS (SELECT event_id, concat('user:', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS k, event_type = 'error' AS is_delete, CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 2) END AS v, user_id FROM events),
m AS (SELECT k, is_delete, v, user_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS rn FROM o) WHERE rn = 1),
a AS (SELECT CASE WHEN user_id % 13 = 5 THEN concat('ghost:', k) ELSE k END AS k, CASE WHEN user_id % 11 = 3 THEN v + 1 ELSE v END AS v FROM m WHERE NOT is_delete AND user_id % 7 <> 2
  UNION ALL SELECT k, 0.0 AS v FROM m WHERE is_delete AND user_id % 3 = 0)"""


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _half(spark, d):
    return fx.last_ts(spark, d) // 2


def _w(spark, d):
    return fx.last_ts(spark, d) * 7 // 10


# --- E, F: reads
@query("snapshot_get", f"WITH {V} SELECT k, commit_ts, v FROM ({LAST}) WHERE k = 'user:00000012' AND NOT is_delete")
def snapshot_get(spark, d):
    ts = _half(spark, d)
    return snapshot.get(fx.version_log(spark, d, upto=ts), "user:00000012", ts).select("k", "commit_ts", "v")


@query("snapshot_all", f"WITH {V} SELECT k, commit_ts, v FROM ({LAST}) WHERE NOT is_delete")
def snapshot_all(spark, d):
    ts = _half(spark, d)
    return snapshot.snapshot(fx.version_log(spark, d, upto=ts), ts).select("k", "commit_ts", "v")


@query("snapshot_scan_range", f"WITH {V} SELECT k, v FROM ({LAST}) WHERE NOT is_delete AND k >= 'user:00000010' AND k < 'user:00000100' ORDER BY k")
def snapshot_scan_range(spark, d):
    ts = _half(spark, d)
    return snapshot.scan(fx.version_log(spark, d, upto=ts), ts, start="user:00000010", end="user:00000100").select("k", "v")


@query("snapshot_scan_exclusive", f"WITH {V} SELECT k, v FROM ({LAST}) WHERE NOT is_delete AND k > 'user:00000010' AND k <= 'user:00000020' ORDER BY k")
def snapshot_scan_exclusive(spark, d):
    ts = _half(spark, d)
    return snapshot.scan(fx.version_log(spark, d, upto=ts), ts, start="user:00000010", end="user:00000020", start_inclusive=False, end_inclusive=True).select("k", "v")


@query("as_of_many", f"""WITH {V}, q AS (SELECT o_orderkey AS req, concat('user:', lpad(CAST(o_custkey % 200 AS VARCHAR), 8, '0')) AS k, o_orderkey * 13 % (SELECT count(*) FROM events) AS ts FROM orders),
j AS (SELECT q.req, q.k, q.ts, v.commit_ts, v.is_delete, v.v, row_number() OVER (PARTITION BY q.req ORDER BY v.commit_ts DESC) AS rn FROM q LEFT JOIN v ON q.k = v.k AND v.commit_ts <= q.ts)
SELECT req, k, ts, CASE WHEN commit_ts IS NULL THEN 'NotFound' WHEN is_delete THEN 'Deleted' ELSE 'Found' END AS status, commit_ts, v FROM j WHERE rn = 1""")
def as_of_many(spark, d):
    n = fx.last_ts(spark, d)
    asks = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("req"), F.concat(F.lit("user:"), F.lpad((F.col("o_custkey") % 200).cast("string"), 8, "0")).alias("k"), (F.col("o_orderkey") * 13 % n).alias("ts"))
    return snapshot.as_of_many(asks, fx.version_log(spark, d), width=n // 16 + 1)


@query("lookup_status", f"""WITH {V}, c AS (SELECT DISTINCT concat('user:', lpad(CAST(c_custkey % 300 AS VARCHAR), 8, '0')) AS k FROM customer)
SELECT c.k, CASE WHEN l.k IS NULL THEN 'NotFound' WHEN is_delete THEN 'Deleted' ELSE 'Found' END AS status, l.commit_ts FROM c LEFT JOIN ({LAST}) l USING (k)""")
def lookup_status(spark, d):
    ts = _half(spark, d)
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user:"), F.lpad((F.col("c_custkey") % 300).cast("string"), 8, "0")).alias("k"))
    return snapshot.lookup_status(keys, fx.version_log(spark, d, upto=ts), ts)


@query("has_write_after", f"WITH {V} SELECT DISTINCT k FROM v, t WHERE commit_ts > half")
def has_write_after(spark, d):
    ts = _half(spark, d)
    return snapshot.has_write_after(fx.version_log(spark, d, after=ts), ts)


@query("iter_versions_topk", f"WITH {V} SELECT k, commit_ts, is_delete, v, nth FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC) AS nth FROM v) WHERE nth <= 5")
def iter_versions_topk(spark, d):
    return snapshot.iter_versions(fx.version_log(spark, d), 5).select("k", "commit_ts", "is_delete", "v", F.col("nth").cast("long").alias("nth"))


@query("overlay_read_your_writes", f"""WITH {V}, own AS (SELECT concat('user:', lpad(CAST(c_custkey % 250 AS VARCHAR), 8, '0')) AS k, bool_or(c_nationkey % 5 = 0) AS is_delete, max(round(c_acctbal, 2)) AS v FROM customer GROUP BY 1),
b AS (SELECT k, v FROM ({LAST}) WHERE NOT is_delete)
SELECT k, CASE WHEN own.k IS NOT NULL THEN own.v ELSE b.v END AS v FROM b FULL OUTER JOIN own USING (k) WHERE own.is_delete IS NULL OR NOT own.is_delete""")
def overlay_read_your_writes(spark, d):
    ts = _half(spark, d)
    c = spark.read.parquet(f"{d}/customer.parquet")
    own = c.groupBy(F.concat(F.lit("user:"), F.lpad((F.col("c_custkey") % 250).cast("string"), 8, "0")).alias("k")).agg(F.bool_or(F.col("c_nationkey") % 5 == 0).alias("is_delete"), F.max(F.round("c_acctbal", 2)).alias("v"))
    return snapshot.overlay(snapshot.snapshot(fx.version_log(spark, d, upto=ts), ts), own)


@query("version_maxima", f"WITH {V} SELECT max(commit_ts) AS max_commit_ts, max(commit_ts) + 1 AS next_ts FROM v")
def version_maxima(spark, d):
    return snapshot.maxima(fx.version_log(spark, d))


# --- J: collection, compaction
@query("latest_dedup", f"WITH {V} SELECT k, commit_ts, is_delete, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC) AS rn FROM v) WHERE rn = 1")
def latest_dedup(spark, d):
    return gc.dedup_latest(fx.version_log(spark, d))


@query("gc_keep", f"WITH {V} SELECT k, commit_ts, is_delete, v FROM (SELECT *, sum(CASE WHEN commit_ts <= w THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY commit_ts DESC ROWS UNBOUNDED PRECEDING) AS old FROM v, t) WHERE commit_ts > w OR old = 1")
def gc_keep(spark, d):
    return gc.gc_keep(fx.version_log(spark, d), _w(spark, d))


@query("gc_dropped_counts", f"WITH {V} SELECT k, count(*) AS n_versions, greatest(count(*) FILTER (WHERE commit_ts <= w) - 1, 0) AS n_dropped FROM v, t GROUP BY k")
def gc_dropped_counts(spark, d):
    return gc.gc_dropped_counts(fx.version_log(spark, d), _w(spark, d))


@query("gc_watermark", f"WITH {H} SELECT CAST(min(begin_ts) FILTER (WHERE txn % 5 = 3 AND txn > 20) AS BIGINT) AS watermark FROM txns")
def gc_watermark(spark, d):
    t = fx.history_txns(spark, d).withColumn("status", F.when((F.col("txn") % 5 == 3) & (F.col("txn") > 20), "Active").otherwise("Committed"))
    return gc.gc_watermark(t)


@query("file_overlaps", f"""WITH {FILES} SELECT a.level AS a_level, a.file_num AS a_file_num, b.level AS b_level, b.file_num AS b_file_num FROM f a, f b
WHERE (b.level = a.level AND a.file_num < b.file_num OR b.level = a.level + 1) AND a.min_key <= b.max_key AND b.min_key <= a.max_key""")
def file_overlaps(spark, d):
    return gc.file_overlaps(fx.file_set(spark, d))


@query("level_sizes", f"WITH {FILES} SELECT level, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY level")
def level_sizes(spark, d):
    return gc.level_sizes(fx.file_set(spark, d))


# --- C, D, M16: histories
def _h(spark, d):
    return fx.history_ops(spark, d), fx.history_txns(spark, d)


@query("read_set", f"WITH {H} SELECT DISTINCT txn, k FROM ops WHERE op = 'r'")
def read_set(spark, d):
    return history.read_set(_h(spark, d)[0])


@query("write_set", f"WITH {H} SELECT DISTINCT txn, k FROM ops WHERE op <> 'r'")
def write_set(spark, d):
    return history.write_set(_h(spark, d)[0])


@query("edges_ww", f"WITH {H} SELECT a.txn AS src, b.txn AS dst, k FROM w a JOIN w b USING (k) WHERE a.commit_ts < b.commit_ts")
def edges_ww(spark, d):
    return history.ww_edges(*_h(spark, d))


@query("edges_wr", f"WITH {H} SELECT a.txn AS src, b.txn AS dst, k FROM w a JOIN r b USING (k) WHERE a.txn <> b.txn AND b.begin_ts >= a.commit_ts")
def edges_wr(spark, d):
    return history.wr_edges(*_h(spark, d))


@query("edges_rw", f"WITH {H} SELECT a.txn AS src, b.txn AS dst, k FROM r a JOIN w b USING (k) WHERE a.txn <> b.txn AND a.begin_ts < b.commit_ts")
def edges_rw(spark, d):
    return history.rw_edges(*_h(spark, d))


@query("edges_rw_concurrent", f"WITH {H} SELECT src, dst FROM rw")
def edges_rw_concurrent(spark, d):
    return history.concurrent_rw(*_h(spark, d))


@query("rw_pivots", f"WITH {H} SELECT DISTINCT a.dst AS txn FROM rw a JOIN rw b ON a.dst = b.src")
def rw_pivots(spark, d):
    return history.pivots(*_h(spark, d))


@query("si_conflicts", f"WITH {H} SELECT DISTINCT a.txn FROM w a JOIN w b USING (k) WHERE b.commit_ts > a.begin_ts AND b.commit_ts < a.commit_ts")
def si_conflicts(spark, d):
    return history.si_conflicts(*_h(spark, d))


@query("last_writes", f"WITH {H} SELECT txn, k, op, op_no FROM (SELECT *, row_number() OVER (PARTITION BY txn, k ORDER BY op_no DESC) AS rn FROM ops WHERE op <> 'r') WHERE rn = 1")
def last_writes(spark, d):
    return history.last_writes(_h(spark, d)[0]).select("txn", "k", "op", "op_no")


@query("history_violations", f"WITH {H}, x AS (SELECT txn, begin_ts, CASE WHEN txn % 100 = 7 THEN begin_ts ELSE commit_ts END AS commit_ts FROM txns) SELECT txn, 'commit before begin' AS broken FROM x WHERE commit_ts <= begin_ts UNION ALL SELECT min(txn) AS txn, 'commit_ts not unique' AS broken FROM x GROUP BY commit_ts HAVING count(*) > 1")
def history_violations(spark, d):
    t = _h(spark, d)[1].withColumn("commit_ts", F.when(F.col("txn") % 100 == 7, F.col("begin_ts")).otherwise(F.col("commit_ts")))
    return history.violations(t)


# decisions one after the other; the last 16 committed transactions are all that a new one can overlap
REPLAY = f"""WITH RECURSIVE {H}, t AS (SELECT row_number() OVER (ORDER BY commit_ts) AS i, txn, begin_ts AS b, commit_ts AS c, coalesce(rs, CAST([] AS VARCHAR[])) AS rs, coalesce(ws, CAST([] AS VARCHAR[])) AS ws FROM txns
  LEFT JOIN (SELECT txn, list(DISTINCT k) AS rs FROM ops WHERE op = 'r' GROUP BY txn) USING (txn) LEFT JOIN (SELECT txn, list(DISTINCT k) AS ws FROM ops WHERE op <> 'r' GROUP BY txn) USING (txn)),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS txn, CAST([] AS STRUCT(c BIGINT, r VARCHAR[], w VARCHAR[], i BOOLEAN, o BOOLEAN)[]) AS kept, CAST(NULL AS VARCHAR) AS reason
  UNION ALL SELECT i, txn, CASE WHEN reason IS NULL THEN list_append(list_transform(kept[-15:], lambda x: struct_pack(c := x.c, r := x.r, w := x.w, i := x.i OR (x.c > b AND list_has_any(rs, x.w)), o := x.o OR (x.c > b AND list_has_any(ws, x.r)))),
    struct_pack(c := c, r := rs, w := ws, i := len(n) > 0, o := len(o) > 0)) ELSE kept END, reason
  FROM (SELECT *, CASE WHEN len(ww) > 0 THEN 'write-write' WHEN MODE AND (len(n) > 0 AND len(o) > 0 OR len(list_filter(o, lambda x: x.o)) > 0 OR len(list_filter(n, lambda x: x.i)) > 0) THEN 'serialization' END AS reason
  FROM (SELECT t.*, kept, list_filter(kept, lambda x: x.c > b AND list_has_any(rs, x.w)) AS o, list_filter(kept, lambda x: x.c > b AND list_has_any(ws, x.r)) AS n, list_filter(kept, lambda x: x.c > b AND list_has_any(ws, x.w)) AS ww FROM s JOIN t ON t.i = s.i + 1)))
SELECT 0 AS history, txn, reason IS NULL AS committed, reason FROM s WHERE i > 0"""


@query("ssi_replay", REPLAY.replace("MODE", "true"))
def ssi_replay(spark, d):
    return history.replay(*_h(spark, d), mode="ssi")


@query("si_replay", REPLAY.replace("MODE", "false"))
def si_replay(spark, d):
    return history.replay(*_h(spark, d), mode="si")


# every reader tied to the version it sees and to the next one, every version to the next; then who reaches itself
ADJACENT = """x AS (SELECT k, commit_ts AS t, 0 AS kind, txn FROM w UNION ALL SELECT k, begin_ts, 1, txn FROM r),
y AS (SELECT *, last_value(CASE WHEN kind = 0 THEN txn END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN kind = 0 THEN txn END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM x),
e AS (SELECT DISTINCT src, dst FROM (SELECT p AS src, txn AS dst FROM y UNION ALL SELECT txn, n FROM y WHERE kind = 1) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"""


@query("adjacent_edges", f"WITH {H}, {ADJACENT} SELECT src, dst FROM e")
def adjacent_edges(spark, d):
    return history.adjacent_edges(*_h(spark, d)).select("src", "dst").distinct()


@query("cycle_check", f"WITH RECURSIVE {H}, {ADJACENT}, reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src) SELECT src AS txn FROM reach WHERE src = dst")
def cycle_check(spark, d):
    """Transactions of the raw history that lie on dependency cycles."""
    ops, txns = _h(spark, d)
    return history.in_cycles(history.adjacent_edges(ops, txns), txns)


@query("edge_counts", f"WITH {H}, {ADJACENT} SELECT (SELECT count(*) FROM txns) AS n_txns, (SELECT count(*) FROM e) AS n_edges")
def edge_counts(spark, d):
    ops, txns = _h(spark, d)
    return history.graph_size(history.adjacent_edges(ops, txns), txns)


@query("abort_rate", "SELECT count(*) AS n_txns, count(*) FILTER (WHERE l_returnflag = 'R') AS n_aborted, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS abort_rate FROM lineitem")
def abort_rate(spark, d):
    return history.abort_rate(fx.bench_rows(spark, d).select((~F.col("aborted")).alias("committed")))


# --- G: log
@query("replay_log", f"WITH {LOG} SELECT wr.k, wr.txn + 1 AS commit_ts, gone AS is_delete, CASE WHEN gone THEN NULL ELSE v END AS v FROM wr JOIN be ON wr.txn = be.txn AND be.pos < wr.pos JOIN en ON wr.txn = en.txn AND en.pos > wr.pos WHERE NOT aborts")
def replay_log(spark, d):
    return recovery.replay_log(fx.typed_log(spark, d)).withColumn("v", F.col("v").cast("double"))


@query("log_maxima", f"WITH {LOG} SELECT (SELECT max(txn) + 1 FROM en WHERE NOT aborts) AS max_ts, (SELECT max(txn) FROM e) AS max_txn")
def log_maxima(spark, d):
    return recovery.log_maxima(fx.typed_log(spark, d))


@query("commits_per_fsync", f"WITH {LOG}, c AS (SELECT count(*) AS n, count(DISTINCT CAST(floor(txn / 3) AS BIGINT)) AS f FROM en WHERE NOT aborts) SELECT n AS commits, f AS fsyncs, n / f AS commits_per_fsync FROM c")
def commits_per_fsync(spark, d):
    return recovery.commits_per_fsync(fx.typed_log(spark, d))


# --- M: model and invariants
def _model(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    gone = F.col("event_type") == "error"
    ops = e.select(F.col("event_id").alias("op_no"), F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("k"), gone.alias("is_delete"), F.when(~gone, F.round("value", 2)).alias("v"))
    m = model.model_state(ops)
    user = F.expr("try_cast(substring(k, 6, 8) AS bigint)")  # filters on the renamed keys may reach this
    some = m.where(~F.col("is_delete") & (user % 7 != 2)).select(F.when(user % 13 == 5, F.concat(F.lit("ghost:"), F.col("k"))).otherwise(F.col("k")).alias("k"), F.when(user % 11 == 3, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return ops, m, some.unionByName(m.where(F.col("is_delete") & (user % 3 == 0)).select("k", F.lit(0.0).alias("v")))


@query("model_state", f"WITH {M} SELECT k, is_delete, v FROM m")
def model_state(spark, d):
    return _model(spark, d)[1]


@query("model_compare", f"""WITH {M} SELECT k, l.v AS want, a.v AS got, CASE WHEN a.k IS NULL THEN 'missing_from_actual' WHEN l.k IS NULL THEN 'unexpected_in_actual' WHEN l.v IS NOT DISTINCT FROM a.v THEN 'matching' ELSE 'mismatch' END AS verdict
FROM (SELECT * FROM m WHERE NOT is_delete) l FULL OUTER JOIN a USING (k)""")
def model_compare(spark, d):
    _, m, a = _model(spark, d)
    return model.compare(m, a)


@query("durability_violations", f"WITH {M} SELECT m.k, m.is_delete, m.v AS want, a.v AS got FROM m LEFT JOIN a ON m.k = a.k WHERE CASE WHEN m.is_delete THEN a.k IS NOT NULL ELSE a.k IS NULL OR m.v IS DISTINCT FROM a.v END")
def durability_violations(spark, d):
    _, m, a = _model(spark, d)
    return model.durability_violations(m, a)


@query("phantom_keys", f"WITH {M} SELECT DISTINCT k FROM a WHERE k NOT IN (SELECT k FROM o)")
def phantom_keys(spark, d):
    ops, _, a = _model(spark, d)
    return model.phantom_keys(a, ops, a)


@query("scan_order_violations", "SELECT scan, pos, before, k FROM (SELECT l_orderkey AS scan, pos, k, lag(k) OVER (PARTITION BY l_orderkey ORDER BY pos) AS before FROM (SELECT l_orderkey, l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber AS pos, max(l_linenumber) AS k FROM lineitem GROUP BY 1, 2)) WHERE before >= k")
def scan_order_violations(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.groupBy(F.col("l_orderkey").alias("scan"), (F.col("l_partkey") * 100_000_000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("pos")).agg(F.max("l_linenumber").alias("k"))
    return model.scan_order_violations(rows)


@query("verify_recovery", f"WITH {M} SELECT count(*) AS checked, count(*) FILTER (WHERE a.k IS NULL) AS missing, count(*) FILTER (WHERE a.k IS NOT NULL AND m.v IS DISTINCT FROM a.v) AS incorrect FROM m LEFT JOIN a ON m.k = a.k WHERE NOT m.is_delete")
def verify_recovery(spark, d):
    _, m, a = _model(spark, d)
    return model.verify_recovery(m, a)


# --- K: learned structures
@query("bloom_params", "SELECT p_partkey AS n, CAST(greatest(64, ceil(-greatest(p_partkey, 1) * ln(0.01) / (ln(2.0) * ln(2.0)))) AS BIGINT) AS m, CAST(greatest(1, least(30, round(greatest(64, ceil(-greatest(p_partkey, 1) * ln(0.01) / (ln(2.0) * ln(2.0)))) / greatest(p_partkey, 1) * ln(2.0)))) AS BIGINT) AS k FROM part")
def bloom_params(spark, d):
    m, k = learned.bloom_params(F.col("p_partkey"), F.lit(0.01))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n"), m.alias("m"), k.alias("k"))


@query("key_prefix_digest", f"WITH {V} SELECT DISTINCT k, hex(k)[1:16] AS hi, hex(k)[17:26] AS lo FROM v")
def key_prefix_digest(spark, d):
    hi, lo = digest_halves(F.col("k").cast("binary"))
    keys = fx.version_log(spark, d).select("k").distinct().select("k", hi.alias("h"), lo.alias("l"))
    shown = lambda c, n: F.substring(F.lpad(F.conv(F.col(c).cast("string"), 10, 16), 16, "0"), 1, n)
    return keys.select("k", shown("h", 16).alias("hi"), shown("l", 10).alias("lo"))


def _binary_keys(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("order:"), F.lpad((F.col("o_orderkey") * F.col("o_orderkey") % 9_999_991).cast("string"), 10, "0")).cast("binary").alias("k"))


ORDER_KEYS = "o AS (SELECT DISTINCT concat('order:', lpad(CAST(o_orderkey * o_orderkey % 9999991 AS VARCHAR), 10, '0')) AS k FROM orders)"


@query("pgm_search", f"WITH {ORDER_KEYS} SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, true AS found, true AS narrow FROM o")
def pgm_search(spark, d):
    """Every key lies in the window that the index gives, and no window is wider than the error allows."""
    placed = learned.positions(_binary_keys(spark, d), workload.cut)
    index = learned.pgm_build(placed)
    rows = learned.pgm_search(placed, index, placed.count())
    return rows.select(F.col("k").cast("string").alias("k"), "pos", ((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).alias("found"), (F.col("hi") - F.col("lo") <= 2 * learned.EPSILON + 1).alias("narrow"))


@query("bloom_probe", f"WITH {ORDER_KEYS} SELECT true AS present, count(*) AS n, true AS as_promised FROM o UNION ALL SELECT false, count(*), true FROM orders")
def bloom_probe(spark, d):
    """No present key is missed, and absent ones pass at less than twice the rate asked for."""
    keys = _binary_keys(spark, d).distinct()
    n, rate = keys.count(), 0.01
    bloom = learned.bloom_build(keys, n, rate)
    absent = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("absent:"), F.col("o_orderkey").cast("string")).cast("binary").alias("k"), F.lit(False).alias("present"))
    rows = learned.bloom_probe(keys.withColumn("present", F.lit(True)).unionByName(absent), bloom, n, rate)
    hits = F.count_if("may_contain")
    return rows.groupBy("present").agg(F.count(F.lit(1)).alias("n"), F.when(F.col("present"), hits == F.count(F.lit(1))).otherwise(hits < 2 * rate * F.count(F.lit(1)) + 5).alias("as_promised"))


# --- O: benchmarks
LAT = "b AS (SELECT CAST(l_orderkey % 4 AS INTEGER) AS run_id, CAST(l_suppkey % 16 AS INTEGER) AS worker, l_linestatus AS op, greatest(1, least(60000000, CAST(floor(l_extendedprice) AS BIGINT))) AS x, l_returnflag = 'R' AS aborted FROM lineitem)"


@query("latency_percentiles", f"WITH {LAT} SELECT op, count(*) AS n, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.9) AS p90, quantile_disc(x, 0.99) AS p99, quantile_disc(x, 0.999) AS p999, max(x) AS max, round(avg(x), 4) AS mean FROM b GROUP BY op")
def latency_percentiles(spark, d):
    return metrics.latency_percentiles(fx.bench_rows(spark, d), ["op"])


@query("multi_run_medians", f"WITH {LAT}, r AS (SELECT op, run_id, count(*) AS ops, count(*) FILTER (WHERE aborted) AS aborts FROM b GROUP BY op, run_id) SELECT op, count(*) AS n_runs, list_sort(list(ops))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_ops, list_sort(list(aborts))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_aborts FROM r GROUP BY op")
def multi_run_medians(spark, d):
    runs = fx.bench_rows(spark, d).groupBy("op", "run_id").agg(F.count(F.lit(1)).alias("ops"), F.count_if("aborted").alias("aborts"))
    return metrics.multi_run_medians(runs, ["op"], ["ops", "aborts"])


@query("write_amp", "WITH x AS (SELECT p_brand AS label, CASE WHEN p_brand LIKE '%1' THEN NULL ELSE CAST(p_size AS BIGINT) * 100 END AS physical, CASE WHEN p_brand LIKE '%2' THEN 0 ELSE CAST(floor(p_retailprice) AS BIGINT) END AS logical FROM part) SELECT label, CAST(sum(physical) AS BIGINT) AS physical, CAST(sum(logical) AS BIGINT) AS logical, CASE WHEN sum(physical) IS NULL THEN NULL WHEN sum(logical) = 0 THEN 1.0 ELSE sum(physical) / sum(logical) END AS amplification FROM x GROUP BY label")
def write_amp(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    rows = p.select(F.col("p_brand").alias("label"), F.when(~F.col("p_brand").endswith("1"), F.col("p_size").cast("long") * 100).alias("physical"), F.when(F.col("p_brand").endswith("2"), F.lit(0)).otherwise(F.floor("p_retailprice")).cast("long").alias("logical"))
    return metrics.amplification(rows)


@query("failure_counts", "SELECT event_type AS kind, CAST(user_id % 12 AS BIGINT) AS scenario, count(*) AS n FROM events GROUP BY 1, 2")
def failure_counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("kind"), (F.col("user_id") % 12).alias("scenario"))
    return metrics.failure_counts(e, ["kind", "scenario"])


@query("tpcc_order_totals", "SELECT l_orderkey AS order_id, count(*) AS n_items, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(trunc(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def tpcc_order_totals(spark, d):
    return workload.order_totals(*_tpcc(spark, d))


def _tpcc(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("long").alias("quantity"))
    items = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_id"), (F.col("p_retailprice") * 100).cast("long").alias("price"))
    return lines, items


@query("tpcc_stock_invariant", "SELECT l_partkey AS item_id, 10000 - CAST(sum(l_quantity) AS BIGINT) AS stock, CAST(sum(l_quantity) AS BIGINT) AS ordered, true AS holds FROM lineitem GROUP BY l_partkey")
def tpcc_stock_invariant(spark, d):
    lines, items = _tpcc(spark, d)
    stock = workload.apply_orders(items.select("item_id", F.lit(10_000).cast("long").alias("stock")), lines)
    return workload.stock_invariant(stock, lines, 10_000)


@query("ycsb_ops")
def ycsb_ops(spark, d):
    return workload.ycsb_ops(spark, "A", spark.read.parquet(f"{d}/orders.parquet").count())


@query("txn_stress")
def txn_stress(spark, d):
    return stress.stress(*stress.stress_history(spark, 100))


@query("failure_search")
def failure_search(spark, d):
    return simulation.stats(simulation.run_all(spark, range(20), list(simulation.SCENARIOS.values())))


@query("monotonic_violations", f"WITH {V} SELECT k, commit_ts FROM (SELECT k, commit_ts - commit_ts % 500 AS commit_ts FROM v) GROUP BY k, commit_ts HAVING count(*) > 1")
def monotonic_violations(spark, d):
    v = fx.version_log(spark, d).withColumn("commit_ts", F.col("commit_ts") - F.col("commit_ts") % 500)
    return snapshot.monotonic_violations(v)


@query("dangerous_structures", f"WITH {H} SELECT DISTINCT p.dst AS txn FROM rw p JOIN rw q ON p.dst = q.src WHERE p.src <> q.dst")
def dangerous_structures(spark, d):
    return history.dangerous(*_h(spark, d))


# --- A to J: the store itself, on a folder of its own
WRITES = """e AS (SELECT event_id, CAST(floor(event_id / 64) AS BIGINT) AS txn, concat('user:', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS k, event_type = 'error' AS is_delete, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS v FROM events),
c AS (SELECT k, 2 * dense_rank() OVER (ORDER BY txn) AS commit_ts, is_delete, v, event_id, row_number() OVER (PARTITION BY txn, k ORDER BY event_id DESC) AS rn FROM e),
s AS (SELECT k, commit_ts, is_delete, v FROM c WHERE rn = 1)"""


def _written(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    gone = F.col("event_type") == "error"
    return e.select("event_id", F.floor(F.col("event_id") / 64).alias("txn"), F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("k"), gone.alias("is_delete"), F.when(~gone, F.col("event_id").cast("string")).alias("v"))


def _shown(versions):
    return versions.select(F.col("k").cast("string").alias("k"), "commit_ts", "is_delete", F.col("v").cast("string").alias("v"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one value, in Arrow's stream format."""
    for b in batches:
        with pa.ipc.new_stream(out := pa.BufferOutputStream(), b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch"])


def _stream(df: DataFrame) -> Iterator[tuple]:
    """The rows in order, as tuples. They come by Arrow, a partition at a time, and the next one meanwhile; rows of Spark cost several times that."""
    for r in df.mapInArrow(_packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        yield from zip(*(c.to_pylist() for c in pa.ipc.open_stream(r.batch).read_all().columns), strict=True)


def _run_commits(spark, d, path, flush_every=0):
    """Every 64 events as a transaction of a store, one after the other, from a sorted stream of the table; they share log files."""
    rows = _written(spark, d).orderBy("event_id").select("txn", F.col("k").cast("binary"), "is_delete", F.col("v").cast("binary"))
    with Db.open(spark, path) as db, db.group():
        for n, (_, group) in enumerate(groupby(_stream(rows), key=itemgetter(0))):
            with db.begin() as t:
                for _, k, gone, v in group:
                    t.delete(k) if gone else t.put(k, v)
                t.commit()
            if flush_every and n % flush_every == flush_every - 1:
                db.flush(wait=False)


@query("store_commits", f"WITH {WRITES} SELECT * FROM s")
def store_commits(spark, d):
    """What a store holds that was closed without a flush and recovered from its log."""
    path = workload.scratch(spark)
    _run_commits(spark, d, path)
    with Db.open(spark, path) as db:
        return _shown(db.versions())


@query("store_flushed", f"WITH {WRITES} SELECT * FROM s")
def store_flushed(spark, d):
    """The same from parts and log together: a flush after every 50 commits."""
    path = workload.scratch(spark)
    _run_commits(spark, d, path, 50)
    with Db.open(spark, path) as db:
        return _shown(db.versions())


@query("store_compacted", f"WITH {WRITES} SELECT k, commit_ts, is_delete, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC) AS rn FROM s) WHERE rn = 1")
def store_compacted(spark, d):
    """What a full compaction leaves at the newest watermark: the last version of each key."""
    path = workload.scratch(spark)
    _run_commits(spark, d, path, 50)
    with Db.open(spark, path) as db:
        db.compact_all()
        db.vacuum()
        return _shown(db.versions())


@query("store_snapshot", f"WITH {V} SELECT k, v FROM (SELECT k, CAST(CAST(floor(v * 100) AS BIGINT) AS VARCHAR) AS v, is_delete FROM ({LAST})) WHERE NOT is_delete AND k >= 'user:00000010' AND k < 'user:00000200' AND k <> 'user:00000011' UNION ALL SELECT 'user:00000010~', 'own'")
def store_snapshot(spark, d):
    """A scan in a transaction with writes of its own, over a bulk load of versions up to the middle of the log."""
    ts = _half(spark, d)
    with Db.open(spark, workload.scratch(spark)) as db:
        db.load(fx.version_log(spark, d, upto=ts).withColumn("v", F.floor(F.col("v") * 100).cast("string")))
        t = db.begin()
        t.put(b"user:00000010~", b"own")
        t.delete(b"user:00000011")
        rows = t.scan_df(b"user:00000010", b"user:00000200")
        t.rollback()
        return rows.select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query("pick_compaction", f"WITH {FILES}, z AS (SELECT min(min_key) AS lo, max(max_key) AS hi FROM f WHERE level = 0) SELECT file_num, 'input' AS role, 1 AS target FROM f WHERE level = 0 UNION ALL SELECT file_num, 'overlap', 1 FROM f, z WHERE level = 1 AND min_key <= hi AND max_key >= lo")
def pick_compaction(spark, d):
    task = gc.pick_compaction(fx.file_set(spark, d))
    rows = [(n, role, task["target"]) for role, c in (("input", "inputs"), ("overlap", "overlaps")) for n in task[c]]
    return spark.createDataFrame(rows, "file_num long, role string, target int")


# --- M: more of the model
@query("model_counts", f"WITH {M} SELECT count(*) FILTER (WHERE NOT is_delete) AS live_keys, count(*) AS all_keys FROM m")
def model_counts(spark, d):
    return model.counts(_model(spark, d)[1])


@query("model_summary", f"""WITH {M}, c AS (SELECT CASE WHEN a.k IS NULL THEN 'missing' WHEN l.k IS NULL THEN 'unexpected' WHEN l.v IS NOT DISTINCT FROM a.v THEN 'matching' ELSE 'mismatch' END AS verdict FROM (SELECT * FROM m WHERE NOT is_delete) l FULL OUTER JOIN a USING (k))
SELECT count(*) FILTER (WHERE verdict = 'matching') AS matching, count(*) FILTER (WHERE verdict IN ('mismatch', 'unexpected')) AS mismatches, count(*) FILTER (WHERE verdict = 'missing') AS missing_from_actual, count(*) FILTER (WHERE verdict = 'unexpected') AS unexpected_in_actual FROM c""")
def model_summary(spark, d):
    _, m, a = _model(spark, d)
    return model.compare_summary(model.compare(m, a))


RYW = """g AS (SELECT event_id AS op_no, concat('user:', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS k, CASE WHEN event_type IN ('view', 'click') THEN 'get' WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, round(value, 2) AS v FROM events),
h AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN op END IGNORE NULLS) OVER w AS last_op, last_value(CASE WHEN op = 'put' THEN v WHEN op = 'delete' THEN -1 END IGNORE NULLS) OVER w AS last_v FROM g WINDOW w AS (PARTITION BY k ORDER BY op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("read_your_writes_violations", f"WITH {RYW}, z AS (SELECT op_no, k, CASE WHEN last_op = 'put' THEN last_v END AS want, CASE WHEN op_no % 3 <> 0 THEN CASE WHEN last_op = 'put' THEN last_v END ELSE v END AS got FROM h WHERE op = 'get') SELECT * FROM z WHERE want IS DISTINCT FROM got")
def read_your_writes_violations(spark, d):
    """Two thirds of the gets return what was written last, the others their own event's value."""
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_type").isin("view", "click"), "get").when(F.col("event_type") == "error", "delete").otherwise("put")
    g = e.select(F.col("event_id").alias("op_no"), F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("k"), op.alias("op"), F.round("value", 2).alias("v"))
    told = model.read_your_writes_violations(g.withColumn("v", F.when(F.col("op") != "get", F.col("v")).otherwise(-2.0))).select("op_no", "want")
    g = g.join(told, "op_no", "left").withColumn("v", F.when((F.col("op") == "get") & (F.col("op_no") % 3 != 0), F.col("want")).otherwise(F.col("v"))).drop("want")
    return model.read_your_writes_violations(g)


@query("scan_differences", f"WITH {M}, x AS (SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM m WHERE NOT is_delete), y AS (SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM a) SELECT coalesce(x.pos, y.pos) AS pos, x.k AS want_k, x.v AS want_v, y.k AS got_k, y.v AS got_v FROM x FULL OUTER JOIN y ON x.pos = y.pos WHERE x.pos IS NULL OR y.pos IS NULL OR x.k <> y.k OR x.v IS DISTINCT FROM y.v")
def scan_differences(spark, d):
    _, m, a = _model(spark, d)
    def numbered(df):
        place = learned.positions(df.select(F.col("k").cast("binary").alias("k")), workload.cut).select(F.col("k").cast("string").alias("k"), (F.col("pos") + 1).alias("pos"))
        return df.join(place, "k").select("pos", "k", "v")

    out = model.scan_differences(numbered(m.where("not is_delete")), numbered(a))
    return out.select("pos", F.col("want.k").alias("want_k"), F.col("want.v").alias("want_v"), F.col("got.k").alias("got_k"), F.col("got.v").alias("got_v"))


@query("invariant_report", f"""WITH {M}, x AS (SELECT 'durability' AS "check", count(*) AS violations FROM m LEFT JOIN a ON m.k = a.k WHERE CASE WHEN m.is_delete THEN a.k IS NOT NULL ELSE a.k IS NULL OR m.v IS DISTINCT FROM a.v END
UNION ALL SELECT 'phantoms', count(DISTINCT k) FROM a WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'itself', 0) SELECT "check", violations, violations = 0 AS passed FROM x""")
def invariant_report(spark, d):
    ops, m, a = _model(spark, d)
    return model.report({"durability": model.durability_violations(m, a), "phantoms": model.phantom_keys(a, ops, a), "itself": model.durability_violations(m, m.where("not is_delete").select("k", "v"))})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
