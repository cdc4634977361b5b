import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.encodings import LAYOUTS, decode, digest_halves, digest_u128, encode, format_bytes, format_value, internal_key, parse_bytes, signed_le, split_internal_key
from palimpsest.functions.hashing import fnv1a_u64, xorshift
from palimpsest.plans import workload


@pytest.mark.parametrize("kind", "ABCDEF")
def test_mixes(spark, kind):
    ops = workload.ycsb_ops(spark, kind, 20_000, workload.YcsbConfig(records=1000))
    got = {r.op: r["count"] / 20_000 for r in ops.groupBy("op").count().collect()}
    assert got.keys() == workload.YCSB[kind].keys() and all(abs(got[k] - v) < 0.02 for k, v in workload.YCSB[kind].items())
    assert ops.exceptAll(workload.ycsb_ops(spark, kind, 20_000, workload.YcsbConfig(records=1000))).isEmpty()
    if kind in "DE":
        ins = sorted(r.record for r in ops.where("op = 'insert'").collect())
        assert ins == list(range(1000, 1000 + len(ins)))
    if kind == "E":
        assert ops.agg(F.min("scan_len"), F.max("scan_len")).first() == (1, 200)
    if kind == "A":
        top = ops.groupBy("k").count().orderBy(F.desc("count")).first()
        assert top["count"] > 1500 and len(top.k) == 16


def test_load_and_scan_requests(spark):
    load = workload.ycsb_load(spark, workload.YcsbConfig(records=50))
    rows = sorted((r.k, r.v) for r in load.collect())
    assert rows[7][0] == "user000000000007" and {len(v) for _, v in rows} == {100}
    asks = [(1, "user000000000045", 10), (2, "", 2), (3, "zzz", 4), (4, "user0000000000105", 3)]
    got = workload.scan_requests(spark.createDataFrame(asks, "req int, start string, len int"), load).collect()
    for req, start, n in asks:
        assert sorted((r.k, r.v) for r in got if r.req == req) == [x for x in rows if x[0] >= start][:n]


def test_orders(spark):
    t = workload.tpcc_load(spark, 2, 10)
    assert sum(df.count() for df in t.values()) == 32
    lines = workload.new_orders(spark, 200, 2, 10).cache()
    per = lines.groupBy("order_id").count().agg(F.min("count"), F.max("count")).first()
    assert per == (5, 10)
    assert lines.groupBy("order_id", "item_id").count().where("count > 1").count() > 0
    stock = workload.apply_orders(t["stock"], lines)
    sold = t["stock"].agg(F.sum("stock")).first()[0] - stock.agg(F.sum("stock")).first()[0]
    assert sold == lines.agg(F.sum("quantity")).first()[0]
    totals = workload.order_totals(lines, t["item"]).agg(F.sum("total")).first()[0]
    assert totals == lines.join(t["item"], "item_id").agg(F.sum(F.col("price") * F.col("quantity"))).first()[0]


def test_sim_ops(spark):
    ops = workload.sim_ops(spark, 5000, 1)
    n = {r.op: r["count"] for r in ops.groupBy("op").count().collect()}
    assert abs(n["put"] - 2000) < 200 and abs(n["delete"] - 500) < 100 and n["flush"] + n["compact"] < 600
    batches = workload.operation_batches(ops, 50).collect()
    assert sum(len(r.ops) for r in batches) == n["put"] + n["delete"] and all(x.op_no // 50 == r.batch for r in batches for x in r.ops)
    assert all([x.op_no for x in r.ops] == sorted(x.op_no for x in r.ops) for r in batches)


def test_bytes(spark):
    assert parse_bytes("0x00ff") == b"\0\xff" and parse_bytes("hé") == "hé".encode()
    assert format_bytes(b"a b") == "a b" and format_bytes(b"\xff\0") == "0xff00" and format_bytes(b"a\n") == "0x610a"
    values = [b"a b", b"\xff\x00", b"a\n", "é".encode(), b"", b"0" * 30, bytes(range(200, 230))]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "b binary")
    assert [r.s for r in df.select(format_value(F.col("b")).alias("s")).collect()] == [format_bytes(v) for v in values]
    for r, v in zip(df.select(*digest_halves(F.col("b"))).collect(), values, strict=True):
        assert (int(r[0]) << 64) + int(r[1]) == digest_u128(v)
    pairs = [(k, s) for k in (b"foo", b"zoo") for s in (9, 5, 1)]
    assert sorted(internal_key(*p) for p in pairs) == [internal_key(*p) for p in pairs] and split_internal_key(internal_key(b"foop", 3)) == (b"foop", 3)
    for kind, (_, names) in LAYOUTS.items():
        fields = {n: 7 + i for i, n in enumerate(names)}
        assert decode(kind, encode(kind, **fields)) == fields
    raw = [encode("warehouse", balance=x) for x in (0, -5, 1 << 40, -(1 << 60))]
    df = spark.createDataFrame([(bytearray(x),) for x in raw], "b binary").select(signed_le(F.col("b"), 1, 8).alias("x"))
    assert [r.x for r in df.collect()] == [0, -5, 1 << 40, -(1 << 60)]
    df = spark.createDataFrame([(bytearray(encode("stock", quantity=-3)),)], "b binary").select(signed_le(F.col("b"), 1, 4).alias("x"))
    assert df.first().x == -3


def test_hashes():
    h = 0xCBF29CE484222325
    for b in (77).to_bytes(8, "little"):
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert int(fnv1a_u64(np.array([77]))[0]) == h
    x = xorshift(1)
    assert next(x) == 1082269761 and next(xorshift(0)) == 1082269761


def test_nothing_here_uses_time_or_chance():
    root = Path(workload.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(import (random|time)\b|from (random|time) import)|\bF\.rand\w*\(", p.read_text(), re.M), p
