import itertools
import zlib

import numpy as np

import pytest

from palimpsest.llm.hilbert import hilbert_index
from palimpsest.llm.sharding import hilbert_shards, write_shards


def test_curve_visits_each_cell_and_steps_by_one():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        key = hilbert_index(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_counts_slots_and_sizes(spark, sf, odd, empty):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd, odd.limit(3), empty):
        rows = hilbert_shards(docs).collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
        slots = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
        assert all(x == list(range(len(x))) for x in slots) and sum(map(len, slots)) == len(rows)
        assert max(map(len, slots)) - min(map(len, slots)) <= 1
        order = [r.curve_key for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)


def test_a_third_in_one_cell_is_cut(spark):
    rows = [(i, "x" * 9, "en", "hot") for i in range(300)] + [(300 + i, "y" * i, "fr", f"s{i % 9}") for i in range(600)]
    got = hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [112] * 4 + [113] * 4


def test_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == set(range(8))


def test_shards_keep_the_columns_and_refuse_repeated_ids(spark, odd, tmp_path):
    with pytest.raises(ValueError):
        write_shards(odd, str(tmp_path / "no"))
    docs = odd.where("doc_id is not null and doc_id <> 3").withColumnRenamed("n", "SLOT")
    write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "_shard", "_slot"}
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_repeated_rows_fill_no_range_alone(spark):
    docs = spark.range(4000).selectExpr("7L doc_id", "'same' text", "'en' lang", "'a' source")
    rows = hilbert_shards(docs)
    assert rows.groupBy("shard").count().where("count <> 500").isEmpty()
    ranges = rows.rdd.glom().map(len).collect()
    assert max(ranges) < 4000


def test_filters_read_a_part_of_the_files(spark):
    """What a filter on one value of each dimension reads of 64 files, by their statistics; in order of ids it would be nearly all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hilbert_shards(docs, n_shards=64).join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    share = {c: rows.groupby("shard")[c].nunique().sum() / (64 * rows[c].nunique()) for c in ("lang", "source")}
    size = rows.groupby("shard")["size"].agg(["min", "max"])
    share["size"] = ((size["min"] <= rows["size"].median()) & (size["max"] >= rows["size"].median())).mean()
    assert share["lang"] < 0.7 and share["source"] < 0.5 and share["size"] < 0.7, share
