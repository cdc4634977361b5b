import corpus_pipeline

from .test_decontaminate import brute as leaks
from .test_near_dedup import brute as groups
from .test_packing import hold
from .test_quality import brute as quality
from palimpsest.llm.secret_scan import redact


def test_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {d: t for d, t in rows.items() if not quality(t)[5]}  # no host is bad here
    alone = {c for *_, c in groups(list(rows.items()), 5)}
    rows = {d: t for d, t in rows.items() if d in alone}
    bad = {d for d, _ in leaks([(d, t) for d, t in rows.items() if len(t) < 20_000], items)}
    rows = {d: redact(t.encode()).decode() for d, t in rows.items() if d not in bad}
    assert 0 < len(bad) < len(rows) < docs.count()
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns, name
    assert {r.doc_id: r.text for r in left.collect()} == rows
    hold(left, corpus_pipeline.run(spark, sf).collect(), 1024)


def test_odd_tables(spark, sf, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf)
            assert df.columns == odd.columns
            df.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
