"""The entry module: every query with SQL agrees with DuckDB on the smallest tables, and the module works without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from palimpsest import queries

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def shown(df):
    def one(x):
        if x is None or str(x) in ("<NA>", "nan", "NaT"):
            return "-"
        return f"{float(x):.6g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_duckdb(spark, con, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_without_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0


def test_fixture_counts(spark):
    assert queries.queries()["snapshot_all"](spark, SF).agg({"v": "sum"}).first()[0] == pytest.approx(241.59)
    assert queries.queries()["gc_keep"](spark, SF).count() == 315


def test_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not [n for n in e.queries() if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, check=True)
