"""The SQL of this subpackage against its queries, on the smallest tables and on pages with links."""

import duckdb
import pytest

from palimpsest.llm import queries, sql
from palimpsest.llm.quality import quality_rules
from palimpsest.llm.url_filters import url_verdicts

TABLES = ("documents", "pages", "benchmark")


def shown(df):
    one = lambda x: "-" if x is None or str(x) in ("<NA>", "nan") else str(x)
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert shown(queries.queries()[name](spark, sf).toPandas()) == shown(con.execute(queries.oracle_sql()[name]).fetchdf())


def test_url_sql_with_links(spark):
    link = lambda href: f"<html><head><link rel='canonical' href='{href}'></head>"
    rows = [
        (1, "http://www.Shop.example.net/x#top", link("https://a.com/de/bad")), (2, "https://shop.example.net/x", None), (3, "https://a.com/de/bad", ""),
        (4, "https://b.net/d/1", '<meta http-equiv="refresh" content="0; url=/2">'), (5, "https://b.net/2", link("https://c.org/fine")), (6, "https://b.net/3", link("2")),
        (7, "https://d.net/", link("//a.com/en/1")), (8, "https://c.com/de/3", link("https://b.net/3")), (9, None, link("https://a.com/de/bad")), (10, "", None), (11, "nothing", ""),
        (12, "http://a.com/de", None), (13, "https://a.com/de/", None), (14, "https://e.net/two", link("") + link("/none") + link("https://x.org/second") + '<meta http-equiv=refresh content="5;url=https://e.net/three">'), (15, "https://e.net/three#x", None),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = shown(url_verdicts(pages).toPandas())
    assert got == shown(con.execute(sql.OP4).fetchdf())
    assert sum("alias" in r for r in got) >= 8
    by = {r.page_id: r for r in url_verdicts(pages).collect()}
    assert by[12].verdict == "block" and by[12].source == "alias" and by[12].component == by[13].component
    assert by[14].verdict == by[15].verdict == "allow" and by[15].source == "alias" and by[14].component == by[15].component


def test_quality_sql_with_a_bad_host(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "# < spam"
    rows = [(i, bad if host == "bad" and i % 25 or i % 9 == 0 else good, host) for i, host in enumerate(["bad"] * 100 + ["fine"] * 150 + ["tiny"] * 2 + ["a", "b", None, None])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = con.execute(sql.OP9).fetchdf()
    got = quality_rules(table).select(*want.columns).toPandas()
    assert shown(got) == shown(want)
    assert set(want[want.host_rejected].host) == {"bad"} and (want[want.host == "bad"].kept == False).all()  # noqa: E712
    tiny = want[want.host == "tiny"].iloc[0]
    assert 0 < tiny.rate_short < 1  # shrunk: none or half of two documents failed
