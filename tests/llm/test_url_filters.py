import re

from palimpsest.llm.url_filters import RULES, site_url, url_verdicts
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, host string, rule string"


def rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def brute(pages, edges):
    """(page, host, path, rule, verdict) with aliases by union-find over plain normalised URLs."""
    def site(u):
        if not u or "://" not in u:
            return u
        host, path, *_ = rule(u)
        q = re.match(r"(?s)[^?#]*(\?[^#]*)?", u)[1] or ""
        return "https://" + re.sub(r"^(www|m)\.", "", host) + (path or "/") + q

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(site(a))] = find(site(b))
    says = {}
    for u in [u for _, u in pages if u] + [x for e in edges for x in map(site, e)]:
        if v := rule(u)[3]:
            says.setdefault(find(site(u)), set()).add(v)
    out = []
    for k, u in pages:
        host, path, r, v = rule(u)
        passed = says.get(find(site(u)), set()) if u is not None else set()
        out.append((k, host, path, r, v or ("allow" if "allow" in passed or not passed else "block")))
    return sorted(out, key=str)


def test_like_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages).collect()), key=str)
    assert got == brute([(r.page_id, r.url) for r in pages.collect()], [])


def test_aliases(spark):
    html = lambda href: f"<html><head><LINK href='{href}' rel=canonical></head>"
    urls = {
        1: ("http://www.Shop.example.net/x#top", html("https://a.com/de/bad")),  # alias of a blocked URL
        2: ("https://shop.example.net/x", None),  # the same site URL
        3: ("https://a.com/de/bad", ""),
        4: ("https://b.net/1", "<meta http-equiv=\"refresh\" content=\"0; url=/2\">"),
        5: ("https://b.net/2", html("https://c.org/fine")),  # allow wins over the block of 6
        6: ("https://b.net/3", html("https://b.net/2")),
        7: ("https://d.net/", html("https://a.com/en/1")),  # no rule anywhere
        8: ("https://c.com/de/3", html("https://b.net/3")),  # explicit block stays
        9: (None, html("https://a.com/de/bad")), 10: ("", None), 11: ("nothing", None), 12: ("https://ORG", None), 13: ("https://example.org/en/17?x=://y", ""),
        14: ("ftp://e.net/%s" % ("z" * 5000), "<link rel=canonical>" + "y" * 100_000),
    }
    pages = spark.createDataFrame([(k, *v, "clash", "clash") for k, v in urls.items()] * 2 + [(None, None, None, None, None)], SCHEMA)
    edges = [(urls[1][0], urls[3][0]), (urls[4][0], "https://b.net/2"), (urls[5][0], "https://c.org/fine"), (urls[6][0], urls[5][0]), (urls[7][0], "https://a.com/en/1"), (urls[8][0], urls[6][0])]
    rows = [(r.page_id, r.url) for r in pages.collect()]
    got = url_verdicts(pages).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == brute(rows, edges)
    by = {r.page_id: (r.verdict, r.source) for r in got}
    assert by[1] == by[2] == ("block", "alias") and by[4] == by[6] == ("allow", "alias") and by[7] == ("allow", "default") and by[8] == ("block", "rule")
    more = spark.createDataFrame([("https://d.net/", "http://z.com/de/1"), (None, "x")], "a string, b string")
    by = {r.page_id: r.verdict for r in url_verdicts(pages, redirects=more).collect()}
    assert by[7] == "block"
    assert url_verdicts(pages.limit(0)).count() == 0


def test_site_urls(spark):
    df = spark.createDataFrame([("HTTP://WWW.A.b?q=1#f",), ("x",), (None,)], "u string").select(site_url(F.col("u")).alias("s"))
    assert [r.s for r in df.collect()] == ["https://a.b/?q=1", "x", None]
