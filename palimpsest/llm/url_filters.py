"""URL filters with redirect equivalence.

Rules allow or block hosts and path prefixes. A page without a rule takes the
verdict of the pages it is an alias of: redirects (given edges, all meta refresh
tags of a page, and those that sites do by convention: https, no ``www.`` or
``m.``, no slash at the end, no fragment) and all canonical links of a page are
edges between URLs, and connected components of those edges pass decisions on.
An explicit allow comes before a block. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise
from .components import connected_components

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Letters whose case doesn't matter in hosts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?is)<link\b(?=[^>]*?\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*'?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or none: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Longest: by characters of host and path together, then of the host.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def site_url(url: Column) -> Column:
    """Where the redirects that sites do by convention lead: https, host in lower case without ``www.`` or ``m.``, no slashes at the end of the path but for ``/`` alone, query kept, no fragment."""
    host, bare = F.regexp_replace(host_of(url), r"^(?:www|m)\.", ""), F.regexp_replace(path_of(url), "/+$", "")
    path = F.when(bare == "", "/").otherwise(bare)
    return F.when(F.locate("://", url) > 0, F.concat(F.lit("https://"), host, path, F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1))).otherwise(url)


def absolute(target: Column, base: Column) -> Column:
    """A link target against the page's own URL."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(F.locate("://", target) > 0, target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): each page's URL and the targets of all its canonical links and meta refreshes."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    head, none = F.lower(html), F.array().cast("array<string>")
    links = F.when(F.contains(head, F.lit("canonical")), F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).otherwise(none)
    jumps = F.when(F.contains(head, F.lit("refresh")), F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1))).otherwise(none)
    each = pages.where(url.isNotNull()).select(url.alias("a"), F.explode(F.concat(links, jumps)).alias("target")).where("target <> ''")
    return each.select("a", absolute(F.replace("target", F.lit("&amp;"), F.lit("&")), F.col("a")).alias("b"))


def url_edges(urls: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): ``links``, and an edge from each of ``urls`` and of the ends of ``links`` to where its site's conventions lead."""
    ends = urls.toDF("a").unionByName(links.select(F.explode(F.array("a", "b")).alias("a"))).where("a is not null")
    return links.unionByName(ends.select("a", site_url(F.col("a")).alias("b"))).where("a <> b").distinct()


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, rules=RULES, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``source`` (rule, alias or default) and ``component`` of each row of ``pages``.

    Edges come from the conventions of sites (every URL), from the canonical and
    refresh tags of ``html_col`` and from ``redirects``, (from, to) URLs besides.
    The synthetic ``pages`` table has no such tags, so its edges are all by
    convention. ``component`` is the smallest URL that edges reach. A page with a
    rule has the rule's verdict. Others take that of their component: allow if a
    member (a page or a URL that is linked to) has an explicit allow, else block
    if one has a block, else ``default``. Null or odd URLs have an empty host and
    path and the default; a null URL has no component. Repeated rows give
    repeated rows, an empty table an empty one.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    links = page_links(pages, url_col=url_col, html_col=html_col) if html_col else None
    if redirects is not None:
        given = redirects.toDF("a", "b").where("a is not null and b is not null")
        links = given if links is None else links.unionByName(given)
    links = pages.sparkSession.createDataFrame([], "a string, b string") if links is None else links
    parts = materialise(connected_components(url_edges(pages.select(url), links)), "aliases")
    told = parts.withColumn("own", rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)).where("own is not null")
    says = lambda v: F.max((F.col("own.verdict") == v).cast("int")).alias(v)
    known = parts.join(told.groupBy("component").agg(says("allow"), says("block")), "component", "left")
    known = known.select(F.col("node"), "component", F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").alias("passed"))
    rows = judged.join(known, F.col("url") == F.col("node"), "left")
    return rows.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "passed", F.lit(default)).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("passed").isNotNull(), "alias").otherwise("default").alias("source"), F.coalesce("component", "url").alias("component"),
    )
