"""SQL for those queries of this subpackage that SQL can express; the rest is tested against brute force in tests/llm."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
pos AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
win AS (SELECT r, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g FROM pos),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
f AS (SELECT d.r, doc_id, host, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep ON d.r = rep.r),
g AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
k AS (SELECT host, rule, count(*) AS n, sum(failed) AS k FROM (SELECT host, unnest([0, 1, 2, 3, 4]) AS rule, unnest([
  CAST(n_words < 50 AS INTEGER), CAST(100 * n_repeat_words > 50 * n_words AS INTEGER), CAST(10 * n_symbols > word_chars AS INTEGER), CAST(10 * n_dup_lines > 3 * n_lines AS INTEGER),
  CAST(n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) AS INTEGER)]) AS failed FROM g WHERE host IS NOT NULL) GROUP BY host, rule),
m AS (SELECT rule, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS q, count(*) / sum(n) AS h FROM k GROUP BY rule),
s AS (SELECT rule, m, q - m * m - m * (1 - m) * h AS spread FROM m),
p AS (SELECT rule, m, CASE WHEN spread > 0 THEN greatest(2.0, least(10000.0, m * (1 - m) / spread - 1)) ELSE 10000.0 END AS strength FROM s),
r AS (SELECT host, k.rule AS rule, (k + m * strength) / (n + strength) AS rate FROM k JOIN p ON k.rule = p.rule),
v AS (SELECT host, max(rate) > 0.75 AS rejected, round(max(rate) FILTER (rule = 0), 9) AS rate_short, round(max(rate) FILTER (rule = 1), 9) AS rate_repetitive, round(max(rate) FILTER (rule = 2), 9) AS rate_symbols,
  round(max(rate) FILTER (rule = 3), 9) AS rate_dup_lines, round(max(rate) FILTER (rule = 4), 9) AS rate_word_length FROM r GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, g.host, coalesce(rejected, false) AS host_rejected, NOT base_failed AND NOT coalesce(rejected, false) AS kept,
  rate_short, rate_repetitive, rate_symbols, rate_dup_lines, rate_word_length
FROM g LEFT JOIN v ON g.host = v.host
"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
o AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM e)),
p AS (SELECT doc_id, n, x FROM o WHERE rn <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM (SELECT a, b, len(x.s) AS n, len(y.s) AS m, len(list_intersect(x.s, y.s)) AS i FROM c JOIN s x ON c.a = x.doc_id JOIN s y ON c.b = y.doc_id) WHERE 100 * i >= 80 * (n + m - i)),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, t.b FROM reach r JOIN both_ t ON r.b = t.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, k.component_id, s.doc_id = k.component_id AS kept FROM s JOIN k ON s.doc_id = k.doc_id
"""

OP10 = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS h FROM documents),
b0 AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS h FROM benchmark),
b AS (SELECT h, min(item_id) AS item_id, count(*) AS n_items FROM b0 WHERE len(h) > 0 GROUP BY h),
ti AS (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM t),
bi AS (SELECT item_id, h, unnest(range(1, len(h) + 1)) AS i FROM b),
ts AS (SELECT doc_id, i - 1 AS i, unnest([CASE WHEN i + 4 <= len(h) THEN concat_ws(' ', 0, h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]) END, CASE WHEN i + 6 <= len(h) THEN concat_ws(' ', 1, h[i], h[i + 1], h[i + 3], h[i + 5], h[i + 6]) END,
  CASE WHEN i + 8 <= len(h) THEN concat_ws(' ', 2, h[i], h[i + 1], h[i + 4], h[i + 6], h[i + 8]) END,
  CASE WHEN i + 2 <= len(h) THEN concat_ws(' ', 3, h[i], h[i + 1], h[i + 2]) END, CASE WHEN i + 4 <= len(h) THEN concat_ws(' ', 4, h[i], h[i + 1], h[i + 3], h[i + 4]) END,
  CASE WHEN i = 1 AND len(h) < 5 THEN concat_ws(' ', 5, array_to_string(h, ' ')) END]) AS seed FROM ti),
bs AS (SELECT item_id, i - 1 AS j, unnest([CASE WHEN i + 4 <= len(h) THEN concat_ws(' ', 0, h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]) END, CASE WHEN i + 6 <= len(h) THEN concat_ws(' ', 1, h[i], h[i + 1], h[i + 3], h[i + 5], h[i + 6]) END,
  CASE WHEN i + 8 <= len(h) THEN concat_ws(' ', 2, h[i], h[i + 1], h[i + 4], h[i + 6], h[i + 8]) END,
  CASE WHEN i + 2 <= len(h) AND len(h) BETWEEN 5 AND 10 THEN concat_ws(' ', 3, h[i], h[i + 1], h[i + 2]) END, CASE WHEN i + 4 <= len(h) AND len(h) BETWEEN 5 AND 10 THEN concat_ws(' ', 4, h[i], h[i + 1], h[i + 3], h[i + 4]) END,
  CASE WHEN i = 1 AND len(h) < 5 THEN concat_ws(' ', 5, array_to_string(h, ' ')) END]) AS seed FROM bi),
hit AS (SELECT DISTINCT doc_id, item_id, i, j FROM ts JOIN bs USING (seed)),
x AS (SELECT hit.doc_id, hit.item_id, n_items, i, j, t.h AS h, b.h AS g, least(i, j, 64) AS back FROM hit JOIN t ON hit.doc_id = t.doc_id JOIN b ON hit.item_id = b.item_id),
y AS (SELECT *, least(len(h) - i, len(g) - j, 64) + back AS n_aligned FROM x),
z AS (SELECT doc_id, item_id, n_items, n_aligned, i - back AS doc_word, j - back AS item_word, len(list_filter(range(1, n_aligned + 1), lambda q: h[i - back + q] = g[j - back + q])) AS n_equal, least(13, ceil(len(g) * 0.8)) AS need FROM y)
SELECT doc_id, item_id, n_items, n_equal, n_aligned, doc_word, item_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_aligned DESC, doc_word, item_word) AS rn FROM z WHERE n_equal >= need) WHERE rn = 1
"""

OP4 = rf"""
WITH RECURSIVE tags AS (SELECT url, list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b')) AS l,
  list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')) AS m FROM pages WHERE url IS NOT NULL),
t0 AS (SELECT url, unnest(list_concat(list_transform(l, lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
  list_transform(m, lambda x: regexp_extract(x, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*''?([^"''\s>]+)', 1)))) AS target FROM tags),
t1 AS (SELECT url, replace(target, '&amp;', '&') AS target, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM t0 WHERE target <> ''),
t AS (SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN concat(regexp_extract(url, '(?s)^(.*?:)//', 1), target) WHEN starts_with(target, '/') THEN concat(origin, target)
  ELSE concat(origin, CASE WHEN folder = '' THEN '/' ELSE folder END, target) END AS target FROM t1),
u AS (SELECT url, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT url FROM pages UNION SELECT target FROM t)),
s AS (SELECT *, CASE WHEN contains(url, '://') THEN concat('https://', regexp_replace(host, '^(?:www|m)\.', ''), CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END, regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)?', 1)) ELSE url END AS site FROM u),
e AS (SELECT url AS a, target AS b FROM t WHERE url <> target UNION SELECT url, site FROM s WHERE url <> site),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a, a AS b FROM ee UNION SELECT x.a, y.b FROM reach x JOIN ee y ON x.b = y.a),
n AS (SELECT url, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT url FROM u UNION SELECT b FROM ee)),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT url, concat(h, p) AS rule, verdict, row_number() OVER (PARTITION BY url ORDER BY length(h) + length(p) DESC, length(h) DESC) AS rn FROM n JOIN r ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p)),
j AS (SELECT n.*, rule, verdict FROM n LEFT JOIN f ON n.url = f.url AND f.rn = 1),
v AS (SELECT reach.a AS url, min(reach.b) AS component, bool_or(verdict = 'allow') AS allows, bool_or(verdict = 'block') AS blocks FROM reach JOIN j ON reach.b = j.url GROUP BY reach.a)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN allows OR blocks THEN 'alias' ELSE 'default' END AS source, coalesce(component, pages.url) AS component
FROM pages LEFT JOIN j ON pages.url IS NOT DISTINCT FROM j.url LEFT JOIN v ON j.url = v.url
"""
