"""Query of the URL filter: the five rules, and a list of the canonical URLs that the crawl holds more than once."""

from __future__ import annotations

from postloom.llm.registry import query, read
from postloom.llm.url_filter import Rule, repeated_urls, url_filter
from postloom.session import materialize

RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS url_key FROM s),
listed AS (SELECT url_key FROM k WHERE host <> '' GROUP BY url_key HAVING count(*) > 1),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                             ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (SELECT k.page_id, k.host, k.path, k.url_key,
        arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
      FROM k LEFT JOIN r ON (k.host = r.rhost OR k.host LIKE '%.' || r.rhost) AND starts_with(k.path, r.rpath)
      GROUP BY k.page_id, k.host, k.path, k.url_key)
SELECT page_id, host, path, rule, coalesce(b.verdict, CASE WHEN l.url_key IS NULL OR host = '' THEN 'allow' ELSE 'block' END) AS verdict
FROM b LEFT JOIN listed l ON b.url_key = l.url_key
"""


@query("op4_url_filter", SQL)
def op4_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = materialize(repeated_urls(pages), "listed-urls")
    return url_filter(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")
