"""Registered queries: a Spark query and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


#: Views of the site for oracles: pages p and links l, as sources.site makes them.
def norm_sql(x: str) -> str:
    part = lambda g: f"regexp_extract(trim({x}), '^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', {g})"
    path = f"CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END"
    auth = f"regexp_replace(regexp_replace(lower({part(2)}), '^.*@', ''), CASE lower({part(1)}) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')"
    return f"lower(lower({part(1)}) || '://' || {auth} || regexp_replace(CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE {path} END, '/{{2,}}', '/', 'g'))"


SITE = rf"""p AS (
  SELECT page_id, url, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, length(html) AS html_chars, {norm_sql('url')} AS norm,
         trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head>.*?</head>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body,
         CASE page_id % 25 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN 302 ELSE 200 END AS status,
         CAST(page_id % 5 AS INTEGER) AS depth, CAST(page_id * 37 % 101 AS INTEGER) AS aeo, CAST(page_id * 53 % 1500 AS INTEGER) AS ttfb_ms, CAST(page_id * 131 % 3000 AS INTEGER) AS response_ms
  FROM pages),
w AS (SELECT *, CAST(len(list_filter(string_split_regex(body, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, list_filter(string_split(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS segments FROM p),
a AS (SELECT page_id, url, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS m FROM pages)),
h AS (SELECT page_id, url, CAST(pos AS INTEGER) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS anchor FROM a),
l AS (SELECT page_id, pos, {norm_sql('url')} AS source, {norm_sql("regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]*)', 1) || href")} AS target, href, anchor FROM h WHERE starts_with(href, '/'))"""
