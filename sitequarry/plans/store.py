"""Store queries: filters, joins, groups, windows and sets over pages, issues and links of the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions.common import half_up, half_up_int
from sitequarry.operators import rules
from sitequarry.operators import store as s
from sitequarry.plans.registry import SITE, query
from sitequarry.sources import site

RULE_SQL = {
    "broken_link_404": "status = 404", "page_unreachable": "status = 0", "client_error_4xx": "status >= 400 AND status < 500 AND status <> 404", "server_error_5xx": "status >= 500", "redirect_301_permanent": "status IN (301, 308)", "redirect_302_temporary": "status IN (302, 303, 307)",
    "insecure_http_page": "starts_with(url, 'http://')", "title_missing": "trim(title) = ''", "title_too_long": "length(title) > 60", "title_too_short": "trim(title) <> '' AND length(title) < 30",
    "title_same_as_h1": "trim(title) <> '' AND lower(trim(title)) = lower(trim(h1))", "h1_missing": "trim(h1) = ''", "h1_too_long_chars": "length(h1) > 70", "low_word_count": "status < 300 AND n_words < 250",
    "slow_ttfb": "ttfb_ms > 800", "high_latency": "response_ms > 2000", "page_too_large": "html_chars > 2097152", "html_lang_missing": "lang = ''",
    "url_over_length": "length(url) > 115", "url_non_ascii": "regexp_matches(url, '[^\\x00-\\x7F]')", "url_has_parameters": "regexp_matches(url, '\\?[^#]')",
    "url_session_id": "regexp_matches(url, '(?i)[?&](?:sid|sessionid|session_id|phpsessid|jsessionid|aspsessionid|sessid|sid_?[a-z]*)[=:][^&]+') OR regexp_matches(url, '(?i)[?&](?:utm_[a-z]+|gclid|fbclid|msclkid|yclid|dclid|wbraid|gbraid)=[^&]*')",
    "url_uppercase": "regexp_matches(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[A-Z]')", "url_underscores": "contains(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '_')", "low_aeo_score": "aeo < 70",
    "url_duplicate_path": "coalesce(list_bool_or(list_transform(range(1, len(segments)), lambda i: segments[i] = segments[i + 1])), false)", "url_double_slash": "contains(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '//')",
}
#: Of rules whose severity depends on the page.
SEVERITY_SQL = {"low_word_count": "CASE WHEN n_words < 100 THEN 'Warning' ELSE 'Notice' END"}
ISSUES = SITE + ",\ni AS (" + "\nUNION ALL ".join(f"SELECT page_id, url, '{r.id}' AS issue_id, '{r.name}' AS name, {SEVERITY_SQL.get(r.id) or repr(r.severity)} AS severity, '{r.category}' AS category FROM w WHERE {RULE_SQL[r.id]}" for r in rules.REGISTRY.values() if r.id in RULE_SQL) + ")"
WEIGHT = "CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END"


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.crawl(site.table(spark, sf_dir, "pages"))


def issues_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.issues(pages_of(spark, sf_dir))


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.links(site.table(spark, sf_dir, "pages"))


@query(f"WITH {ISSUES} SELECT page_id, url, issue_id, name, severity, category FROM i")
def audit_issues(spark, sf_dir):
    return issues_of(spark, sf_dir)


@query(f"WITH {ISSUES} SELECT name, min(issue_id) AS issue_id, arg_max(severity, CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) AS severity, min(category) AS category, count(DISTINCT url) AS affected_pages, max({WEIGHT}) AS weight FROM i GROUP BY name")
def a_issue_summary(spark, sf_dir):
    return rules.summary(issues_of(spark, sf_dir))


@query("SELECT page_id, url FROM pages WHERE page_id = 7")
def q_get_crawl(spark, sf_dir):
    return site.table(spark, sf_dir, "pages").where("page_id = 7").select("page_id", "url")


@query("SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS started FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def q_list_crawls(spark, sf_dir):
    orders = site.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return s.newest(orders, "o_orderdate", "o_orderkey", 25).select("o_orderkey", "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("started"))


@query(f"WITH {ISSUES} SELECT page_id, issue_id, severity FROM i WHERE severity = 'Warning' AND (name ILIKE '%url%' OR url ILIKE '%url%')")
def q_issues_filter(spark, sf_dir):
    return s.filter_issues(issues_of(spark, sf_dir), severity="Warning", category="all", search="url").select("page_id", "issue_id", "severity")


@query(f"WITH {ISSUES} SELECT DISTINCT url FROM i WHERE name = 'Title too short' ORDER BY url LIMIT 100")
def q_issue_urls(spark, sf_dir):
    return issues_of(spark, sf_dir).where("name = 'Title too short'").select("url").distinct().orderBy("url").limit(100)


@query(f"WITH {ISSUES} SELECT page_id, url, status, depth, aeo FROM w WHERE status >= 400 AND aeo < 60 AND (url ILIKE '%example%' OR title ILIKE '%example%' OR h1 ILIKE '%example%') ORDER BY depth, url LIMIT 50")
def q_pages_filter(spark, sf_dir):
    found = s.filter_pages(pages_of(spark, sf_dir), search="example", bucket="broken", least_aeo=60)
    return s.page(found.orderBy("depth", "url"), 1, 50).select("page_id", "url", "status", "depth", "aeo")


@query(f"WITH {ISSUES} SELECT source, target, anchor FROM l WHERE source ILIKE '%blog%' ORDER BY target, source, pos LIMIT 200")
def q_links_filter(spark, sf_dir):
    found = s.filter_links(links_of(spark, sf_dir), kind="all", search="blog", fields=["source"])
    return found.orderBy("target", "source", "pos").limit(200).select("source", "target", "anchor")


RECS = f"""recs AS (SELECT issue_id, count(DISTINCT url) AS affected_pages,
  CASE arg_max(severity, CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) WHEN 'Error' THEN CASE WHEN count(DISTINCT url) >= 10 THEN 'Critical' ELSE 'High' END WHEN 'Warning' THEN CASE WHEN count(DISTINCT url) >= 10 THEN 'High' ELSE 'Medium' END ELSE 'Low' END AS priority FROM i GROUP BY 1)"""


@query(f"WITH {ISSUES}, {RECS} SELECT issue_id, affected_pages, priority, CAST(row_number() OVER (ORDER BY CASE priority WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, affected_pages DESC, issue_id) AS INTEGER) AS place FROM recs")
def q_recommendations(spark, sf_dir):
    return s.ranked(s.recommendations(issues_of(spark, sf_dir)), [t.priority_rank(F.col("priority")).desc(), F.desc("affected_pages"), F.col("issue_id")])


@query(f"WITH {ISSUES}, {RECS} SELECT i.name, r.priority, count(DISTINCT i.url) AS pages FROM i LEFT JOIN recs r ON i.issue_id = r.issue_id AND r.priority <> 'Low' GROUP BY 1, 2")
def j_issues_recs(spark, sf_dir):
    found = issues_of(spark, sf_dir)
    recs = s.recommendations(found).where("priority <> 'Low'").select("issue_id", "priority")
    return found.join(F.broadcast(recs), "issue_id", "left").groupBy("name", "priority").agg(F.count_distinct("url").alias("pages"))


@query("SELECT page_id, url AS loc, '2026-01-0' || (1 + page_id % 9) AS lastmod FROM pages ORDER BY url, page_id LIMIT 200")
def q_sitemap_urls(spark, sf_dir):
    """Entries of sitemaps, in order of address."""
    from sitequarry.sources.readers import sitemap

    day = (F.col("page_id") % 9 + 1).cast("string")
    files = site.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<urlset><url><loc><![CDATA["), "url", F.lit("]]></loc><lastmod>2026-01-0"), day, F.lit("</lastmod></url></urlset>")).alias("xml"))
    return sitemap(files, "page_id", "xml").orderBy("loc", "page_id").limit(200).select("page_id", "loc", "lastmod")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_audit_issues(spark, sf_dir):
    return s.with_details(site.table(spark, sf_dir, "events"), "props", "$.k", "bigint", "k").select("event_id", "k")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE 5 END AS k FROM documents")
def p_safe_parse(spark, sf_dir):
    docs = site.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "{broken").otherwise('{"k": 5}').alias("j"))
    return s.with_details(docs, "j", "$.k", "int", "k").select("doc_id", F.coalesce("k", F.lit(-1)).alias("k"))


@query(f"WITH {ISSUES} SELECT page_id, norm FROM p WHERE lower(url) = (SELECT lower(url) FROM pages WHERE page_id = 11) OR norm = (SELECT norm FROM p WHERE page_id = 11)")
def q_get_page(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    wanted = pages.where("page_id = 11").select(F.lower("url").alias("low"), F.col("norm").alias("key")).limit(1)
    return pages.join(F.broadcast(wanted), (F.lower("url") == F.col("low")) | (F.col("norm") == F.col("key"))).select("page_id", "norm")


@query(f"WITH {ISSUES}, b AS (SELECT severity, name, list_slice(list_sort(list_distinct(list(url))), 1, 25) AS u FROM i WHERE severity = 'Error' GROUP BY 1, 2) SELECT severity, name, array_to_string(u, ' ') AS sample FROM b ORDER BY name LIMIT 50")
def q_mcp_filters(spark, sf_dir):
    found = issues_of(spark, sf_dir).where("severity = 'Error'").groupBy("severity", "name").agg(F.slice(F.array_sort(F.collect_set("url")), 1, 25).alias("u"))
    return found.orderBy("name").limit(50).select("severity", "name", F.array_join("u", " ").alias("sample"))


@query(f"WITH {ISSUES} SELECT page_id, status = 200 AS found, CAST(length(body) AS BIGINT) AS n, left(body, 400) AS preview FROM p")
def q_llms_probe(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", (F.col("status") == 200).alias("found"), F.length("body").cast("long").alias("n"), F.substring("body", 1, 400).alias("preview"))


HOSTS = "hs AS (SELECT DISTINCT regexp_extract(lower(trim(url)), '^[a-z]+://(?:[^@/?#]*@)?([^/?#:]*)', 1) AS host FROM pages)"


@query(f"WITH {HOSTS} SELECT host, length(host) % 3 = 0 AS llms_txt, length(host) % 3 <> 2 AS sitemap_xml FROM hs")
def src_probe(spark, sf_dir):
    """Which of the well-known files each host serves: with 200, at that path."""
    from sitequarry.functions.url import hostname
    from sitequarry.sources.readers import probed

    hosts = site.table(spark, sf_dir, "pages").select(hostname(F.col("url")).alias("host")).distinct()
    n = F.length("host") % 3
    tried = F.array(F.struct(F.lit("/llms.txt").alias("path"), F.when(n == 0, 200).otherwise(404).alias("status")), F.struct(F.lit("/sitemap.xml").alias("path"), F.when(n == 2, 301).otherwise(200).alias("status")))
    fetched = hosts.select(F.explode(tried).alias("f"), "host").select(F.concat(F.lit("https://"), "host", "f.path").alias("url"), "f.status")
    return probed(fetched, {"llms_txt": "/llms.txt", "sitemap_xml": "/sitemap.xml"})


@query(f"WITH {ISSUES} SELECT page_id, url FROM p WHERE (status = 200 AND norm NOT IN (SELECT norm FROM p WHERE page_id % 3 = 0)) OR (norm IN (SELECT norm FROM p WHERE page_id % 3 = 0) AND norm NOT IN (SELECT target FROM l))")
def q_sitemap_report(spark, sf_dir):
    """Pages that the sitemap lacks, and pages that nothing but the sitemap leads to."""
    from sitequarry.plans.analysis import j_sitemap_anti

    return pages_of(spark, sf_dir).join(j_sitemap_anti(spark, sf_dir), "page_id", "left_semi").select("page_id", "url")


@query(f"WITH {ISSUES} SELECT page_id, url FROM p WHERE regexp_matches(url, '/en/\\d+') OR contains(lower(url), '[blog')")
def p_matches_patterns(spark, sf_dir):
    from sitequarry.functions.url import matches_patterns

    return pages_of(spark, sf_dir).where(matches_patterns(F.col("url"), [r"/en/\d+", "[blog"])).select("page_id", "url")


@query(f"WITH {ISSUES} SELECT page_id, norm FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY status >= 300, page_id) AS r FROM p WHERE status < 400 AND body <> '') WHERE r = 1")
def p_duplicate_inputs(spark, sf_dir):
    pages = pages_of(spark, sf_dir).where("status < 400 and body <> ''")
    return s.first_per_key(pages, ["norm"], [F.col("status") >= 300, F.col("page_id")]).select("page_id", "norm")


@query(f"WITH {ISSUES} SELECT p.page_id, coalesce(array_to_string(list_sort(list(i.issue_id) FILTER (WHERE i.issue_id IS NOT NULL)), ','), '') AS issues FROM p LEFT JOIN i USING (page_id) GROUP BY 1")
def j_full_crawl(spark, sf_dir):
    nested = issues_of(spark, sf_dir).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("issue_id")), ",").alias("issues"))
    return pages_of(spark, sf_dir).select("page_id").join(nested, "page_id", "left").select("page_id", F.coalesce("issues", F.lit("")).alias("issues"))


@query(f"WITH {ISSUES} SELECT issue_id, count(*) AS n, CAST(count(*) * 100 AS BIGINT) AS n100 FROM i GROUP BY 1")
def a_count_total(spark, sf_dir):
    return issues_of(spark, sf_dir).groupBy("issue_id").agg(F.count("*").alias("n"), (F.count("*") * 100).alias("n100"))


@query(f"WITH {ISSUES}, g AS (SELECT name, arg_max(severity, CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) AS severity, count(DISTINCT url) AS pages FROM i GROUP BY 1) SELECT name, severity, pages FROM g ORDER BY {WEIGHT} DESC, pages DESC, name LIMIT 5 OFFSET 5")
def a_issue_groups_sql(spark, sf_dir):
    g = issues_of(spark, sf_dir).groupBy("name").agg(t.worst_severity(F.col("severity")).alias("severity"), F.count_distinct("url").alias("pages"))
    return s.page(g.orderBy(t.severity_weight(F.col("severity")).desc(), F.desc("pages"), "name"), 2, 5)


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F')
SELECT c.o_custkey, c.o_orderkey, count(DISTINCT l_partkey) AS pages FROM c JOIN lineitem ON l_orderkey = c.o_orderkey WHERE r = 2 GROUP BY 1, 2""")
def a_prev_issue_counts(spark, sf_dir):
    orders = site.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    second = s.nth_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")
    lines = site.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return second.join(lines, second.o_orderkey == lines.l_orderkey).groupBy("o_custkey", "o_orderkey").agg(F.count_distinct("l_partkey").alias("pages"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 2")
def w_second_newest(spark, sf_dir):
    return s.nth_per_key(site.table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query(f"WITH {ISSUES}, g AS (SELECT name, arg_max(severity, CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) AS severity, count(DISTINCT url) AS pages FROM i GROUP BY 1) SELECT severity, CAST(sum(pages) AS BIGINT) AS total FROM g GROUP BY 1")
def a_severity_totals(spark, sf_dir):
    return s.severity_totals(rules.summary(issues_of(spark, sf_dir)))


@query(f"WITH {ISSUES} SELECT status, CAST(floor(avg(aeo) + 0.5) AS BIGINT) AS average FROM p GROUP BY 1")
def a_avg_aeo(spark, sf_dir):
    return pages_of(spark, sf_dir).groupBy("status").agg(F.coalesce(half_up_int(F.avg("aeo")), F.lit(0)).alias("average"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1 LIMIT 30")
def a_trend(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return site.table(spark, sf_dir, "orders").groupBy(day).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("day").limit(30)


@query(f"WITH {ISSUES} SELECT target, array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources, array_to_string(list_sort(list(DISTINCT anchor)), ' ') AS anchors, count(*) AS n FROM l GROUP BY 1")
def a_link_target_agg(spark, sf_dir):
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    return links_of(spark, sf_dir).groupBy("target").agg(join("source").alias("sources"), join("anchor").alias("anchors"), F.count("*").alias("n"))


@query(f"""WITH {ISSUES}, g AS (SELECT name, arg_max(severity, {WEIGHT}) AS severity, count(DISTINCT url) AS n FROM i GROUP BY 1), gate AS (SELECT (SELECT coalesce(sum(n), 0) FROM g WHERE severity = 'Error') AS errors, (SELECT coalesce(sum(n), 0) FROM g WHERE severity = 'Warning') AS warnings,
  (SELECT floor(avg(aeo) + 0.5) FROM p) AS aeo, (SELECT count(*) FROM p WHERE status >= 400) AS broken)
SELECT 'errors' AS rule, CAST(errors AS DOUBLE) AS value, errors > 0 AS violated FROM gate UNION ALL SELECT 'warnings', CAST(warnings AS DOUBLE), warnings > 10 FROM gate UNION ALL SELECT 'aeo', CAST(aeo AS DOUBLE), aeo < 70 FROM gate UNION ALL SELECT 'broken', CAST(broken AS DOUBLE), broken > 0 FROM gate""")
def a_ci_gate(spark, sf_dir):
    return s.ci_gate(pages_of(spark, sf_dir), rules.summary(issues_of(spark, sf_dir)))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def a_publisher_groups(spark, sf_dir):
    return s.first_per_key(site.table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def w_first_per_key(spark, sf_dir):
    return s.first_per_key(site.table(spark, sf_dir, "events"), ["user_id"], [F.col("event_id")]).select("user_id", "event_id")


@query("SELECT event_type, event_id, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 4")
def w_topk_per_group(spark, sf_dir):
    return s.top_per_key(site.table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 4).select("event_type", "event_id", "place")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(2 + i // 3 AS INTEGER) AS week, strftime(DATE '2026-09-22' + CAST(7 + i // 3 * 7 + i % 3 * (7 // 3) AS INTEGER), '%Y-%m-%d') AS due, CAST(i % 4 AS INTEGER) AS page FROM r""")
def w_position_schedule(spark, sf_dir):
    sites = site.table(spark, sf_dir, "part")
    return s.schedule(sites, [F.desc("p_retailprice"), F.col("p_partkey")], "2026-09-22", per_week=3, pages=4).select("p_partkey", F.col("i").cast("int").alias("i"), "week", "due", F.col("page").cast("int").alias("page"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 64")
def w_context_tail(spark, sf_dir):
    return s.top_per_key(site.table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 64).select("event_type", "event_id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM events")
def w_trailing3(spark, sf_dir):
    w = W.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return site.table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean3"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS n FROM events")
def w_rate_limit(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.unix_millis(F.col("ts").cast("timestamp"))).rangeBetween(-3600000, 0)
    return site.table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n"))


@query("""WITH h AS (SELECT conv_id, turn, length(text) % 6 + 1 AS level FROM conversations) SELECT conv_id, turn, CAST(level AS INTEGER) AS level
FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM h) WHERE prev > 0 AND level > prev + 1""")
def w_heading_skip(spark, sf_dir):
    h = site.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 6 + 1).cast("int").alias("level"))
    return s.skipped_levels(h, ["conv_id"], "turn", "level").select("conv_id", "turn", "level")


@query(f"WITH {ISSUES}, g AS (SELECT name, arg_max(severity, CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) AS severity, count(DISTINCT url) AS pages FROM i GROUP BY 1) SELECT name, CAST(row_number() OVER (ORDER BY {WEIGHT} DESC, pages DESC, name) AS INTEGER) AS place FROM g")
def s_severity_rank(spark, sf_dir):
    g = issues_of(spark, sf_dir).groupBy("name").agg(t.worst_severity(F.col("severity")).alias("severity"), F.count_distinct("url").alias("pages"))
    return s.ranked(g, [t.severity_weight(F.col("severity")).desc(), F.desc("pages"), F.col("name")]).select("name", "place")


@query(f"WITH {ISSUES}, {RECS} SELECT issue_id, priority FROM recs WHERE priority IN ('Critical', 'High') ORDER BY affected_pages DESC, issue_id LIMIT 10")
def s_priority_rank(spark, sf_dir):
    r = s.recommendations(issues_of(spark, sf_dir)).where(F.col("priority").isin("Critical", "High"))
    return r.orderBy(F.desc("affected_pages"), "issue_id").limit(10).select("issue_id", "priority")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 100")
def s_paginate(spark, sf_dir):
    return s.page(site.table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id"), 3, 50).select("event_id", "value")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def s_topk(spark, sf_dir):
    return site.table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(12).select("c_custkey", "c_acctbal")


@query("SELECT page_id FROM pages ORDER BY md5('7|' || CAST(page_id AS VARCHAR)) LIMIT 5")
def s_sample(spark, sf_dir):
    return s.sample(site.table(spark, sf_dir, "pages"), "page_id", 5, seed=7).select("page_id")


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 97 AS target FROM lineitem WHERE l_suppkey <> l_partkey % 97), b(node, level) AS (SELECT 1::BIGINT, 0 UNION SELECT e.target, level + 1 FROM b JOIN e ON e.source = b.node WHERE level < 4), m AS (SELECT node, min(level) AS level FROM b GROUP BY 1) SELECT node, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY level ORDER BY node) AS INTEGER) AS turn FROM m")
def s_fifo(spark, sf_dir):
    """The order in which a breadth-first queue gives out pages: by level, within a level by its turn."""
    from sitequarry.operators import graph

    levels = graph.levels(spark.createDataFrame([(1,)], "node long"), site.internal_graph(spark, sf_dir), 4)
    return levels.withColumn("turn", F.row_number().over(W.partitionBy("level").orderBy("node")))


@query(f"WITH {ISSUES} SELECT anchor FROM l UNION SELECT h1 FROM p WHERE h1 <> ''")
def set_union_keywords(spark, sf_dir):
    return links_of(spark, sf_dir).select("anchor").union(pages_of(spark, sf_dir).where("h1 <> ''").select("h1")).distinct()


@query(f"WITH {ISSUES} SELECT norm FROM p WHERE page_id % 10 <> 0 EXCEPT SELECT norm FROM p WHERE page_id % 10 <> 1")
def set_diff_urls(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    return p.where("page_id % 10 <> 0").select("norm").subtract(p.where("page_id % 10 <> 1").select("norm"))


@query("SELECT p_partkey, array_to_string(list_sort(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))), ' ') AS shared FROM part")
def set_intersect_tokens(spark, sf_dir):
    return site.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(F.split("p_name", " "), F.split("p_type", " "))), " ").alias("shared"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(flatten(list([o_orderstatus, left(o_orderpriority, 1)])))), ' ') AS tags FROM orders GROUP BY 1")
def set_union_issue_urls(spark, sf_dir):
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1))))))
    return site.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(tags, " ").alias("tags"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b FROM part)
SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(a || b)), 6) AS jaccard FROM t""")
def set_jaccard(spark, sf_dir):
    return site.table(spark, sf_dir, "part").select("p_partkey", F.round(t.jaccard(F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split("p_type", " "))), 6).alias("jaccard"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(['STEEL', 'TIN', 'BRASS'], lambda x: NOT list_contains(string_split(p_type, ' '), x))), ' ') AS missing FROM part")
def set_missing_expected(spark, sf_dir):
    expected = F.array(*[F.lit(x) for x in ("STEEL", "TIN", "BRASS")])
    return site.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(expected, F.split("p_type", " "))), " ").alias("missing"))


@query(f"WITH {ISSUES} SELECT DISTINCT source, target FROM l")
def set_dedupe_edges(spark, sf_dir):
    return links_of(spark, sf_dir).select("source", "target").dropDuplicates()


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def set_dup_ids(spark, sf_dir):
    return s.repeated(site.table(spark, sf_dir, "conversations"), ["conv_id", "role"])


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def a_median(spark, sf_dir):
    return site.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("SELECT event_type, event_id // 100 AS patch, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1, 2")
def a_patch_stats(spark, sf_dir):
    patch = F.floor(F.col("event_id") / 100).alias("patch")
    return site.table(spark, sf_dir, "events").groupBy("event_type", patch).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN s_acctbal < 0 THEN 'not_reviewed' WHEN s_suppkey % 7 = 0 THEN 'no_route' WHEN s_suppkey % 5 = 0 THEN 'not_free' WHEN s_nationkey % 3 = 0 THEN 'topic_mismatch' END AS reason FROM supplier) WHERE reason IS NOT NULL GROUP BY 1")
def a_excluded_summary(spark, sf_dir):
    """Sites that a plan leaves out, by the first reason."""
    from sitequarry.plans.analysis import _sites

    return _sites(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {ISSUES} SELECT norm, array_to_string(list_sort(list(page_id)), ',') AS provenance FROM p GROUP BY 1")
def a_consolidate(spark, sf_dir):
    return pages_of(spark, sf_dir).groupBy("norm").agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("provenance"))


@query(f"WITH {ISSUES} SELECT norm, min(page_id) AS first_id, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM p GROUP BY 1")
def a_source_rows(spark, sf_dir):
    return pages_of(spark, sf_dir).groupBy("norm").agg(F.min("page_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("WITH g AS (SELECT l_orderkey AS domain, count(DISTINCT s_nationkey % 5) FILTER (WHERE s_nationkey % 5 <> 0) AS competitors, bool_or(s_nationkey % 5 = 0) AS has_target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) SELECT CASE WHEN has_target THEN 'Low' WHEN competitors = 4 THEN 'Critical' WHEN competitors >= 2 THEN 'High' ELSE 'Medium' END AS priority, count(*) AS n FROM g WHERE competitors > 0 GROUP BY 1")
def a_gap_counts(spark, sf_dir):
    """Referring domains by the priority of asking them."""
    from sitequarry.plans.analysis import a_link_intersect

    return a_link_intersect(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j_page_lookup(spark, sf_dir):
    return site.table(spark, sf_dir, "documents").select("doc_id").join(site.table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))
