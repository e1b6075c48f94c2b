"""Readers, writers, robots, parsed pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.functions.common import half_up
from sitequarry.functions import text as t
from sitequarry.operators import audit, content, html, logs, robots, rules
from sitequarry.operators import store as s
from sitequarry.operators.shared import fresh
from sitequarry.plans.registry import SITE, query
from sitequarry.plans.store import ISSUES, issues_of, links_of, pages_of
from sitequarry.sources import readers, site
from sitequarry.streaming import events as ev


def _folder(spark) -> str:
    return fresh(spark, "files")


@query("SELECT event_id FROM events")
def src_log_text(spark, sf_dir):
    path = _folder(spark)
    site.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("value")).write.text(path)
    return readers.log_lines(spark, path).select(F.col("value").cast("long").alias("event_id"))


@query("SELECT url FROM pages")
def src_seed_file(spark, sf_dir):
    path = _folder(spark)
    p = site.table(spark, sf_dir, "pages")
    p.select(F.explode(F.array(F.lit("# note"), F.lit(""), F.concat(F.lit("  "), "url"))).alias("value")).write.text(path)
    return readers.seeds(spark, path)


@query("SELECT url FROM pages")
def src_source_list(spark, sf_dir):
    path = _folder(spark) + ".csv"
    site.table(spark, sf_dir, "pages").select(F.lit('a "quoted", one').alias("note"), "url").write.csv(path, header=True, quote='"', escape='"')
    return readers.source_list(spark, path)


@query("SELECT CAST(page_id % 3 AS VARCHAR) AS id, url, page_id AS title FROM pages WHERE page_id % 3 <> 1")
def src_legacy_json(spark, sf_dir):
    path = _folder(spark)
    p = site.table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 60).alias("part"), (F.col("page_id") % 3).cast("string").alias("id"), "url", F.struct(F.col("page_id").cast("string").alias("title"), F.lit(200).alias("status")).alias("v"))
    # A snapshot of many pages takes several lines of 20 pages, so that no row grows with the table.
    p.groupBy("id", "part").agg(F.map_from_entries(F.collect_list(F.struct("url", "v"))).alias("pages")).drop("part").write.json(path)
    known = spark.createDataFrame([("1",)], "id string")
    return readers.snapshots(spark, path, known).select("id", "url", F.col("title").cast("long").alias("title"))


@query("SELECT page_id, url AS loc, '2026-01-01' AS lastmod FROM pages")
def src_sitemap(spark, sf_dir):
    files = site.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<?xml version='1.0'?><urlset><url>\n<loc> <![CDATA["), "url", F.lit("]]> </loc><lastmod>2026-01-01</lastmod></url></urlset>")).alias("xml"))
    return readers.sitemap(files, "page_id", "xml").select("page_id", "loc", "lastmod")


@query("SELECT page_id, url FROM pages WHERE page_id % 4 = 2")
def src_store_scan(spark, sf_dir):
    path = _folder(spark)
    pages = site.table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 4).alias("crawl_id"))
    readers.save_crawl({"pages": pages}, path)
    return spark.read.parquet(f"{path}/pages").where("crawl_id = 2").select("page_id", "url")


@query("SELECT page_id, page_id % 4 AS crawl_id FROM pages")
def sink_save_crawl(spark, sf_dir):
    """Saving a crawl twice leaves one copy of it, and the others untouched."""
    path = _folder(spark)
    pages = site.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4).alias("crawl_id"))
    readers.save_crawl({"pages": pages}, path)
    readers.save_crawl({"pages": pages.where("crawl_id = 1")}, path)
    return spark.read.parquet(f"{path}/pages").select("page_id", F.col("crawl_id").cast("long").alias("crawl_id"))


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, CASE WHEN page_id % 2 = 0 THEN '''=1+1' ELSE 'plain, \"text\"' END AS note, CASE WHEN page_id % 3 = 0 THEN 'yes' ELSE 'no' END AS ok, 'a|b' AS types FROM pages")
def sink_csv(spark, sf_dir):
    path = _folder(spark)
    i = F.col("page_id")
    rows = site.table(spark, sf_dir, "pages").select("page_id", F.when(i % 2 == 0, "=1+1").otherwise('plain, "text"').alias("note"), (i % 3 == 0).alias("ok"), F.array(F.lit("a"), F.lit("b")).alias("types"))
    readers.write_csv(rows, path)
    return spark.read.csv(path, header=True, quote='"', escape='"')


ROBOTS = "User-agent: *\nDisallow: /admin/\nDisallow: /api/\nAllow: /api/public/\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: Googlebot\nDisallow: /private/\nDisallow: /*.pdf$\n"
PATHS = ["/", "/admin/x", "/api/x", "/api/public/x", "/private/a", "/a.pdf", "/a.pdfx"]


@query("""WITH p AS (SELECT s_suppkey, unnest(['/', '/admin/x', '/api/x', '/api/public/x', '/private/a', '/a.pdf', '/a.pdfx']) AS path FROM supplier)
SELECT s_suppkey, path, CASE WHEN path IN ('/private/a', '/a.pdf') THEN false ELSE true END AS allowed, CASE path WHEN '/private/a' THEN '/private/' WHEN '/a.pdf' THEN '/*.pdf$' ELSE '' END AS pattern FROM p""")
def html_robots_sim(spark, sf_dir):
    return robots.verdicts(_rules(spark, sf_dir), "s_suppkey", _paths(spark, sf_dir), "Googlebot")


def _rules(spark, sf_dir):
    return robots.rules(site.table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(ROBOTS).alias("txt")), "s_suppkey", "txt")


def _paths(spark, sf_dir):
    return site.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(p) for p in PATHS])).alias("path"))


@query("WITH p AS (SELECT s_suppkey, unnest(['/', '/admin/x', '/api/x', '/api/public/x', '/private/a', '/a.pdf', '/a.pdfx']) AS path FROM supplier) SELECT s_suppkey, path, path NOT IN ('/admin/x', '/api/x') AS allowed FROM p")
def src_robots(spark, sf_dir):
    return robots.verdicts(_rules(spark, sf_dir), "s_suppkey", _paths(spark, sf_dir), "SomeBot").select("s_suppkey", "path", "allowed")


def _ai_files(spark, sf_dir):
    """robots.txt of each supplier's site: some shut out all, some a few crawlers, some let one back in."""
    k = F.col("s_suppkey") % 4
    some = "User-agent: GPTBot\nUser-agent: OAI-SearchBot\nDisallow: /\n\nUser-agent: ChatGPT-User\nDisallow: /*\n"
    text = F.when(k == 0, "User-agent: *\nDisallow: /\n\nUser-agent: YouBot\nAllow: /\n").when(k == 1, some).when(k == 2, "User-agent: *\nDisallow: /private/\n").otherwise("")
    return site.table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("txt"))


AI_SQL = ", ".join(f"('{b}', '{r}')" for r, bs in robots.AI_ROLES.items() for b in bs)


@query(f"""WITH b(bot, role) AS (VALUES {AI_SQL}), r AS (SELECT s_suppkey, bot, role, CASE s_suppkey % 4 WHEN 0 THEN bot <> 'YouBot' WHEN 1 THEN bot IN ('GPTBot', 'OAI-SearchBot', 'ChatGPT-User') ELSE false END AS blocked FROM supplier, b)
SELECT s_suppkey, bot, blocked, CASE WHEN blocked AND role = 'ai-search' THEN 'ai_search_bot_blocked' WHEN blocked AND role = 'user-fetcher' THEN 'ai_fetcher_blocked' ELSE '' END AS issue_id FROM r""")
def html_robots_ai(spark, sf_dir):
    files = _ai_files(spark, sf_dir)
    return robots.posture(robots.rules(files, "s_suppkey", "txt"), "s_suppkey", files).select("s_suppkey", "bot", "blocked", F.coalesce("issue_id", F.lit("")).alias("issue_id"))


@query(f"""WITH b(bot, role) AS (VALUES {AI_SQL}) SELECT role, count(*) AS n, CAST(count(*) FILTER (WHERE CASE s_suppkey % 4 WHEN 0 THEN bot <> 'YouBot' WHEN 1 THEN bot IN ('GPTBot', 'OAI-SearchBot', 'ChatGPT-User') ELSE false END) AS BIGINT) AS blocked FROM supplier, b GROUP BY 1""")
def a_robots_bots(spark, sf_dir):
    files = _ai_files(spark, sf_dir)
    return robots.posture(robots.rules(files, "s_suppkey", "txt"), "s_suppkey", files).groupBy("role").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"))


@query()
def html_audit(spark, sf_dir):
    return html.extract(site.table(spark, sf_dir, "pages"))


@query("SELECT page_id, 'Page ' || page_id AS title, 'About ' || page_id AS description, url AS canonical, 'en' AS lang, ['en,de', 'en,x-default', 'en,de_DE', 'en,de'][page_id % 4 + 1] AS languages FROM pages")
def html_meta(spark, sf_dir):
    return html.extract(made_pages(spark, sf_dir)).select("page_id", "title", "description", "canonical", "lang", F.array_join("languages", ",").alias("languages"))


#: Pages made from the table's ids and URLs: what the raw ones lack, each kind on every fourth page or on all.
LONG_ANSWER = "A page is a document that a site serves to its readers and that names what it is about in words which a reader can check against what the rest of it says."
LINKED = [
    '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Why?","acceptedAnswer":{"@type":"Answer","text":"So."}}]}',
    '{"@context":"https://schema.org","@type":"Article","headline":"H","datePublished":"2026-01-01"}',
    '{"@context":"https://schema.org","@type":',
    '{"@graph":[{"@type":["Product","Offer"],"name":"P","offers":"cheap","price":0,"priceCurrency":"EUR"}]}',
]


def made_pages(spark, sf_dir, url="url"):
    """(page_id, url, html), with the table's URLs or another expression: a head with description, canonical, alternate, files and structured data; a body with headings, an answer, images, links, questions, fields and buttons."""
    i, url = F.col("page_id"), F.expr(url)
    n = i.cast("string")
    by4 = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (i % 4).cast("int"))
    parts = [
        F.lit('<!doctype html><html lang="en"><head><title>Page '), n, F.lit('</title><meta name="description" content="About '), n, F.lit('"><link rel="canonical" href="'), url, F.lit('">'),
        F.lit('<link rel="alternate" hreflang="en" href="'), url, F.lit('"><link rel="alternate" hreflang="'), by4(["de", "x-default", "de_DE", "de"]), F.lit('" href="/de'), (i - i % 2).cast("string"), F.lit('">'),
        F.lit('<link rel="stylesheet" href="/s.css"><script src="https://cdn.other.org/x.js"></script><script type="application/ld+json">'), by4(LINKED), F.lit("</script></head><body><nav><a href='/home'>Home</a></nav><h1>Page "), n, F.lit("</h1><div><p>"),
        F.when(i % 2 == 0, LONG_ANSWER).otherwise("Too short an answer."), F.lit("</p></div><h3>What is it?</h3><p>It is "), n, F.lit('.</p><img src="/i'), n, F.lit('.png" alt="a" width="10" height="20"><img data-src="b.jpg">'),
        F.lit("<a href='/t"), n, F.lit("' rel='nofollow sponsored'> target <b>"), n, F.lit("</b></a><a href='mailto:x@y.z'>mail</a><a href='#top'>top</a><a href='https://other.org/p'><img src='/c.webp' alt='c'></a>"),
        F.lit("<details><summary>Why?</summary>Because.</details>"), F.when(i % 4 == 1, "<table><tr><td>x</table><button></button><input name=q><label>ok <input name=r></label>").otherwise("<button>Go</button>"), F.lit("<footer>Foot</footer></body></html>"),
    ]
    return site.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat(*parts).alias("html"))


ORIGIN = "regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]*)', 1)"


@query(f"SELECT page_id, CAST(l.pos AS INTEGER) AS pos, l.target, l.anchor, l.nofollow, l.internal FROM (SELECT page_id, unnest([{{'pos': 0, 'target': {ORIGIN} || '/home', 'anchor': 'Home', 'nofollow': false, 'internal': true}}, {{'pos': 1, 'target': {ORIGIN} || '/t' || page_id, 'anchor': 'target ' || page_id, 'nofollow': true, 'internal': true}}, {{'pos': 4, 'target': 'https://other.org/p', 'anchor': '', 'nofollow': false, 'internal': false}}]) AS l FROM pages)")
def html_links(spark, sf_dir):
    return html.links(html.details(made_pages(spark, sf_dir))).select("page_id", "pos", "target", "anchor", "nofollow", "internal")


@query(f"""SELECT page_id, i.src, i.alt, i.sized, i.in_link FROM (SELECT page_id, unnest([{{'src': '/i' || page_id || '.png', 'alt': 'a', 'sized': true, 'in_link': false}}, {{'src': 'b.jpg', 'alt': '(none)', 'sized': false, 'in_link': false}}, {{'src': '/c.webp', 'alt': 'c', 'sized': false, 'in_link': true}}]) AS i FROM pages)""")
def html_images(spark, sf_dir):
    return html.images(html.details(made_pages(spark, sf_dir))).select("page_id", "src", F.coalesce("alt", F.lit("(none)")).alias("alt"), "sized", "in_link")


@query("SELECT page_id, 15 + CASE WHEN page_id % 2 = 0 THEN 30 ELSE 10 END + CASE WHEN page_id % 4 = 1 THEN 20 ELSE 5 END + CASE WHEN page_id % 4 = 0 THEN 25 ELSE 0 END AS aeo, page_id % 2 = 0 AS answered FROM pages")
def html_aeo(spark, sf_dir):
    return html.extract(made_pages(spark, sf_dir)).select("page_id", F.col("aeo").cast("int").alias("aeo"), (F.col("answer") != "").alias("answered"))


@query("SELECT page_id, ['FAQPage', 'Article', '', 'Product,Offer'][page_id % 4 + 1] AS types, ['', 'rich', 'malformed', 'schema,schema'][page_id % 4 + 1] AS kinds, ['', 'Article lacks author', '', 'Product.offers is a plain text,context is None, not schema.org'][page_id % 4 + 1] AS messages FROM pages")
def html_schema(spark, sf_dir):
    found = F.transform("schema_findings", lambda x: x["kind"])
    said = F.transform(F.filter("schema_findings", lambda x: x["kind"] != "malformed"), lambda x: x["message"])
    return html.extract(made_pages(spark, sf_dir)).select("page_id", F.array_join("schema_types", ",").alias("types"), F.array_join(found, ",").alias("kinds"), F.array_join(F.array_sort(said), ",").alias("messages"))


@query("SELECT page_id, unnest(CASE WHEN page_id % 4 = 1 THEN ['a11y_image_alt', 'a11y_heading_order', 'a11y_link_name', 'mobile_viewport_missing', 'a11y_button_name', 'a11y_input_label'] ELSE ['a11y_image_alt', 'a11y_heading_order', 'a11y_link_name', 'mobile_viewport_missing'] END) AS issue_id FROM pages")
def html_a11y(spark, sf_dir):
    return _parsed_issues(made_pages(spark, sf_dir)).where("category = 'Accessibility'").select("page_id", "issue_id")


def _parsed_issues(raw):
    """Findings of all rules, on pages as they would have been fetched."""
    fetched = raw.select("page_id", F.length("html").cast("long").alias("html_chars"), F.lit(200).alias("status"), (F.col("page_id") * 53 % 1500).alias("ttfb_ms"), (F.col("page_id") * 131 % 3000).alias("response_ms"), F.create_map().cast("map<string,string>").alias("headers"))
    pages = html.extract(raw).join(fetched, "page_id")
    pages = pages.withColumns({f"ease_{k}": v for k, v in t.readability(F.col("clean")).items()}).withColumn("ease", t.reading_ease(F.col("ease_n_words"), F.col("ease_n_sentences"), F.col("ease_n_syllables")))
    return rules.issues(pages)


@query("SELECT page_id, CASE WHEN page_id * 53 % 1500 > 800 THEN 60 WHEN page_id * 53 % 1500 > 400 THEN 70 ELSE 80 END AS score, CAST(2 AS BIGINT) AS blocking, CAST(1 AS BIGINT) AS unsized FROM pages")
def html_pagespeed(spark, sf_dir):
    made = made_pages(spark, sf_dir)
    timed = html.extract(made.withColumn("html", F.replace("html", F.lit("<img src='/c.webp'"), F.lit("<img width=1 height=1 src='/c.webp'")))).withColumn("ttfb_ms", F.col("page_id") * 53 % 1500)
    return timed.select("page_id", html.speed_score(F.col("counts"), F.col("ttfb_ms")).cast("int").alias("score"), F.col("counts")["blocking"].alias("blocking"), F.col("counts")["unsized"].alias("unsized"))


@query(f"WITH {SITE} SELECT page_id, md5(body) AS digest FROM p")
def html_visible_text(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", F.md5(F.col("body").cast("binary")).alias("digest"))


@query(f"SELECT page_id, {ORIGIN} || a.path AS url, a.kind, CASE WHEN a.path = '/s.css' THEN 200 WHEN a.path = '/c.webp' THEN 404 ELSE 0 END AS status, a.path <> '/s.css' AS broken FROM (SELECT page_id, url, unnest([{{'path': '/s.css', 'kind': 'stylesheet'}}, {{'path': '/i' || page_id || '.png', 'kind': 'image'}}, {{'path': '/c.webp', 'kind': 'image'}}]) AS a FROM pages)")
def html_assets(spark, sf_dir):
    found = html.assets(html.details(made_pages(spark, sf_dir)))
    fetched = found.where("url like '%/s.css' or url like '%/c.webp'").select("url", F.when(F.col("url").endswith(".css"), 200).otherwise(404).alias("status")).distinct()
    return html.verified_assets(found, fetched).select("page_id", "url", "kind", "status", "broken")


@query("SELECT page_id, 'Page ' || page_id || ' ' || CASE WHEN page_id % 2 = 0 THEN '" + LONG_ANSWER + "' ELSE 'Too short an answer.' END || ' What is it? It is ' || page_id || '. target ' || page_id || ' mail top Why? Because.' || CASE WHEN page_id % 4 = 1 THEN ' x ok' ELSE ' Go' END AS clean FROM pages")
def html_clean_text(spark, sf_dir):
    return html.details(made_pages(spark, sf_dir)).select("page_id", "clean")


@query("SELECT page_id, CAST(h.pos AS INTEGER) AS pos, h.level, h.text, h.skips FROM (SELECT page_id, unnest([{'pos': 0, 'level': 1, 'text': 'Page ' || page_id, 'skips': false}, {'pos': 1, 'level': 3, 'text': 'What is it?', 'skips': true}]) AS h FROM pages)")
def html_outline(spark, sf_dir):
    return html.outline(html.details(made_pages(spark, sf_dir)))


@query("SELECT page_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(w, lambda x: x = 'reader' OR x = 'readers')) AS BIGINT) AS about_readers FROM (SELECT page_id, list_filter(string_split_regex(regexp_replace('Page ' || page_id || ' ' || CASE WHEN page_id % 2 = 0 THEN '" + LONG_ANSWER + "' ELSE 'Too short an answer.' END || ' What is it? It is ' || page_id || '. target ' || page_id || ' mail top Why? Because.' || CASE WHEN page_id % 4 = 1 THEN ' x ok' ELSE ' Go' END, '[^a-zA-Z0-9'' -]', '', 'g'), ' +'), lambda x: x <> '') AS w FROM pages)")
def html_content(spark, sf_dir):
    """Words, reading ease, grade and level, the phrases of one to three words, and the outline, of each page."""
    found = content.analysed(html.details(made_pages(spark, sf_dir)))
    return found.select("page_id", "n_words", F.size(F.filter("phrases", lambda x: x["phrase"].isin("reader", "readers"))).cast("long").alias("about_readers"))


@query(f"WITH {SITE} SELECT DISTINCT page_id, target, anchor FROM l WHERE contains(target, 'example.com')")
def html_target_links(spark, sf_dir):
    return links_of(spark, sf_dir).where(F.col("target").contains("example.com")).select("page_id", "target", "anchor").distinct()


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, 'track\\((\\d+)\\)', 1), ',') AS ids, CAST(0 AS BIGINT) AS broken, regexp_extract(html, '<li><a href="([^"]*)"', 1) AS first_link, trim(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&')) AS title, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items FROM pages""")
def udf_custom_extract(spark, sf_dir):
    """By pattern, CSS selector and path; the first match or all; a rule that cannot be read gives nothing."""
    rules_ = {
        "ids": r"track\((\d+)\)", "broken": "([", "first_link": {"type": "css", "selector": "nav ul > li a[href]", "attribute": "href", "all": False},
        "title": {"type": "xpath", "selector": "//head/title/text()"}, "items": {"type": "css", "selector": "li"}, "bad": {"type": "css", "selector": "li >"},
    }
    found = html.custom_fields(site.table(spark, sf_dir, "pages"), rules_)
    one = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("")).alias(c)
    return found.select("page_id", F.array_join("ids", ",").alias("ids"), (F.size("broken") + F.size("bad")).cast("long").alias("broken"), one("first_link"), one("title"), F.size("items").cast("long").alias("items"))


@query("SELECT page_id, 'my_rule' AS issue_id FROM pages WHERE page_id % 2 = 0")
def udf_register_check(spark, sf_dir):
    rules.register("my_rule", "Even page", "Notice", "Custom", lambda: F.col("page_id") % 2 == 0)
    try:
        return rules.issues(pages_of(spark, sf_dir), ["my_rule"]).select("page_id", "issue_id")
    finally:
        del rules.REGISTRY["my_rule"]


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return ev.read(spark, sf_dir, "events", schema)


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def st_event_feed(spark, sf_dir):
    return ev.drained(ev.running_counts(_stream(spark, sf_dir), "event_type"), "complete", _folder(spark))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def st_dedup_state(spark, sf_dir):
    """First sightings within a watermark, so that state is dropped; what comes back after it is counted once at the end."""
    seen = ev.first_seen(_stream(spark, sf_dir), "user_id").select("user_id")
    return ev.drained(seen, "append", _folder(spark)).select("user_id").distinct().agg(F.count("*").alias("n"))


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_out_of_order_logs(spark, sf_dir):
    out = ev.drained(ev.windows(_stream(spark, sf_dir), "event_type"), "complete", _folder(spark))
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS k FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2)")
def st_sessions(spark, sf_dir):
    e = site.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sessions(e, "user_id").agg(F.count("*").alias("n"), F.sum("n").alias("events"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) WHERE r = 1")
def st_cache_ttl(spark, sf_dir):
    """What a cache still holds: the latest success of each key within its time to live."""
    e = site.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).head()[0]
    return ev.cached(e, "user_id", "ts", "event_id", F.col("event_type") != "error", F.lit(now), 7 * 86_400).select("user_id", "event_id")


@query("WITH r AS (SELECT event_id, event_type, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r, max(ts) OVER () AS now FROM events) SELECT event_id, r <= 20 AS remembered, event_type <> 'purchase' OR ts > now - INTERVAL 60 SECOND AS listed FROM r WHERE r <= 20 OR (event_type <> 'purchase' OR ts > now - INTERVAL 60 SECOND)")
def st_job_retention(spark, sf_dir):
    """The last 20 results are remembered; jobs stay listed until 60 seconds after they are done (here: purchases)."""
    e = site.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).head()[0]
    return ev.retained(e, "event_id", "ts", F.col("event_type") == "purchase", F.lit(now), 20, 60).select("event_id", "remembered", "listed")


@query("SELECT event_id, least(8000, 1000 * CAST(pow(2, event_id % 5) AS BIGINT)) AS wait_ms, event_id % 5 < 2 AS again FROM events WHERE event_type = 'error'")
def st_retry(spark, sf_dir):
    r = F.col("event_id") % 5
    return site.table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.least(F.lit(8000), (1000 * F.pow(F.lit(2), r)).cast("long")).alias("wait_ms"), (r < 2).alias("again"))


ALWAYS = "canonical_missing favicon_missing hreflang_missing meta_desc_missing mobile_viewport_missing missing_security_headers no_cache_max_age no_cache_validators og_tags_incomplete schema_missing twitter_card_incomplete".split()


@query(f"SELECT page_id, unnest([{', '.join(repr(x) for x in ALWAYS)}]) AS issue_id FROM pages UNION ALL SELECT page_id, 'no_compression' FROM pages WHERE length(html) > 5120")
def audit_parsed(spark, sf_dir):
    """Rules over parsed pages: here those that the given pages, which have neither headers nor metadata, all have; html_audit_issues has all."""
    found = html_audit_issues(spark, sf_dir)
    return found.where(F.col("issue_id").isin(*ALWAYS, "no_compression")).select("page_id", "issue_id")


@query()
def html_audit_issues(spark, sf_dir):
    return _parsed_issues(site.table(spark, sf_dir, "pages"))


@query("""WITH p AS (SELECT page_id, url, ['de', 'x-default', 'de_DE', 'de'][page_id % 4 + 1] AS lang, 'https://s.org/de' || (page_id - page_id % 2) AS target FROM pages)
SELECT page_id, 'hreflang_unlinked_target' AS issue_id FROM p UNION ALL SELECT page_id, 'hreflang_relative_url' FROM p UNION ALL SELECT page_id, 'hreflang_missing_x_default' FROM p WHERE lang <> 'x-default' UNION ALL SELECT page_id, 'hreflang_invalid_code' FROM p WHERE lang = 'de_DE'
UNION ALL SELECT page_id, 'hreflang_target_non_200' FROM p WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'hreflang_target_noindex' FROM p WHERE page_id % 5 = 1""")
def audit_hreflang(spark, sf_dir):
    """Every page names itself and a German page that doesn't exist; every fifth page is missing, every fifth not for indexing."""
    made = made_pages(spark, sf_dir, "concat('https://s.org/p', page_id)")
    pages = made.select("page_id", "url", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"), (F.col("page_id") % 5 != 1).alias("indexable"))
    return audit.hreflang_issues(html.alternates(html.details(made)), pages).join(pages.select("page_id", "url"), "url").select("page_id", "issue_id")
