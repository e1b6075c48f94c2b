"""Queries over what is written and what is found: reports, recommendations, structured data, patches, searches, publishing, settings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sitequarry.operators import audit, documents, fetch, html, publish, reports, search
from sitequarry.operators.shared import fresh
from sitequarry.plans.analysis import TWO, _two
from sitequarry.plans.crawl import made_pages
from sitequarry.plans.registry import SITE, query
from sitequarry.plans.store import ISSUES, RECS, issues_of, pages_of
from sitequarry.sources import config, site

STEPS = "coalesce(lib.effort, 'M') AS effort, coalesce(lib.why, CASE i.severity WHEN 'Error' THEN 'It keeps readers or crawlers out.' WHEN 'Warning' THEN 'It weakens the page.' ELSE 'It could be better.' END) AS why"


def _library_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(i)}, {quote(effort)}, {quote(why)}, [{', '.join(map(quote, steps))}])" for i, (effort, why, steps) in documents.LIBRARY.items())
    return f"lib(issue_id, effort, why, steps) AS (VALUES {rows})"


@query(f"WITH {ISSUES}, {_library_sql()}, k AS (SELECT DISTINCT issue_id, name, severity FROM i) SELECT i.issue_id, i.severity, {STEPS}, CAST(coalesce(len(lib.steps), 2) AS INTEGER) AS n_steps FROM k i LEFT JOIN lib USING (issue_id)")
def j_recommendation_lib(spark, sf_dir):
    """Each finding with the library's advice, or general advice."""
    found = issues_of(spark, sf_dir).select("issue_id", "severity").distinct()
    return documents.advised(found).select("issue_id", "severity", "effort", "why", F.size("steps").alias("n_steps"))


@query(f"""WITH {ISSUES}, {RECS}, {_library_sql()}, g AS (SELECT issue_id, min(name) AS name, arg_max(severity, CASE severity WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) AS severity, list_sort(list(DISTINCT url)) AS urls FROM i GROUP BY 1),
adv AS (SELECT i.*, {STEPS}, coalesce(lib.steps, ['{documents.PLAN[0]}', '{documents.PLAN[1]}']) AS steps FROM g i LEFT JOIN lib USING (issue_id))
SELECT issue_id, priority, effort, '## ' || name || chr(10) || chr(10) || why || chr(10) || chr(10) || '### What to do' || chr(10) || array_to_string(list_transform(steps, lambda x, k: k || '. ' || x), chr(10)) || chr(10) || chr(10) || '### Pages (' || len(urls) || ')' || chr(10)
 || array_to_string(list_transform(urls[1:20], lambda x: '- ' || x), chr(10)) || CASE WHEN len(urls) > 20 THEN chr(10) || 'and ' || (len(urls) - 20) || ' more' ELSE '' END AS doc FROM adv JOIN recs USING (issue_id)""")
def gen_fix_docs(spark, sf_dir):
    return documents.fix_docs(issues_of(spark, sf_dir)).select("issue_id", "priority", "effort", "doc")


@query(f"""WITH {SITE}, r AS (SELECT status, count(*) AS n FROM p GROUP BY 1), t AS (SELECT string_agg('| ' || status || ' | ' || n || ' |', chr(10) ORDER BY status) AS rows FROM r)
SELECT unnest(string_split('# Crawl' || chr(10) || chr(10) || '- **pages**: ' || (SELECT count(*) FROM p) || chr(10) || chr(10) || '## Status' || chr(10) || chr(10) || '| status | n |' || chr(10) || '| --- | --- |' || chr(10) || rows || chr(10), chr(10))) AS value FROM t""")
def sink_markdown(spark, sf_dir):
    """A report written as a file and read again, line by line."""
    p = pages_of(spark, sf_dir)
    text = documents.markdown_report("Crawl", {"pages": p.count()}, {"Status": p.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")})
    return _written(spark, text, "\n")


def _written(spark, text, separator):
    path = fresh(spark, "report")
    documents.write_text(spark, text, path)
    return spark.read.text(path, wholetext=True).select(F.explode(F.split("value", separator)).alias("value"))


@query(f"""WITH {SITE}, r AS (SELECT status, count(*) AS n FROM p GROUP BY 1), t AS (SELECT string_agg('<tr><td>' || status || '</td><td>' || n || '</td></tr>', '' ORDER BY status) AS rows FROM r)
SELECT '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Crawl &lt;1&gt;</title></head><body><h1>Crawl &lt;1&gt;</h1><dl><dt>pages</dt><dd>' || (SELECT count(*) FROM p) || '</dd></dl><h2>Status</h2><table><tr><th>status</th><th>n</th></tr>' || rows || '</table></body></html>' AS value FROM t""")
def sink_html(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    text = documents.html_report("Crawl <1>", {"pages": p.count()}, {"Status": p.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")})
    return _written(spark, text, "\u0001")


@query(f"""WITH {SITE}, r AS (SELECT status, count(*) AS n FROM p GROUP BY 1), t AS (SELECT string_agg(rpad(CAST(status AS VARCHAR), 6, ' ') || '  ' || n, chr(10) ORDER BY status) AS rows FROM r)
SELECT unnest(string_split('Crawl' || chr(10) || '=====' || chr(10) || 'pages: ' || (SELECT count(*) FROM p) || chr(10) || chr(10) || 'Status' || chr(10) || '------' || chr(10) || 'status  n' || chr(10) || rows || chr(10), chr(10))) AS value FROM t""")
def sink_terminal(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    text = documents.terminal_report("Crawl", {"pages": p.count()}, {"Status": p.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")})
    return _written(spark, text, "\n")


@query(f"""WITH {TWO}, d AS (SELECT coalesce(b.norm, c.norm) AS norm, CASE WHEN b.norm IS NULL THEN 'added' WHEN c.norm IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN c ON b.norm = c.norm WHERE b.norm IS NULL OR c.norm IS NULL OR b.status <> c.status OR b.title <> c.title),
s AS (SELECT change, count(*) AS n FROM d GROUP BY 1) SELECT unnest(['| change | n |', '| --- | --- |'] || list('| ' || change || ' | ' || n || ' |' ORDER BY change)) AS value FROM s""")
def sink_formatters(spark, sf_dir):
    """Of a diff; markdown_report does the same for any other tables."""
    changes = reports.diff(*_two(spark, sf_dir), "norm", ["status", "title"]).groupBy("change").agg(F.count("*").alias("n")).orderBy("change")
    return _written(spark, documents.markdown_table(changes), "\n")


@query("SELECT p_partkey, '\"' || p_name || ', \"\"new\"\"\",''=' || p_size || ',\"' || p_brand || chr(13) || chr(10) || p_type || '\"' AS line FROM part")
def sink_specialised_csv(spark, sf_dir):
    p = site.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "new"')).alias("title"), F.concat(F.lit("="), F.col("p_size").cast("string")).alias("size"), F.array("p_brand", "p_type").alias("steps"))
    return p.select("p_partkey", documents.sheet_line(p.drop("p_partkey")).alias("line"))


@query("SELECT regexp_extract(lower(trim(url)), '^[a-z]+://(?:[^@/?#]*@)?([^/?#:]*)', 1) AS host, CAST(count(DISTINCT url) AS BIGINT) AS n FROM pages GROUP BY 1")
def sink_indexnow(spark, sf_dir):
    sent = documents.index_notices(site.table(spark, sf_dir, "pages").select("url"), "key1", most=3)
    listed = sent.select("host", "n", F.size(F.from_json("body", "host string, key string, keyLocation string, urlList array<string>")["urlList"]).cast("long").alias("m")).where("n = m and n <= 3")
    return listed.groupBy("host").agg(F.sum("n").alias("n"))


@query("SELECT 'event: ' || event_type || chr(10) || 'data: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' || chr(10) || chr(10) AS line FROM events")
def sink_sse(spark, sf_dir):
    return documents.stream_lines(site.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")


@query("SELECT c_custkey % 7 AS run_id, c_custkey, CAST(c_custkey AS BIGINT) AS kept FROM customer")
def sink_save_documents(spark, sf_dir):
    """Documents saved by run; a run saved again replaces its own."""
    path = fresh(spark, "documents")
    rows = site.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("run_id"), "c_custkey", "c_name")
    documents.save_document(rows, "run_id", ["c_custkey"], path)
    documents.save_document(rows.where("run_id = 3"), "run_id", ["c_custkey"], path)
    return spark.read.parquet(path).select(F.col("run_id").cast("long").alias("run_id"), "c_custkey", F.get_json_object("body", "$.c_custkey").cast("long").alias("kept"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 = 3 ORDER BY c_custkey DESC LIMIT 20")
def q_list_aux(spark, sf_dir):
    """Saved documents of one key, newest first."""
    path = fresh(spark, "documents")
    rows = site.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("run_id"), "c_custkey", "c_name")
    documents.save_document(rows, "run_id", ["c_custkey"], path)
    found = spark.read.parquet(path).where("run_id = 3").orderBy(F.desc("c_custkey")).limit(20)
    return found.select("c_custkey", F.get_json_object("body", "$.c_name").alias("c_name"))


@query("""SELECT p_partkey, '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"' || p_name || '","author":{"@type":"Person","name":"' || p_brand || '"},"datePublished":"2026-01-01","mainEntityOfPage":"https://x.org/' || p_partkey || '"}</script>' AS article,
 '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"What?","acceptedAnswer":{"@type":"Answer","text":"' || p_name || '"}}]}' AS faq,
 '{"@context":"https://schema.org","@type":"LocalBusiness","name":"' || p_brand || '","address":{"@type":"PostalAddress","streetAddress":"1 Road","addressLocality":"Town","addressCountry":"DE"},"url":"https://x.org/' || p_partkey || '"}' AS business FROM part""")
def gen_schema_types(spark, sf_dir):
    url = F.concat(F.lit("https://x.org/"), F.col("p_partkey").cast("string"))
    asked = F.array(F.struct(F.lit("What?").alias("question"), F.col("p_name").alias("answer")))
    p = site.table(spark, sf_dir, "part")
    return p.select("p_partkey", documents.script_tag(documents.article(F.col("p_name"), F.col("p_brand"), F.lit("2026-01-01"), url)).alias("article"), documents.faq(asked).alias("faq"), documents.local_business(F.col("p_brand"), F.lit("1 Road"), F.lit("Town"), F.lit("DE"), F.lit(None).cast("string"), url).alias("business"))


@query("""SELECT p_partkey, p_name || ' is a ' || lower(p_type) || ' for readers who look for "' || p_brand || '". It rests on checked records, names where each figure comes from, says when it was last checked, and shows the steps between the record and what is stated, so that every answer here can be followed back to its source by anyone who asks.' AS paragraph,
 '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Topic | ' || p_name || ' |' || chr(10) || '| Query | ' || p_brand || ' |' || chr(10) || '| Basis | checked records |' AS table_, len(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) + 51 AS n_words FROM part""")
def gen_aeo_snippet(spark, sf_dir):
    s = documents.snippet(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(" "))
    return site.table(spark, sf_dir, "part").select("p_partkey", s["paragraph"].alias("paragraph"), s["table"].alias("table_"), s["n_words"].cast("int").alias("n_words"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'next' ELSE 'astro' END AS framework,
 CASE p_partkey % 3 WHEN 0 THEN '<!doctype html><head>' || chr(10) || '  <link rel="canonical" href="https://x.org/">' || chr(10) || '  <meta name="description" content="D"><title>' || p_name || '</title></head>'
  WHEN 1 THEN 'export const metadata = {' || chr(10) || '  title: "' || p_name || '",' || chr(10) || '  alternates: { canonical: "https://x.org/" }, description: "kept" };'
  ELSE '---' || chr(10) || '---' || chr(10) || '<html><head>' || chr(10) || '  <link rel="canonical" href="https://x.org/">' || chr(10) || '  <meta name="description" content="D">' || chr(10) || '  <title>' || p_name || '</title></head></html>' END AS source FROM part""")
def code_patch(spark, sf_dir):
    i = F.col("p_partkey") % 3
    path = F.when(i == 0, "index.html").when(i == 1, "app/page.tsx").otherwise("src/index.astro")
    source = F.when(i == 0, "<!doctype html><head><title>old</title></head>").when(i == 1, 'export const metadata = { description: "kept" };').otherwise("---\n---\n<html><head></head></html>")
    files = site.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", F.col("p_partkey").cast("string"), path).alias("path"), source.alias("source"), F.col("p_name").alias("title"), F.lit("D").alias("description"), F.lit("https://x.org/").alias("canonical"))
    return documents.patches(files.drop("p_partkey")).select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("p_partkey"), "framework", "source")


@query("SELECT doc_id, replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), ' ') AS md, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents WHERE NOT regexp_matches(text, '[\\r\\x0B\\x0C\\x{85}\\x{2028}\\x{2029}]|[ \\t]\\n|\\n[ \\t\\n]')")
def txt_escapes(spark, sf_dir):
    """Cells of Markdown and text of HTML; texts whose line ends SQL has no name for are left to the tests."""
    d = site.table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[\r\x0B\x0C\x{85}\x{2028}\x{2029}]|[ \t]\n|\n[ \t\n]"))
    return d.select("doc_id", documents.md_cell(F.col("text")).alias("md"), documents.html_escape(F.col("text")).alias("html"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'header cf-mitigated' WHEN 1 THEN 'title: just a moment...' ELSE '' END AS signal FROM events")
def txt_challenge_signal(spark, sf_dir):
    i = F.col("event_id") % 4
    headers = F.when(i == 0, F.create_map(F.lit("cf-mitigated"), F.lit(" Challenge"))).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    body = F.when(i == 1, "<title>Just a\n moment...</title><script src=/cdn-cgi/challenge-platform/x>").when(i == 2, "<title>Just a moment</title>").otherwise("<title>About hcaptcha</title> cf-chl-")
    return site.table(spark, sf_dir, "events").select("event_id", F.coalesce(search.challenge(headers, body), F.lit("")).alias("signal"))


def _result_pages(spark, sf_dir):
    i = F.col("page_id")
    n = i.cast("string")
    duck = F.concat(F.lit("<div class='result x'><a class='result__a' href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fa"), n, F.lit(".org%2Fp%3Fq%3D1&amp;rut=1'>Title <b>"), n, F.lit("</b></a><a class='result__snippet'>Said "), n, F.lit("</a></div><div class=result><a class=result__a href='mailto:x'>none</a></div>"))
    google = F.concat(F.lit("<a href='/url?q=https://g"), n, F.lit(".org/x&sa=U'><h3>G</h3></a><a href='https://no.org/'>no heading</a>"))
    rss = F.concat(F.lit("<rss><channel><item><title>R &amp; S</title><link>https://r"), n, F.lit(".org/</link><description><![CDATA[d]]></description></item></channel></rss>"))
    body = F.when(i % 6 == 0, duck).when(i % 6 == 1, google).when(i % 6 == 2, rss).when(i % 6 == 3, "<form id='challenge-form'></form>").when(i % 6 == 4, "<div class='no-results'>No  results.</div>").otherwise("<p>else</p>")
    provider = F.when(i % 6 == 1, "google").when(i % 6 == 2, "bing-rss").otherwise("duckduckgo-html")
    return site.table(spark, sf_dir, "pages").select(n.alias("key"), provider.alias("provider"), body.alias("body"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 3 THEN 'provider_challenge' WHEN 4 THEN 'empty_results' WHEN 5 THEN 'parse_failed' ELSE 'results' END AS status, CASE page_id % 6 WHEN 0 THEN 'https://a' || page_id || '.org/p?q=1' WHEN 1 THEN 'https://g' || page_id || '.org/x' WHEN 2 THEN 'https://r' || page_id || '.org/' ELSE '' END AS url,
 CASE page_id % 6 WHEN 0 THEN 'Title ' || page_id WHEN 1 THEN 'G' WHEN 2 THEN 'R & S' ELSE '' END AS title, CASE page_id % 6 WHEN 0 THEN 'Said ' || page_id WHEN 2 THEN 'd' ELSE '' END AS snippet FROM pages""")
def html_search_results(spark, sf_dir):
    found = search.results(_result_pages(spark, sf_dir))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select(F.col("key").cast("long").alias("page_id"), "status", blank("url"), blank("title"), blank("snippet"))


@query("SELECT CAST(i AS INTEGER) AS n, sha256('<a class=result__a href=''https://s' || i || '.org/''>S</a>') AS sha256, 'https://s' || i || '.org/' AS url FROM (SELECT unnest(range(0, 20)) AS i)")
def src_saved_html(spark, sf_dir):
    path = fresh(spark, "saved")
    for i in range(20):
        documents.write_text(spark, f"<a class=result__a href='https://s{i}.org/'>S</a>", f"{path}/{i}.html")
    pages = search.saved_pages(spark, path, "duckduckgo-html", "2026-01-01T00:00:00Z")
    found = search.results(pages).where("status = 'results'")
    return found.join(pages.select("key", "sha256"), "key").select(F.regexp_extract("key", r"(\d+)\.html$", 1).cast("int").alias("n"), "sha256", "url")


def _records(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(i % 5 == 0, "results").when(i % 5 == 1, "empty_results").otherwise("error")
    evidence = F.when(i % 5 == 2, "Request timed out").when(i % 5 == 3, "getaddrinfo ENOTFOUND").when(i % 5 == 4, F.when(i % 2 == 0, "").otherwise("odd")).otherwise("tool output")
    found = F.when((i % 5 == 0) & (i % 3 != 0), F.array(F.struct(F.lit("https://x.org/").alias("url"))))
    return site.table(spark, sf_dir, "events").select("event_id", F.lit("tool").alias("provider"), F.concat(F.lit("q"), (i % 4).cast("string")).alias("query"), F.when(i % 2 == 0, "de").alias("market"), F.lit(None).cast("string").alias("language"), F.lit("2026-01-01T00:00:00Z").alias("captured_at"), status.alias("status"), evidence.alias("evidence"), F.lit(None).cast("int").alias("http_status"), found.alias("results"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 'results without any' WHEN event_id % 5 = 4 AND event_id % 2 = 0 THEN 'lacks evidence' ELSE '' END AS problem,
 CASE event_id % 5 WHEN 0 THEN 'results' WHEN 1 THEN 'empty_results' WHEN 2 THEN 'connection_timeout' WHEN 3 THEN 'dns_failure' ELSE 'unknown' END AS status FROM events""")
def src_host_records(spark, sf_dir):
    return search.host_attempts(_records(spark, sf_dir)).select("event_id", F.coalesce("problem", F.lit("")).alias("problem"), "status")


@query("SELECT event_id FROM events WHERE (event_id % 4 = 0 AND event_id % 2 = 0) OR (event_id % 4 = 1 AND event_id % 2 = 1)")
def j_host_records(spark, sf_dir):
    """Recorded attempts of the queries asked for, by query, market and language, null beside null."""
    asked = spark.createDataFrame([("q0", "de", None), ("q1", None, None), ("q2", None, None), ("q3", "de", None)], "query string, market string, language string")
    return search.matched(_records(spark, sf_dir), asked).select("event_id")


@query("SELECT event_id, r <= 16 AND epoch_ms(ts) - first < 86400000 AS allowed FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, min(epoch_ms(ts)) OVER (PARTITION BY user_id) AS first FROM events)")
def x_budget(spark, sf_dir):
    return search.budgeted(site.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 16, 86_400).select("event_id", "allowed")


@query("SELECT s_suppkey, CAST(i AS INTEGER) AS page, 'https://search.example/?q=%22' || replace(s_name, '#', '%23') || '%22+-site%3As' || s_suppkey || '.org&start=' || (10 * i) AS url FROM supplier, (SELECT unnest(range(0, 5)) AS i)")
def x_search_plan(spark, sf_dir):
    targets = site.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".org")).alias("target"), F.col("s_name").alias("brand"))
    planned = search.search_plan(targets.select("target", "brand"), "https://search.example/", '"{brand}" -site:{target}', 5)
    return planned.join(targets.select("target", "s_suppkey"), "target").select("s_suppkey", "page", "url")


@query("""WITH c AS (SELECT 'https://d' || doc_id % 50 || '.org/' AS url, ['supplied', 'saved', 'host', 'native'][doc_id % 4 + 1] AS channel, doc_id % 4 AS rank, doc_id FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 50 <> 8),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, doc_id) AS r FROM c) SELECT url, channel, doc_id AS "order" FROM r WHERE r = 1 ORDER BY rank, doc_id, url LIMIT 40""")
def x_discover(spark, sf_dir):
    """Candidates of four channels: one for each address, of the first channel; the target's own pages and those of search providers are left out."""
    k = F.col("doc_id") % 50
    host = F.when(k == 7, "www.mine.org").when(k == 8, "www.google.com").otherwise(F.concat(F.lit("d"), k.cast("string"), F.lit(".org")))
    channel = F.get(F.array(*[F.lit(x) for x in search.CHANNELS]), (F.col("doc_id") % 4).cast("int"))
    c = site.table(spark, sf_dir, "documents").select(F.concat(F.lit("https://"), host, F.lit("/")).alias("url"), channel.alias("channel"), F.lit("t").alias("title"), F.col("doc_id").alias("order"))
    return search.discovered(c, "https://mine.org/", 40).select("url", "channel", "order")


def _kinds(spark, sf_dir):
    kinds = ["answer", "community", "curation", "code_resource", "social_article", "editorial_article"]
    k = F.col("s_suppkey")
    return site.table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.array(F.when(k % 2 == 0, "Travel").otherwise("Business"), F.lit("News")).alias("topics"), F.get(F.array(*[F.lit(x) for x in kinds]), (k % 6).cast("int")).alias("kind"), F.when(k % 5 == 0, "closed").otherwise("open").alias("status"))


@query("SELECT s_suppkey AS id FROM supplier WHERE contains(lower(s_name), '2') AND s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0")
def src_catalog(spark, sf_dir):
    return publish.catalogue(_kinds(spark, sf_dir), name="2", topic="trav", status="open").select("id")


@query("""SELECT s_suppkey AS id, CAST(CASE s_suppkey % 6 WHEN 5 THEN 5 ELSE 4 END AS INTEGER) AS n, CASE s_suppkey % 6 WHEN 0 THEN 'Answer a question about ' || s_name || ' that was asked there.' WHEN 1 THEN 'Find the discussion where ' || s_name || ' belongs, and read its rules.' WHEN 2 THEN 'Collect what is worth reading about ' || s_name || ' for readers.'
 WHEN 3 THEN 'Publish the resource about ' || s_name || ' first.' WHEN 4 THEN 'Show one part of ' || s_name || ' by a picture of your own.' ELSE 'Answer the main question about ' || s_name || '.' END AS first, CASE s_suppkey % 6 WHEN 5 THEN 'editorial' WHEN 0 THEN 'moderated' WHEN 1 THEN 'moderated' ELSE 'own' END AS role FROM supplier""")
def p_outline(spark, sf_dir):
    lines = publish.outline(F.col("kind"), F.col("name"), F.lit("readers"))
    return _kinds(spark, sf_dir).select("id", F.size(lines).alias("n"), F.get(lines, F.lit(0)).alias("first"), publish.role(F.col("kind")).alias("role"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'website' END, CASE WHEN c_custkey % 4 = 0 THEN 'topics' END, CASE WHEN c_custkey % 5 = 0 THEN 'page status' END, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 10 > 7 THEN 'posts_per_week' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer""")
def p_validate(spark, sf_dir):
    k = F.col("c_custkey")
    page = F.struct(F.lit("https://x.org/a").alias("url"), F.lit("a").alias("topic"), F.when(k % 5 == 0, "lost").alias("status"))
    profile = F.struct(F.when(k % 3 == 0, "ftp://x").otherwise("https://x.org").alias("website"), F.col("c_name").alias("business"), F.lit("all").alias("audience"), F.when(k % 4 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("topics"), F.array(page).alias("pages"), (k % 10).cast("int").alias("posts_per_week"))
    text = F.to_json(profile)
    return site.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(publish.problems(F.from_json(text, publish.PROFILE)), ",").alias("problems"))


@query("SELECT * FROM (VALUES ('concurrency', '4'), ('delay_ms', '0'), ('least_words', '250'), ('most_depth', '3'), ('most_pages', '50'), ('timeout_ms', '15000')) v(name, value)")
def src_config(spark, sf_dir):
    text = json.dumps({"crawl": {"most_pages": 100, "most_depth": 3}, "domains": {"x.org": {"most_pages": 50}}})
    found = config.load(text, "x.org", {"concurrency": 4})
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(vars(found).items()) if isinstance(v, int) and not isinstance(v, bool)], "name string, value string")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unverified_access' ELSE 'link_observed' END AS verification, CAST(CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n FROM pages UNION ALL SELECT -1 - page_id, CASE WHEN page_id % 5 = 0 THEN 'unverified_access' ELSE 'no_link_in_captured_content' END, 0 FROM pages")
def html_verify_source(spark, sf_dir):
    """Whether pages link to a host: other.org, which all of them do, and absent.org, which none does (ids below zero)."""
    made = made_pages(spark, sf_dir)
    pages = made.select("page_id", F.when(F.col("page_id") % 5 == 0, 403).otherwise(200).alias("status"))
    links = html.links(html.details(made))
    one = reports.verified(pages, links, "other.org")
    return one.unionByName(reports.verified(pages, links, "absent.org").withColumn("page_id", -1 - F.col("page_id"))).select("page_id", "verification", "n")


@query("SELECT CAST(count(*) FILTER (WHERE page_id % 5 <> 0) AS BIGINT) AS link_observed, CAST(0 AS BIGINT) AS no_link_in_captured_content, count(*) FILTER (WHERE page_id % 5 = 0) AS unverified_access FROM pages")
def a_check_sources(spark, sf_dir):
    found = html_verify_source(spark, sf_dir).where("page_id >= 0")
    n = lambda name: F.count_if(F.col("verification") == name).alias(name)
    return found.agg(n("link_observed"), n("no_link_in_captured_content"), n("unverified_access"))


@query(f"WITH {TWO}, j AS (SELECT b.norm AS bn, c.norm AS cn, b.status AS bs, c.status AS cs, b.title AS bt, c.title AS ct FROM b FULL JOIN c ON b.norm = c.norm) SELECT count(*) FILTER (WHERE bn IS NULL) AS added, count(*) FILTER (WHERE cn IS NULL) AS removed, count(*) FILTER (WHERE bs <> cs) AS status_changes, count(*) FILTER (WHERE bs < 400 AND cs >= 400) AS regressions, count(*) FILTER (WHERE bs < 400 AND cs >= 400) = 0 AS clean FROM j")
def a_diff_summary(spark, sf_dir):
    return reports.diff_summary(*_two(spark, sf_dir), "norm")


@query(f"WITH {ISSUES}, hs AS (SELECT *, regexp_extract(lower(trim(url)), '^[a-z]+://(?:[^@/?#]*@)?([^/?#:]*)', 1) AS host FROM i) SELECT name, count(DISTINCT host) AS sites, count(DISTINCT url) AS affected_pages, CAST(sum(n) AS BIGINT) AS total FROM (SELECT name, host, url, count(*) OVER (PARTITION BY name, host, url) / count(*) OVER (PARTITION BY name, host, url) AS n FROM (SELECT DISTINCT name, host, url FROM hs)) GROUP BY 1")
def a_domain_rollup(spark, sf_dir):
    return reports.domain_rollup(issues_of(spark, sf_dir)).select("name", "sites", "affected_pages", "total")


def _served(url: str):
    """What the made-up hosts of src_http_fetch answer: by the number in the path."""
    n = int(url.rsplit("/", 1)[1])
    if n >= 10_000_000:
        return 200, {"Content-Type": "text/html"}, b"arrived"
    if n % 7 == 1:
        return 301, {"Location": f"/{n + 10_000_000}"}, b""
    if n % 7 == 2:
        return 302, {"location": f"/{n}"}, b""
    if n % 7 == 3:
        raise OSError("timed out")
    if n % 7 == 4:
        return 404, {}, b"x" * 70_000
    if n % 7 == 5:
        return 200, {"CONTENT-TYPE": "image/png"}, b"bytes"
    return 200, {"X-Kind": "page"}, b"ok"


@query("""SELECT page_id, [200, 200, 311, 0, 404, 200, 200][page_id % 7 + 1] AS status, [2, 7, 0, 0, 65536, 0, 2][page_id % 7 + 1] AS n_chars, CASE WHEN page_id % 7 IN (1, 2) THEN 2 ELSE 1 END AS n_chain, CASE page_id % 7 WHEN 1 THEN 301 WHEN 2 THEN 302 ELSE 0 END AS redirect_code, page_id % 7 IN (0, 6) AS kind FROM pages""")
def src_http_fetch(spark, sf_dir):
    """Redirects, circles, failures, long errors and binary bodies, from a function in the place of the network."""
    urls = site.table(spark, sf_dir, "pages").select(F.concat(F.lit("https://made.example/"), F.col("page_id").cast("string")).alias("url"))
    f = fetch.fetched(urls, _served)
    return f.select(F.substring_index("url", "/", -1).cast("long").alias("page_id"), "status", F.length("body").alias("n_chars"), F.size("chain").alias("n_chain"), F.coalesce("redirect_code", F.lit(0)).alias("redirect_code"), F.try_element_at("headers", F.lit("x-kind")).isNotNull().alias("kind"))


@query("SELECT p_partkey, '<!doctype html><html><head><title>' || p_name || '</title></head><body><h1>' || p_name || '</h1><article><h2>' || p_brand || '</h2><a href=\"https://x.org/?a=1&amp;b=2\">https://x.org/?a=1&amp;b=2</a><p>&lt;' || p_type || '></p></article></body></html>' AS html FROM part")
def src_agent_reach(spark, sf_dir):
    items = F.array(F.struct(F.col("p_brand").alias("title"), F.lit("https://x.org/?a=1&b=2").alias("url"), F.concat(F.lit("<"), "p_type", F.lit(">")).alias("text")))
    return site.table(spark, sf_dir, "part").select("p_partkey", fetch.synthesized(F.col("p_name"), items).alias("html"))


@query("SELECT page_id, 'hreflang_missing_return' AS issue_id FROM pages WHERE page_id % 4 = 0")
def udf_hreflang_seam(spark, sf_dir):
    """The audit over alternates of a caller's own, here of a sitemap: each page has a German one, and every fourth German page doesn't lead back."""
    i = F.col("page_id")
    p = site.table(spark, sf_dir, "pages").select("page_id")
    en, de = (F.concat(F.lit(f"https://s.org/{x}/"), i.cast("string")) for x in ("en", "de"))
    row = lambda own, lang, to: F.struct(own.alias("url"), F.lit(lang).alias("lang"), to.alias("href"), to.alias("target"))
    all_ = F.array(row(en, "en", en), row(en, "de", de), row(de, "de", de), row(de, "x-default", de), row(en, "x-default", en), F.when(i % 4 != 0, row(de, "en", en)))
    alternates = p.select(F.explode(F.array_compact(all_)).alias("a")).select("a.*")
    pages = p.select(F.explode(F.array(en, de)).alias("url")).select("url", F.lit(200).alias("status"), F.lit(True).alias("indexable"))
    found = audit.hreflang_issues(alternates, pages).where("issue_id = 'hreflang_missing_return'")
    return found.select(F.substring_index("url", "/", -1).cast("long").alias("page_id"), "issue_id")
