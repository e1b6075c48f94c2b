"""Queries over content, failures, volumes, opportunities and generated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions.common import half_up_int
from sitequarry.operators import content, html, similarity
from sitequarry.operators.shared import cut
from sitequarry.plans.functions import INTENT, NORM, _keywords
from sitequarry.plans.registry import SITE, query
from sitequarry.plans.store import ISSUES, issues_of, pages_of
from sitequarry.sources import site

LIVE = """w AS (SELECT doc_id, text, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws, greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''))) AS ns FROM documents),
m AS (SELECT doc_id, text, ws, len(ws) AS n, ns, coalesce(list_sum(list_transform(ws, lambda x: CASE WHEN len(regexp_extract_all(regexp_replace(x, 'e$', ''), '[aeiouy]{1,2}')) > 0 THEN len(regexp_extract_all(regexp_replace(x, 'e$', ''), '[aeiouy]{1,2}')) ELSE 1 END)), 0) AS sy FROM w),
r AS (SELECT *, CAST(greatest(0.0, least(100.0, floor(206.835::DOUBLE - 1.015::DOUBLE * (floor(n::DOUBLE / ns * 10 + 0.5) / 10.0) - 84.6::DOUBLE * (CASE WHEN n > 0 THEN sy::DOUBLE / n ELSE 1.0 END) + 0.5))) AS BIGINT) AS ease FROM m)"""


@query(f"WITH {LIVE} SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(ns AS BIGINT) AS n_sentences, CAST(sy AS BIGINT) AS n_syllables, ease FROM r")
def txt_readability_live(spark, sf_dir):
    d = site.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.withColumns(content.live_readability(F.col("text"))).drop("text")
    return d.withColumn("ease", content.live_ease(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")))


@query(f"""WITH {LIVE}, k AS (SELECT doc_id, text, n, ease, regexp_extract_all(text, '(?m)^#\\s+(.+)$', 1) AS h1, regexp_extract_all(text, '(?m)^##\\s+(.+)$', 1) AS h2, regexp_extract_all(text, '(?m)^###\\s+(.+)$', 1) AS h3, len(regexp_extract_all(lower(text), '\\bthat\\b')) AS hits, contains(array_to_string(ws[1:100], ' '), 'that') AS intro FROM r),
d AS (SELECT *, CASE WHEN n > 0 THEN floor(hits::DOUBLE / n * 100 * 10 + 0.5) / 10.0 ELSE 0 END AS density FROM k)
SELECT doc_id, CAST(least(100, CASE WHEN intro THEN 7 ELSE 0 END + CASE WHEN list_bool_or(list_transform(h1, lambda x: contains(lower(x), 'that'))) THEN 8 ELSE 0 END + CASE WHEN list_bool_or(list_transform(h1 || h2 || h3, lambda x: contains(lower(x), 'that'))) THEN 4 ELSE 0 END + CASE WHEN len(h1) = 1 AND (len(h3) = 0 OR len(h2) > 0) THEN 10 WHEN len(h1) = 0 THEN 0 ELSE 5 END + CASE WHEN density >= 0.5 AND hits > 0 AND density <= 2.8 THEN 8 WHEN hits > 0 AND density <= 2.8 THEN 4 ELSE 0 END + 15 + CASE WHEN n / 1000.0 >= 0.9 THEN 20 ELSE floor(n / 1000.0::DOUBLE * 20 + 0.5) END + CASE WHEN ease BETWEEN 50 AND 80 THEN 10 ELSE 5 END
 + CASE WHEN regexp_matches(text, '(?m)^(\\s*[-*]|\\s*\\d+\\.)\\s+.+') OR regexp_matches(text, '\\|(.+)\\|') THEN 5 ELSE 0 END) AS BIGINT) AS score FROM d""")
def txt_content_score(spark, sf_dir):
    d = site.table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("body"))
    return content.content_score(d, "that").select("doc_id", "score")


@query(f"WITH {INTENT} SELECT p_partkey, CAST(greatest(10, 100 - CASE primary_intent WHEN 'commercial' THEN 25 + CASE WHEN p_partkey % 1000 < 600 THEN 20 ELSE 0 END WHEN 'informational' THEN CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 15 END + CASE WHEN p_partkey % 1000 < 500 THEN 25 ELSE 0 END WHEN 'transactional' THEN 30 ELSE 0 END) AS INTEGER) AS score FROM s4")
def txt_intent_alignment(spark, sf_dir):
    k = F.col("p_partkey")
    q = _keywords(spark, sf_dir).withColumn("i", t.intent(F.col("q"))["primary"])
    return q.select("p_partkey", content.alignment(F.col("i"), k % 1000, F.lit(False), k % 2 == 0, F.lit(False)).cast("int").alias("score"))


@query(f"""WITH {SITE}, k AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(h1, '^[#0-9.:\\s]+', ''), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS h, lower(trim(regexp_replace(regexp_replace(string_split_regex(title, '[|:–-]')[1], '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM p)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN page_id % 3 = 0 THEN 'given word' END, CASE WHEN length(h) >= 4 AND len(string_split(h, ' ')) <= 5 THEN h END, CASE WHEN length(t) >= 4 AND len(string_split(t, ' ')) <= 4 THEN t END, 'phrase one'], lambda x: x IS NOT NULL AND length(x) >= 4))), ',') AS keywords FROM k""")
def txt_target_keywords(spark, sf_dir):
    p = pages_of(spark, sf_dir)
    phrases = F.array(F.lit("Phrase one"), F.lit("two"), F.lit("of"), F.lit("late phrase"))
    found = t.target_keywords(F.when(F.col("page_id") % 3 == 0, " Given word "), F.col("h1"), F.col("title"), phrases)
    return p.select("page_id", F.array_join(F.array_sort(found), ",").alias("keywords"))


@query("""SELECT event_id, coalesce(CASE event_id % 9 WHEN 0 THEN 'connection_timeout' WHEN 1 THEN 'dns_failure' WHEN 2 THEN 'connection_failure' WHEN 3 THEN 'provider_rate_limited' WHEN 4 THEN 'http_access_denied' WHEN 5 THEN 'http_error' WHEN 6 THEN 'robots_unavailable' WHEN 7 THEN 'unknown' END, '') AS class FROM events""")
def txt_failure_class(spark, sf_dir):
    i = F.col("event_id") % 9
    error = F.when(i == 0, "Request timed out").when(i == 1, "getaddrinfo ENOTFOUND x").when(i == 2, "connect ECONNREFUSED").when(i == 6, "robots_fetch_failed").when(i == 7, "odd").otherwise("")
    status = F.when(i == 3, 429).when(i == 4, 403).when(i == 5, 500).when(i == 8, 200).otherwise(0)
    return site.table(spark, sf_dir, "events").select("event_id", F.coalesce(content.failure_class(error, status), F.lit("")).alias("class"))


@query("SELECT p_partkey, least(100, CAST(floor(p_size / 100.0::DOUBLE * 40 + 0.5) AS BIGINT) + CASE WHEN p_partkey % 6 <= 1 THEN 25 WHEN p_partkey % 6 <= 3 THEN 15 ELSE 5 END + CAST(floor((100 - p_partkey % 101) / 100.0::DOUBLE * 25 + 0.5) AS BIGINT) + 10) AS score FROM part")
def math_opportunity(spark, sf_dir):
    k = F.col("p_partkey")
    return site.table(spark, sf_dir, "part").select("p_partkey", content.opportunity(F.col("p_size"), k % 101, k % 6).cast("long").alias("score"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS weight FROM orders")
def math_severity_weight(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return site.table(spark, sf_dir, "orders").select("o_orderkey", t.severity_weight(F.when(k == 0, "Error").when(k == 1, "Warning").otherwise("Notice")).alias("weight"))


@query()
def math_trends_ladder(spark, sf_dir):
    """Interest of parts, relative to the most wanted one, from comparisons of five at a time that give whole percents only."""
    demand = {r.k: float(r.n) for r in site.table(spark, sf_dir, "part").where("p_partkey <= 40").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("k"), F.pow(F.lit(1.25), F.col("p_partkey")).alias("n")).collect()}

    def fetch(words: list[str]) -> list[float]:
        top = max(demand[w] for w in words)
        return [round(100 * demand[w] / top) for w in words]

    found = content.ladder(list(demand), max(demand, key=demand.get), fetch)
    return spark.createDataFrame(sorted(found.items()), "keyword string, relative double")


@query("""WITH k AS (SELECT c_custkey, c_name AS keyword FROM customer), g AS (SELECT c_name AS keyword, c_custkey AS impressions, c_custkey % 12 + 1 AS position, 28 AS days FROM customer WHERE c_custkey % 3 = 0), rel AS (SELECT c_name AS keyword, (c_custkey % 7 + 1) / 4.0::DOUBLE AS rel FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT *, CASE WHEN position > 10 THEN NULL ELSE impressions::DOUBLE / CASE WHEN position <= 3 THEN 1.0 WHEN position <= 5 THEN 0.95 ELSE 0.85 END * 30 / days END AS m FROM g),
s AS (SELECT median(m / rel) AS scale FROM m JOIN rel USING (keyword) WHERE position <= 5 AND m >= 3),
j AS (SELECT k.c_custkey, position, m, rel, scale, coalesce(floor(impressions * 30.0::DOUBLE / days + 0.5), 0) AS low FROM k LEFT JOIN m USING (keyword) LEFT JOIN rel USING (keyword) CROSS JOIN s)
SELECT c_custkey, CASE WHEN position <= 5 THEN 'gsc' WHEN rel IS NULL THEN CASE WHEN low > 0 THEN 'gsc-floor' ELSE 'below-trends-floor' END ELSE 'trends' END AS method,
 CAST(CASE WHEN position <= 5 THEN floor(m + 0.5) WHEN rel IS NOT NULL THEN floor(greatest(rel * scale, low) + 0.5) ELSE -1 END AS BIGINT) AS monthly FROM j""")
def math_estimate_volumes(spark, sf_dir):
    c = site.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    keys = c.select(F.col("c_name").alias("keyword"))
    console = c.where(k % 3 == 0).select(F.col("c_name").alias("query"), k.alias("impressions"), (k % 12 + 1).cast("int").alias("position"), F.lit(28).alias("days"))
    relative = c.where(k % 2 == 0).select(F.col("c_name").alias("keyword"), ((k % 7 + 1) / 4.0).alias("rel"))
    return content.volumes(keys, console, relative).join(c.select(F.col("c_name").alias("keyword"), "c_custkey"), "keyword").select("c_custkey", "method", "monthly")


@query("""WITH s AS (SELECT doc_id AS source, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s''-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents),
tg AS (SELECT * FROM (VALUES (1000, 'of the', 20, 0), (1001, 'and that', 80, 5), (5, 'with the', 50, 2)) v(target, keyword, te, ni)),
h AS (SELECT source, target, min(keyword) AS keyword, any_value(te) AS te, any_value(ni) AS ni FROM s JOIN tg ON list_contains(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), keyword) AND source <> target AND (source + target) % 3 <> 0 GROUP BY 1, 2),
c AS (SELECT *, least(100, CAST(floor((source % 100) / 100.0::DOUBLE * 40 + 0.5) AS BIGINT) + CASE WHEN ni <= 1 THEN 25 WHEN ni <= 3 THEN 15 ELSE 5 END + CAST(floor((100 - te) / 100.0::DOUBLE * 25 + 0.5) AS BIGINT) + 10) AS score FROM h)
SELECT CAST(target AS BIGINT) AS target, source, keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS r FROM c WHERE score >= 20) WHERE r <= 4""")
def j_link_opps(spark, sf_dir):
    d = site.table(spark, sf_dir, "documents")
    sources = d.select(F.col("doc_id").alias("source"), "text", (F.col("doc_id") % 100).alias("equity"))
    targets = spark.createDataFrame([(1000, "of the", 20, 0), (1001, "and that", 80, 5), (5, "with the", 50, 2)], "target long, keyword string, equity int, n_incoming int")
    links = d.select(F.col("doc_id").alias("source"), F.explode(F.array(*[F.lit(x).cast("long") for x in (1000, 1001, 5)])).alias("target")).where("(source + target) % 3 = 0")
    return content.link_opportunities(targets, sources, links).select("target", "source", "keyword", F.col("score").cast("long").alias("score"))


def _long(spark, sf_dir):
    """Normal words of texts of 40 words or more."""
    return site.table(spark, sf_dir, "documents").select("doc_id", F.split(t.normalise_duplicate(F.col("text")), " ").alias("w")).where("size(w) >= 40")


PAIRS = ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in similarity.coefficients())


@query(f"""WITH n AS (SELECT doc_id, string_split({NORM}, ' ') AS ws FROM documents WHERE len(string_split({NORM}, ' ')) >= 40), s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: CAST('0x' || substr(md5(array_to_string(ws[i:i+4], ' ')), 1, 8) AS HUGEINT))) AS h FROM n)
SELECT doc_id, md5(array_to_string(list_transform([{PAIRS}], lambda c: list_min(list_transform(h, lambda x: (c.a * x + c.b) % 4294967296))), ',')) AS digest FROM s""")
def a_minhash(spark, sf_dir):
    """128 minima a text, over 32 bits of md5, which SQL has as well; hash_minhash has them over FNV-1a."""
    low = F.lit(2**32 - 1).cast("long")
    h = cut(_long(spark, sf_dir).select("doc_id", F.transform(t.shingles(F.col("w")), lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")).alias("h")))
    made = F.array(*[F.struct(F.lit(a >> 16).cast("long").alias("high"), F.lit(a & 0xFFFF).cast("long").alias("low"), F.lit(b).cast("long").alias("b")) for a, b in similarity.coefficients()])

    def least(c):
        # a * x + b modulo 2**32 by halves of a, as the whole product doesn't fit a number.
        return F.array_min(F.transform("h", lambda x: (F.shiftleft((c["high"] * x).bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + c["low"] * x + c["b"]).bitwiseAND(low)))

    return h.select("doc_id", F.md5(F.array_join(F.transform(made, least), ",").cast("binary")).alias("digest"))


def _signatures(spark, sf_dir):
    """(doc_id, same, signature); same: a hash of the normal text."""
    return similarity.with_minima(_long(spark, sf_dir).select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("same"), t.shingles(F.col("w")).alias("h")), "h")


@query()
def hash_minhash(spark, sf_dir):
    """128 minima a text, each of one multiply-shift hash: the share that agrees estimates the likeness."""
    return _signatures(spark, sf_dir).select("doc_id", "signature")


@query()
def j_lsh_candidates(spark, sf_dir):
    """Pairs of texts that agree in one of 32 bands of 4 minima, hence all that agree in one of 16 of 8.

    Of equal texts the one of least id is compared; the others make a pair with it.
    """
    sig = cut(_signatures(spark, sf_dir))
    first = sig.groupBy("same").agg(F.min("doc_id").alias("a"))
    copies = sig.select("doc_id", "same").join(first, "same").where("a < doc_id").select("a", F.col("doc_id").alias("other"))
    one = sig.groupBy("same").agg(F.min_by("signature", "doc_id").alias("signature"), F.min("doc_id").alias("doc_id"))
    bands = one.select("doc_id", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.xxhash64(F.slice("signature", 4 * b + 1, 4)).alias("v")) for b in range(similarity.MINIMA // 4)])).alias("k")).select("doc_id", "k.b", "k.v")
    a, b = bands.toDF("a", "b", "v"), bands.toDF("c", "b", "v")
    return a.join(b, ["b", "v"]).where("a < c").select("a", F.col("c").alias("other")).distinct().unionByName(copies)


@query()
def a_simhash_bits(spark, sf_dir):
    return site.table(spark, sf_dir, "documents").select("doc_id", similarity.votes(F.col("text")).alias("votes"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS repeats FROM orders")
def w_repeated_ngram(spark, sf_dir):
    from sitequarry.functions.url import is_trap

    k = F.col("o_orderkey")
    made = F.when(k % 3 == 0, "https://x.com/a/b/a/b").otherwise("https://x.com/a/b/c/d")
    return site.table(spark, sf_dir, "orders").select("o_orderkey", is_trap(made).alias("repeats"))


@query("SELECT page_id, 'WebPage,Organization' AS types FROM pages")
def json_parse_ld(spark, sf_dir):
    page = F.concat(F.lit('<head><script type="application/ld+json">{"@graph":[{"@type":"WebPage","url":"'), F.col("url"), F.lit('"},{"@type":["Organization"]}]}</script></head>'))
    p = site.table(spark, sf_dir, "pages").select("page_id", "url", page.alias("html"))
    return html.extract(p).select("page_id", F.array_join(F.sort_array("types", False), ",").alias("types"))


@query("SELECT page_id, url AS link, CAST(i AS INTEGER) AS item FROM (SELECT page_id, url, unnest([1, 2]) AS i FROM pages)")
def xml_rss_parse(spark, sf_dir):
    feed = F.concat(F.lit("<rss><channel><title>t</title><item><n>1</n><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item><item><n>2</n><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item></channel></rss>"))
    items = F.from_xml(F.col("x"), "channel struct<item array<struct<n:int,link:string>>>")
    return site.table(spark, sf_dir, "pages").select("page_id", feed.alias("x")).select("page_id", F.explode(items["channel"]["item"]).alias("i")).select("page_id", "i.link", F.col("i.n").alias("item"))


@query("SELECT page_id, 'rewrite ^' || regexp_replace(CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') || '$ https://new.example/ permanent;' AS rule FROM pages")
def code_redirect_rules(spark, sf_dir):
    return site.table(spark, sf_dir, "pages").select("page_id", content.redirect_rule(F.col("url"), F.lit("https://new.example/"), "nginx").alias("rule"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'llms_txt_missing' WHEN 1 THEN '' WHEN 2 THEN 'llms_txt_no_h1,llms_txt_no_links,llms_txt_no_summary' ELSE 'llms_txt_content_type,llms_txt_multi_h1,llms_txt_no_summary' END AS findings FROM documents")
def html_llms_txt(spark, sf_dir):
    i = F.col("doc_id") % 4
    body = F.when(i == 1, "# T\n> sum\n[a](b)").when(i == 2, "text").otherwise("# A\n# B\n[a](b)")
    found = content.llms_findings(F.when(i == 0, 404).otherwise(200), body, F.when(i == 3, "text/html").when(i == 1, "text/markdown; charset=utf-8"))
    return site.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("findings"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'missing_security_headers,server_version_exposed' WHEN page_id % 3 = 1 AND starts_with(url, 'https://') THEN 'hsts_weak' ELSE '' END AS findings FROM pages")
def html_security(spark, sf_dir):
    i = F.col("page_id") % 3
    full = {"content-security-policy": "frame-ancestors 'none'", "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "permissions-policy": "x"}
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    headers = F.when(i == 0, m({"server": "nginx/1.25.1"})).when(i == 1, m({**full, "strict-transport-security": "max-age=60"})).otherwise(m({**full, "strict-transport-security": "max-age=63072000; includeSubDomains"}))
    return site.table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(content.security_findings(headers, F.col("url"))), ",").alias("findings"))


@query("SELECT page_id, q.question, q.answer FROM (SELECT page_id, unnest([{'question': 'What is it?', 'answer': 'It is ' || page_id || '.'}, {'question': 'Why?', 'answer': 'Because.'}]) AS q FROM pages)")
def html_faq(spark, sf_dir):
    from sitequarry.plans.crawl import made_pages

    return html.details(made_pages(spark, sf_dir)).select("page_id", F.explode("questions").alias("q")).select("page_id", "q.question", "q.answer")


@query("""SELECT page_id, '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[' || array_to_string(list_prepend('{"@type":"ListItem","position":1,"name":"Home"}', list_transform(s, lambda x, i: '{"@type":"ListItem","position":' || (i + 1) || ',"name":"' || x || '"}')), ',') || ']}' AS ld FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)""")
def gen_schema(spark, sf_dir):
    return site.table(spark, sf_dir, "pages").select("page_id", content.breadcrumb(F.col("url"), "Home").alias("ld"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) > 1 AS limited FROM events")
def st_rate_limit(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.unix_millis(F.col("ts").cast("timestamp"))).rangeBetween(-1000, 0)
    return site.table(spark, sf_dir, "events").select("event_id", (F.count("*").over(w) > 1).alias("limited"))
