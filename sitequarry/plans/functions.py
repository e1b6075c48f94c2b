"""Queries over URL, text, number and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.functions import dates
from sitequarry.functions import text as t
from sitequarry.functions import url as u
from sitequarry.functions.common import half_up
from sitequarry.operators import store as s
from sitequarry.plans.registry import SITE, norm_sql, query
from sitequarry.plans.store import pages_of
from sitequarry.sources import site

TRACK = ", ".join(f"'{x}'" for x in u.TRACKING)
CAND = ", ".join(f"'{x}'" for x in u.CANDIDATE_TRACKING)
PATH = "(CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END)"
QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
ORIGIN = "lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1))"
HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '')"
P2 = f"regexp_replace({PATH}, '/{{2,}}', '/', 'g')"
P3 = f"CASE WHEN length({P2}) > 1 THEN regexp_replace({P2}, '/$', '') ELSE {P2} END"


def _urls(spark, sf_dir):
    return site.table(spark, sf_dir, "pages").select("page_id", "url")


@query(f"SELECT page_id, {norm_sql('url')} AS norm FROM pages")
def url_normalize(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.normalize(F.col("url")).alias("norm"))


@query(f"SELECT page_id, lower({ORIGIN} || CASE WHEN length({PATH}) > 1 THEN regexp_replace({PATH}, '/$', '') ELSE {PATH} END) AS norm FROM pages")
def url_normalize_compare(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.normalize_for_compare(F.col("url")).alias("norm"))


@query(f"SELECT page_id, lower({ORIGIN} || CASE WHEN length({PATH}) > 1 THEN regexp_replace({PATH}, '/$', '') ELSE {PATH} END) || regexp_extract(url, '(\\?[^#]*)', 1) AS norm FROM pages")
def url_norm_hreflang(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.normalize_hreflang(F.col("url")).alias("norm"))


@query(f"""WITH q AS (SELECT page_id, {ORIGIN} || lower({P3}) AS base, list_filter(string_split({QUERY}, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ({TRACK})) AS ps FROM pages)
SELECT page_id, base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_sort(ps), '&') ELSE '' END AS clean FROM q""")
def url_clean(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.clean(F.col("url")).alias("clean"))


@query(f"""WITH q AS (SELECT page_id, {ORIGIN} || {PATH} AS base, list_filter(string_split({QUERY}, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ({CAND})) AS ps FROM pages)
SELECT page_id, base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS candidate FROM q""")
def url_candidate(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.candidate(F.col("url")).alias("candidate"))


@query(f"SELECT page_id, {HOST} AS root FROM pages")
def url_root_domain(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.root_domain(F.col("url")).alias("root"))


@query(f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host(spark, sf_dir):
    return _urls(spark, sf_dir).groupBy(u.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'medium.com' WHEN 1 THEN 'x.example.com' ELSE 'dev.to' END AS publisher FROM part")
def url_publisher_key(spark, sf_dir):
    i = F.col("p_partkey")
    made = F.when(i % 3 == 0, F.concat(F.lit("https://u"), i.cast("string"), F.lit(".medium.com/a"))).when(i % 3 == 1, "https://www.x.example.com/").otherwise("http://dev.to/x")
    return site.table(spark, sf_dir, "part").select("p_partkey", u.publisher(made).alias("publisher"))


@query(f"SELECT page_id, {ORIGIN} = lower(regexp_extract(lead_url, '^([A-Za-z]+://[^/?#]*)', 1)) AS same FROM (SELECT page_id, url, first_value(url) OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS lead_url FROM pages)")
def url_same_origin(spark, sf_dir):
    from pyspark.sql import Window as W

    first = F.first("url").over(W.partitionBy(F.col("page_id") % 5).orderBy("page_id").rowsBetween(W.unboundedPreceding, 0))
    return _urls(spark, sf_dir).withColumn("other", first).select("page_id", u.same_origin(F.col("url"), F.col("other")).alias("same"))


@query(f"WITH {SITE} SELECT page_id, pos, regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]*)', 1) || href AS target FROM h WHERE starts_with(href, '/')")
def url_resolve(spark, sf_dir):
    raw = site.table(spark, sf_dir, "pages")
    found = raw.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), 1)).alias("pos", "href")).where(F.col("href").startswith("/"))
    return found.select("page_id", F.col("pos").cast("int").alias("pos"), u.resolve(F.col("url"), F.col("href")).alias("target"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'http://localhost:1/' || substr(url, 11) ELSE url END AS moved FROM pages")
def url_to_crawl_origin(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.to_crawl_origin(F.col("url"), "https://m.", "http://localhost:1/").alias("moved"))


@query("SELECT page_id, md5(replace(html, 'track(', 'noop(')) AS digest FROM pages")
def url_production_rewrite(spark, sf_dir):
    return site.table(spark, sf_dir, "pages").select("page_id", F.md5(u.production_rewrite(F.col("html"), "track(", "noop(").cast("binary")).alias("digest"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS trap FROM orders")
def url_is_trap(spark, sf_dir):
    i = F.col("o_orderkey")
    made = F.when(i % 4 == 0, "https://x.com/shop/shoes/shop/shoes/shop/shoes").when(i % 4 == 1, F.concat(F.lit("https://x.com/a/b/c/a/b/c/"), i.cast("string"))).when(i % 4 == 2, "https://x.com/a/b/c/d/e/f").otherwise("https://x.com/a/a")
    return site.table(spark, sf_dir, "orders").select("o_orderkey", u.is_trap(made).alias("trap"))


@query(f"""SELECT page_id, length(url) AS url_length, length(url) > 115 AS over_length, regexp_matches(url, '[^\\x00-\\x7F]') AS non_ascii, contains({PATH}, '_') AS underscore, regexp_matches({PATH}, '[A-Z]') AS uppercase,
 CASE WHEN {QUERY} = '' THEN 0 ELSE len(string_split({QUERY}, '&')) END AS param_count, regexp_matches(url, '(?i)[?&](?:utm_[a-z]+|gclid|fbclid|msclkid|yclid|dclid|wbraid|gbraid)=[^&]*') AS session_id,
 false AS duplicate_path, contains({PATH}, '//') AS double_slash, false AS trailing_dot FROM pages""")
def url_hygiene(spark, sf_dir):
    return _urls(spark, sf_dir).withColumns(u.hygiene(F.col("url"))).drop("url")


@query("SELECT page_id, regexp_matches(url, '^https?://[^\\s/?#@]+') AS valid FROM pages")
def url_is_valid_http(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", u.is_valid_http(F.col("url")).alias("valid"))


DOCS = "documents"
NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _docs(spark, sf_dir):
    return site.table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, md5({NORM}) AS digest FROM documents")
def txt_normalise_dup(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.normalise_duplicate(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, sha256({NORM}) AS fingerprint FROM documents")
def txt_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"""WITH w AS (SELECT doc_id, string_split({NORM}, ' ') AS ws FROM documents)
SELECT doc_id, CAST(CASE WHEN len(ws) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))) END AS BIGINT) AS n FROM w""")
def txt_shingles(spark, sf_dir):
    ws = F.split(t.normalise_duplicate(F.col("text")), " ")
    return _docs(spark, sf_dir).select("doc_id", F.size(t.shingles(ws)).cast("long").alias("n"))


@query("SELECT c_custkey, hash FROM (SELECT c_custkey, list_reduce([CAST(2166136261 AS HUGEINT)] || list_transform(string_split(c_mktsegment, ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS hash FROM customer)")
def hash_fnv1a32(spark, sf_dir):
    return site.table(spark, sf_dir, "customer").select("c_custkey", t.fnv1a32(F.col("c_mktsegment")).alias("hash"))


@query("SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INTEGER) AS distance FROM events")
def bit_hamming(spark, sf_dir):
    return site.table(spark, sf_dir, "events").select("event_id", t.hamming(F.col("event_id"), F.col("user_id")).alias("distance"))


@query("""WITH x AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn), ' ')) AS b FROM conversations)
SELECT conv_id, turn, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(a || b)), 6) AS jaccard FROM x""")
def txt_jaccard(spark, sf_dir):
    from pyspark.sql import Window as W

    before = F.lag("text", 1, "").over(W.partitionBy("conv_id").orderBy("turn"))
    sets = site.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("a"), F.array_distinct(F.split(before, " ")).alias("b"))
    return sets.select("conv_id", "turn", F.round(t.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents")
def txt_count_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.count_words(F.col("text")).alias("n"))


def _syllables(w: str) -> str:
    low = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    cut = f"regexp_replace({low}, '(?:[^laeiouy]|ed|es|e)$', '')"
    return f"CASE WHEN {low} = '' THEN 0 WHEN length({low}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(CASE WHEN {cut} = '' THEN {low} ELSE {cut} END, '[aeiouy]+'))) END"


@query(f"SELECT doc_id, CAST({_syllables("string_split(text, ' ')[1]")} AS BIGINT) AS n FROM documents")
def txt_syllables(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.syllables(F.get(F.split("text", " "), F.lit(0))).cast("long").alias("n"))


READ = f"""r AS (SELECT doc_id, greatest(1, len(list_filter(string_split_regex(trim(text), '[.!?]+'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> ''))) AS ns,
  list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda x: regexp_replace(x, '[^a-zA-Z0-9''-]', '', 'g')), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT doc_id, ns, greatest(1, len(ws)) AS nw, coalesce(list_sum(list_transform(ws, lambda w: {_syllables('w')})), 0) AS nsyl FROM r)"""


@query(f"""WITH {READ} SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(ns AS BIGINT) AS n_sentences, CAST(nsyl AS BIGINT) AS n_syllables,
  floor(greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (nw::DOUBLE / ns) - 84.6::DOUBLE * (nsyl::DOUBLE / nw))) * 10 + 0.5) / 10.0 AS ease,
  floor(greatest(0.0, 0.39::DOUBLE * (nw::DOUBLE / ns) + 11.8::DOUBLE * (nsyl::DOUBLE / nw) - 15.59::DOUBLE) * 10 + 0.5) / 10.0 AS grade, CAST(greatest(1, ceil(nw / 200.0)) AS BIGINT) AS minutes FROM m""")
def txt_readability(spark, sf_dir):
    made = _docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in t.readability(F.col("text")).items()])
    w, n, y = F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")
    return made.withColumns({"ease": t.reading_ease(w, n, y), "grade": t.grade(w, n, y), "minutes": F.greatest(F.lit(1), F.ceil(w / 200)).cast("long")})


STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in t.STOP_WORDS)


@query(f"""WITH k AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+')) AS ts FROM documents),
g AS (SELECT doc_id, len(ts) AS total, unnest(list_filter(list_transform(range(1, greatest(len(ts), 1)), lambda i: ts[i:i+1]), lambda r: len(r) = 2 AND r[1] NOT IN ({STOP}) AND r[2] NOT IN ({STOP}))) AS r FROM k)
SELECT doc_id, array_to_string(r, ' ') AS phrase, count(*) AS n, floor(count(*) * 2.0::DOUBLE / any_value(total) * 10000 + 0.5) / 100.0 AS density FROM g GROUP BY doc_id, r HAVING count(*) >= 2""")
def a_ngram_counts(spark, sf_dir):
    k = _docs(spark, sf_dir).select("doc_id", t.keyword_tokens(F.col("text")).alias("ts"))
    g = k.select("doc_id", F.size("ts").alias("total"), F.explode(t.ngrams(F.col("ts"), 2)).alias("phrase")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    return g.where("n >= 2").select("doc_id", "phrase", "n", half_up(F.col("n") * 2 / F.col("total") * 100, 2).alias("density"))


@query(f"""WITH k AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({STOP})) AS ts FROM documents)
SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, CAST(len(list_distinct(ts)) AS BIGINT) AS different FROM k""")
def txt_ngrams(spark, sf_dir):
    g = _docs(spark, sf_dir).select("doc_id", t.ngrams(t.keyword_tokens(F.col("text")), 1).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.size(F.array_distinct("g")).cast("long").alias("different"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\\bthe\\b')) AS BIGINT) AS n, contains(lower(text), 'the') AS present,
 floor(len(regexp_extract_all(lower(text), '\\bthe\\b')) / greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::DOUBLE * 10000 + 0.5) / 100.0 AS density FROM documents""")
def txt_target_keyword(spark, sf_dir):
    low = F.lower("text")
    n = F.regexp_count(low, F.lit(r"\bthe\b"))
    return _docs(spark, sf_dir).select("doc_id", n.cast("long").alias("n"), low.contains("the").alias("present"), half_up(n / F.greatest(F.lit(1), t.count_words(F.col("text"))) * 100, 2).alias("density"))


@query("SELECT c_custkey, CAST(floor(list_sum(list_transform(string_split(c_name, ''), lambda c: CASE WHEN contains('ijlI.,:;!|'' \".', c) THEN 0.32::DOUBLE WHEN contains('mwMW@#%&', c) THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END)) * 20 + 0.5) AS BIGINT) AS px FROM customer")
def txt_pixel_width(spark, sf_dir):
    return site.table(spark, sf_dir, "customer").select("c_custkey", t.pixel_width(F.col("c_name"), 20).alias("px"))


ISTOP = ", ".join(f"'{w}'" for w in t.INTENT_STOP_WORDS)
TOKENS = f"list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(title || ' ' || h1 || ' ' || string_split(url, '/')[-1]), '[^a-z0-9\\s-]', ' ', 'g'), '[-_]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({ISTOP}))))"


@query(f"WITH {SITE} SELECT page_id, array_to_string({TOKENS}, ' ') AS tokens FROM p")
def txt_intent_tokens(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", F.array_join(F.array_sort(t.intent_tokens(F.col("title"), F.col("h1"), F.col("url"))), " ").alias("tokens"))


def _hits(q: str, triggers: list[str], worth: int) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({q}, '{x}') THEN {worth} ELSE 0 END" for x in triggers) + ")"


KEYWORD = "(CASE p_partkey % 5 WHEN 0 THEN 'how to use ' || lower(p_name) || ' at home' WHEN 1 THEN 'best ' || lower(p_name) WHEN 2 THEN 'buy cheap ' || lower(p_type) WHEN 3 THEN lower(p_brand) || ' login' ELSE lower(p_name) END)"
INTENT = f"""q AS (SELECT p_partkey, {KEYWORD} AS q FROM part), sc AS (SELECT p_partkey, q, {_hits('q', t.INFORMATIONAL, 30)} AS i0, {_hits('q', t.COMMERCIAL, 35)} AS c0, {_hits('q', t.TRANSACTIONAL, 35)} AS t0, {_hits('q', t.NAVIGATIONAL, 40)} AS n0, len(string_split_regex(q, '\\s+')) AS nw FROM q),
s2 AS (SELECT *, CASE WHEN i0 + c0 + t0 + n0 = 0 THEN 40 WHEN nw >= 5 AND i0 > 0 THEN i0 + 25 ELSE i0 END AS i1 FROM sc),
s3 AS (SELECT *, list_sort([{{'m': -i1, 'k': 0, 'n': 'informational'}}, {{'m': -c0, 'k': 1, 'n': 'commercial'}}, {{'m': -t0, 'k': 2, 'n': 'transactional'}}, {{'m': -n0, 'k': 3, 'n': 'navigational'}}]) AS r FROM s2),
s4 AS (SELECT *, r[1].n AS primary_intent, CASE WHEN -r[2].m > 20 THEN r[2].n ELSE '' END AS secondary, least(98, floor(-r[1].m::DOUBLE / greatest(1, -r[1].m + CASE WHEN -r[2].m > 20 THEN -r[2].m ELSE 0 END) * 100 + 0.5)) AS confidence FROM s3)"""


def _keywords(spark, sf_dir):
    i = F.col("p_partkey") % 5
    made = F.when(i == 0, F.concat(F.lit("how to use "), F.lower("p_name"), F.lit(" at home"))).when(i == 1, F.concat(F.lit("best "), F.lower("p_name"))).when(i == 2, F.concat(F.lit("buy cheap "), F.lower("p_type"))).when(i == 3, F.concat(F.lower("p_brand"), F.lit(" login"))).otherwise(F.lower("p_name"))
    return site.table(spark, sf_dir, "part").select("p_partkey", made.alias("q"))


@query(f"WITH {INTENT} SELECT p_partkey, primary_intent, secondary, CAST(confidence AS BIGINT) AS confidence FROM s4")
def txt_intent(spark, sf_dir):
    made = _keywords(spark, sf_dir).withColumn("i", t.intent(F.col("q")))
    return made.select("p_partkey", F.col("i.primary").alias("primary_intent"), F.coalesce("i.secondary", F.lit("")).alias("secondary"), "i.confidence")


KD = "greatest(5, least(98, CASE nw WHEN 1 THEN 85 WHEN 2 THEN 65 WHEN 3 THEN 42 ELSE 22 END + CASE WHEN primary_intent = 'transactional' THEN 14 WHEN primary_intent = 'commercial' THEN 8 WHEN primary_intent = 'informational' AND nw >= 4 THEN -10 ELSE 0 END))"


@query(f"""WITH {INTENT}, d AS (SELECT p_partkey, {KD} AS score FROM s4) SELECT p_partkey, CAST(score AS BIGINT) AS score, CASE WHEN score <= 20 THEN 'Very Easy' WHEN score <= 40 THEN 'Easy' WHEN score <= 60 THEN 'Medium' WHEN score <= 80 THEN 'Hard' ELSE 'Super Hard' END AS tier,
 CAST(floor(score * CASE WHEN score <= 15 THEN 0.0 WHEN score <= 30 THEN 0.2 WHEN score <= 50 THEN 0.5 WHEN score <= 75 THEN 1.2 ELSE 2.5 END + 0.5) AS BIGINT) AS domains FROM d""")
def txt_keyword_difficulty(spark, sf_dir):
    made = _keywords(spark, sf_dir).select("p_partkey", t.difficulty(F.col("q"), t.intent(F.col("q"))["primary"]).alias("score"))
    return made.select("p_partkey", "score", t.difficulty_tier(F.col("score")).alias("tier"), t.referring_domains(F.col("score")).alias("domains"))


@query("SELECT p_partkey, kind, count(*) AS n, string_agg(k, ';' ORDER BY k) AS keywords FROM (SELECT p_partkey, unnest(['question','question','question','question','question','commercial','commercial','commercial','commercial','long_tail','long_tail','long_tail','long_tail']) AS kind, replace(unnest(['How to use % effectively','What is % and how does it work','Why is % important for SEO','When should you implement %','Is % worth the investment','Best % tools and software','% vs alternatives comparison','Top rated % platforms','Free vs paid % options','% complete guide for beginners','% best practices and checklist','Automated % workflow','% step by step tutorial']), '%', p_name) AS k FROM part) GROUP BY 1, 2")
def txt_keyword_variations(spark, sf_dir):
    made = site.table(spark, sf_dir, "part").select("p_partkey", F.explode(t.variations(F.col("p_name"))).alias("v"))
    return made.groupBy("p_partkey", F.col("v.kind").alias("kind")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("v.keyword")), ";").alias("keywords"))


GENERIC = ", ".join(f"'{x}'" for x in t.GENERIC_ANCHORS)
ANCHOR = f"""CASE WHEN lower(trim(anchor)) IN ('', '(empty)', '[image]') THEN 'empty_image' WHEN regexp_matches(lower(trim(anchor)), '^(https?://|www\\.|/)') THEN 'naked_url'
  WHEN lower(trim(anchor)) IN ({GENERIC}) THEN 'generic' WHEN contains(lower(trim(anchor)), 'the') THEN 'branded' WHEN lower(trim(anchor)) = 'from ereing' THEN 'exact_match' WHEN contains(lower(trim(anchor)), 'from') OR contains(lower(trim(anchor)), 'ereing') THEN 'partial_match' ELSE 'branded' END"""


@query(f"WITH {SITE} SELECT page_id, pos, {ANCHOR} AS kind FROM l")
def txt_anchor_class(spark, sf_dir):
    return site.links(site.table(spark, sf_dir, "pages")).select("page_id", "pos", t.anchor_class(F.col("anchor"), "the", ["from ereing"]).alias("kind"))


@query(f"""WITH {SITE}, s AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '404 - Page not found' WHEN 1 THEN '' ELSE title END AS title, CASE page_id % 4 WHEN 0 THEN 'Not found' WHEN 1 THEN '' ELSE h1 END AS h1, CASE page_id % 8 WHEN 1 THEN 'this page was removed' WHEN 5 THEN 'ok' ELSE body END AS body FROM p)
SELECT page_id, CASE WHEN nw >= 300 AND NOT thin THEN base * 0.5 ELSE base * 1.0 END::DOUBLE AS score FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 85 ELSE 0 END + CASE WHEN page_id % 8 = 1 THEN 30 WHEN page_id % 8 = 5 THEN 25 WHEN page_id % 4 <> 1 AND nw < 60 AND (contains(lower(body), 'not found') OR contains(lower(body), 'removed') OR contains(lower(body), 'error') OR contains(lower(body), 'expired')) THEN 30 ELSE 0 END AS base, page_id % 8 = 1 AS thin, nw
 FROM (SELECT *, len(list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '')) AS nw FROM s))""")
def txt_soft404(spark, sf_dir):
    i = F.col("page_id")
    s_ = pages_of(spark, sf_dir).select("page_id", "url", F.when(i % 4 == 0, "404 - Page not found").when(i % 4 == 1, "").otherwise(F.col("title")).alias("title"), F.when(i % 4 == 0, "Not found").when(i % 4 == 1, "").otherwise(F.col("h1")).alias("h1"), F.when(i % 8 == 1, "this page was removed").when(i % 8 == 5, "ok").otherwise(F.col("body")).alias("body"))
    return s_.select("page_id", t.soft404_score(F.lit(200), F.col("url"), F.col("title"), F.col("h1"), F.col("body"), t.count_words(F.col("body")), F.lit("")).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(floor(95 * pow(0.85::DOUBLE, o_orderkey % 5) + 0.5) AS BIGINT) END AS retention FROM orders")
def math_equity_retention(spark, sf_dir):
    i = F.col("o_orderkey")
    return site.table(spark, sf_dir, "orders").select("o_orderkey", t.equity_retention(i % 5 + 1, i % 9 == 0).alias("retention"))


@query("SELECT p_partkey, CASE WHEN p_size <= 3 THEN 1.0 WHEN p_size <= 5 THEN 0.95 WHEN p_size <= 10 THEN 0.85 WHEN p_size <= 20 THEN 0.25 ELSE 0.05 END::DOUBLE AS visibility FROM part")
def math_visibility(spark, sf_dir):
    return site.table(spark, sf_dir, "part").select("p_partkey", t.visibility(F.col("p_size")).alias("visibility"))


@query("SELECT p_partkey, round(CASE WHEN p_size > 10 THEN -1 ELSE p_retailprice / CASE WHEN p_size <= 3 THEN 1.0 WHEN p_size <= 5 THEN 0.95 ELSE 0.85 END * 30 / 28 END, 4) AS monthly FROM part")
def math_monthly_gsc(spark, sf_dir):
    v = t.monthly_from_console(F.col("p_retailprice"), F.col("p_size"), F.lit(28))
    return site.table(spark, sf_dir, "part").select("p_partkey", F.round(F.coalesce(v, F.lit(-1.0)), 4).alias("monthly"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size >= 10 THEN 'Critical' ELSE 'High' END WHEN p_size % 3 = 1 THEN CASE WHEN p_size >= 10 THEN 'High' ELSE 'Medium' END ELSE 'Low' END AS priority, 3 - p_size % 3 AS weight FROM part")
def math_priority(spark, sf_dir):
    sev = F.when(F.col("p_size") % 3 == 0, "Error").when(F.col("p_size") % 3 == 1, "Warning").otherwise("Notice")
    return site.table(spark, sf_dir, "part").select("p_partkey", t.priority(sev, F.col("p_size")).alias("priority"), t.severity_weight(sev).alias("weight"))


@query("SELECT c_custkey, floor(c_acctbal + 0.5) / 1.0 AS r0, floor(c_acctbal * 10 + 0.5) / 10.0 AS r1 FROM customer")
def math_round(spark, sf_dir):
    return site.table(spark, sf_dir, "customer").select("c_custkey", half_up(F.col("c_acctbal")).alias("r0"), half_up(F.col("c_acctbal"), 1).alias("r1"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n <= 20 THEN 'Very Easy' WHEN n <= 40 THEN 'Easy' ELSE 'Medium' END AS tier FROM (SELECT l_orderkey, l_linenumber, l_quantity AS n FROM lineitem)")
def math_tiers(spark, sf_dir):
    return site.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.difficulty_tier(F.col("l_quantity")).alias("tier"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS later, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01') AS days, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01') BETWEEN 0 AND 90 AS fresh FROM orders")
def date_add_days(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    today = F.lit("1996-01-01").cast("date")
    return site.table(spark, sf_dir, "orders").select("o_orderkey", dates.add_days(day, 7).alias("later"), dates.days_between(day, today).alias("days"), dates.fresh(day, today).alias("fresh"))


@query("SELECT o_orderkey, CAST(h AS INTEGER) AS h, strftime(CAST(o_orderdate AS DATE) + CAST(7 * h AS INTEGER), '%Y-%m-%d') AS due FROM (SELECT o_orderkey, o_orderdate, unnest(range(1, 4)) AS h FROM orders)")
def date_project(spark, sf_dir):
    o = site.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("h"))
    return o.select("o_orderkey", "h", dates.add_days(F.col("day"), F.col("h") * 7).alias("due"))


@query("SELECT 'daily' AS freq, 7 AS period UNION ALL SELECT 'weekly', 4 UNION ALL SELECT 'monthly', 12 UNION ALL SELECT 'crawl', 1")
def t_freq(spark, sf_dir):
    from sitequarry.operators.forecast import PERIODS

    return spark.createDataFrame(list(PERIODS.items()), "freq string, period int")


@query("SELECT c_custkey, replace(replace('Why {Topic} matters to {audience}', '{Topic}', upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2)), '{audience}', c_name) AS line FROM customer")
def txt_interpolate(spark, sf_dir):
    topic = F.lower("c_mktsegment")
    line = F.replace(F.replace(F.lit("Why {Topic} matters to {audience}"), F.lit("{Topic}"), F.concat(F.upper(F.substring(topic, 1, 1)), F.substring(topic, 2, 100))), F.lit("{audience}"), F.col("c_name"))
    return site.table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


@query("SELECT doc_id, CASE WHEN contains(text, '\"') OR contains(text, ',') OR contains(text, chr(10)) THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell, replace(replace(text, '|', '\\|'), chr(10), ' ') AS md, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents")
def txt_csv_escape(spark, sf_dir):
    c = h = F.col("text")
    quoted = F.when(c.contains('"') | c.contains(",") | c.contains("\n"), F.concat(F.lit('"'), F.replace(h, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(h)
    md = F.replace(F.replace(h, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    html = F.replace(F.replace(F.replace(h, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _docs(spark, sf_dir).select("doc_id", quoted.alias("cell"), md.alias("md"), html.alias("html"))


@query("SELECT doc_id, CASE WHEN i = 0 THEN '' ELSE (CASE WHEN i > 51 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, CAST(greatest(1, i - 50) AS BIGINT), CAST(least(50, i - 1) + 3 + 50 AS BIGINT)), '\\s+', ' ', 'g')) || (CASE WHEN i + 52 < length(text) THEN '…' ELSE '' END) END AS snippet FROM (SELECT doc_id, text, instr(text, 'the') AS i FROM documents)")
def txt_snippet(spark, sf_dir):
    i = F.instr("text", "the")
    cut = F.trim(F.regexp_replace(F.substr("text", F.greatest(F.lit(1), i - 50), F.least(F.lit(50), i - 1) + 53), r"\s+", " "))
    line = F.concat(F.when(i > 51, "…").otherwise(""), cut, F.when(i + 52 < F.length("text"), "…").otherwise(""))
    return _docs(spark, sf_dir).select("doc_id", F.when(i == 0, "").otherwise(line).alias("snippet"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '(?:^|[^\\w])(the)(?:$|[^\\w])')) > 0 AS BOOLEAN) AS mentioned FROM documents")
def txt_mentions(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.lower("text").rlike(r"(?<!\w)the(?!\w)").alias("mentioned"))


@query("SELECT event_id, map_extract(MAP {lower(event_type): CAST(value AS VARCHAR), 'host': 'x'}, 'click')[1] IS NOT NULL AS has_click FROM events")
def map_headers(spark, sf_dir):
    m = F.create_map(F.lower("event_type"), F.col("value").cast("string"), F.lit("host"), F.lit("x"))
    return site.table(spark, sf_dir, "events").select("event_id", F.try_element_at(m, F.lit("click")).isNotNull().alias("has_click"))


@query("SELECT p_partkey, list_bool_or(list_transform(range(1, len(s)), lambda i: s[i] = s[i+1])) IS TRUE AS adjacent FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || split_part(p_name, ' ', CAST(1 + p_partkey % 2 AS BIGINT)) || ' ' || p_type), ' ') AS s FROM part)")
def w_adjacent_dup(spark, sf_dir):
    made = F.split(F.lower(F.concat_ws(" ", "p_name", F.split_part(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 2 + 1).cast("int")), "p_type")), " ")
    same = F.exists(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: (i < F.size("s")) & (F.get("s", i) == F.get("s", i - 1)))
    return site.table(spark, sf_dir, "part").select("p_partkey", made.alias("s")).select("p_partkey", same.alias("adjacent"))
