"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm import decontaminate, fingerprint, langid, maintext, minhash, mixing, private, repeats, toxicity, urlfilter
from sitequarry.llm.common import held_out, load


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), words=2, threshold=0.8)


OP1_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))
                          WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
          FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80 GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN both_ways b ON r.other = b.a),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, comp.component_id, s.doc_id = comp.component_id AS kept FROM s JOIN comp USING (doc_id)
"""


#: In production a secret from the caller's vault; the registered query must give the same rows in each run.
PRIVATE_KEY = "registered-query"


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return private.pseudonymised(docs, PRIVATE_KEY, counts=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", "n_tokens", "pass", "block", "position")


def _hex(text: str, digits: int) -> str:
    return f"CAST(concat('0x', substr(md5({text}), 1, {digits})) AS BIGINT)"


OP4_SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS BIGINT) AS n_tokens,
             {_hex("'1|' || coalesce(CAST(doc_id AS VARCHAR), '')", 13)} % 1024 AS block FROM documents),
b AS (SELECT s, block, sum(n_tokens) AS t FROM d GROUP BY 1, 2),
tot AS (SELECT s, CAST(sum(t) AS DOUBLE) AS t FROM b GROUP BY 1 HAVING sum(t) > 0),
k AS (SELECT sum(t) AS budget, count(*) AS n FROM tot),
grid AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
         UNION ALL
         SELECT step + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
         FROM (SELECT step, low, high, (
                 SELECT -sum(w * ln(w)) FROM (SELECT r / sum(r) OVER () AS w FROM (SELECT pow(t / budget, (low + high) / 2) AS r FROM tot, k) q1) q2
               ) >= 0.98 * (SELECT ln(n) FROM k) AS ok FROM grid WHERE step < 60) q),
one AS (SELECT -sum(t / budget * ln(t / budget)) >= 0.98 * ln(any_value(n)) AS ok FROM tot, k),
ex AS (SELECT CASE WHEN (SELECT ok FROM one) OR (SELECT n FROM k) < 2 THEN 1.0 ELSE low END AS e FROM grid WHERE step = 60),
wt AS (SELECT s, t, budget * pow(t / budget, e) / sum(pow(t / budget, e)) OVER () AS want FROM tot, k, ex),
plan AS (SELECT s, floor(want / t) AS whole, want - floor(want / t) * t AS rest FROM wt),
o AS (SELECT b.s, b.block, b.t, coalesce(sum(b.t) OVER (PARTITION BY b.s ORDER BY {_hex("'2|' || b.s || '|' || CAST(b.block AS VARCHAR)", 13)}, b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
u AS (SELECT o.s, o.block, CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS INTEGER) AS passes FROM o JOIN plan USING (s)),
x AS (SELECT d.*, unnest(range(0, u.passes)) AS pass FROM d JOIN u USING (s, block))
SELECT doc_id, source, n_tokens, CAST(pass AS INTEGER) AS pass, CAST(block AS INTEGER) AS block,
       {_hex("'3|' || s || '|' || CAST(pass AS VARCHAR) || '|' || CAST(block AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)", 13)} AS position
FROM x
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(load(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.where(~out))
    scored = langid.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    model = toxicity.fit(docs.where(~out).join(labels, "doc_id"))
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(load(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(load(spark, sf_dir, "documents")).drop("kept")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts of the table itself: it has none of its own.

    Every second host is blocked on a day of January, every third of these taken off 10 days later, every fifth blocked again 5 days
    after that; every seventh host has its folder /en/ allowed from a day in January on.
    """
    host = pages.select(urlfilter.host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    n = F.conv(F.substring(F.md5(F.col("h").cast("binary")), 1, 8), 16, 10).cast("long")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int"))
    row = lambda list_, pattern, action, since, test: F.when(test, F.struct(F.lit(list_).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), since.cast("timestamp").alias("since")))
    entries = F.array(
        row("hosts", F.col("h"), "block", day, n % 2 == 0),
        row("hosts", F.col("h"), "remove", F.date_add(day, 10), n % 6 == 0),
        row("hosts", F.col("h"), "block", F.date_add(day, 15), n % 30 == 0),
        row("folders", F.concat("h", F.lit("/en/")), "allow", day, n % 7 == 0),
    )
    return host.select(F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e")).select("e.*")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    # Fetch times, which the table lacks: each page on an hour of the first 60 days of the year.
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7919 % 1440 * 3600))
    found = urlfilter.evaluated(captures, urlfilter.intervals(list_entries(pages)))
    return found.select("page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_unix"), F.col("n_active").cast("long").alias("n_active"), "blocked_by", "allowed_by", "verdict")


OP10_SQL = r"""
WITH p AS (SELECT page_id, url, 1704067200 + page_id * 7919 % 1440 * 3600 AS t,
                  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS h,
                  coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)', 1), ''), '/') AS path FROM pages),
hosts AS (SELECT h, CAST(concat('0x', substr(md5(h), 1, 8)) AS BIGINT) AS n FROM (SELECT DISTINCT h FROM p WHERE h <> '')),
e AS (SELECT 'hosts' AS l, h AS pattern, 'block' AS action, 1704067200 + n % 28 * 86400 AS since FROM hosts WHERE n % 2 = 0
      UNION ALL SELECT 'hosts', h, 'remove', 1704067200 + (n % 28 + 10) * 86400 FROM hosts WHERE n % 6 = 0
      UNION ALL SELECT 'hosts', h, 'block', 1704067200 + (n % 28 + 15) * 86400 FROM hosts WHERE n % 30 = 0
      UNION ALL SELECT 'folders', h || '/en/', 'allow', 1704067200 + n % 28 * 86400 FROM hosts WHERE n % 7 = 0),
v AS (SELECT *, lead(since) OVER (PARTITION BY l, pattern ORDER BY since) AS until FROM e),
m AS (SELECT p.page_id, v.pattern, v.action FROM p JOIN v ON p.t >= v.since AND (v.until IS NULL OR p.t < v.until) AND v.action <> 'remove'
       AND (CASE WHEN contains(v.pattern, '/') THEN ('.' || p.h || p.path) LIKE '%.' || v.pattern || '%' AND starts_with(p.path, '/en/') AND ('.' || p.h || '/en/') LIKE '%.' || v.pattern
                 ELSE ('.' || p.h) LIKE '%.' || v.pattern END)),
g AS (SELECT page_id, count(*) AS n_active,
             arg_max(pattern, (len(pattern), pattern)) FILTER (WHERE action = 'block') AS blocked_by,
             arg_max(pattern, (len(pattern), pattern)) FILTER (WHERE action = 'allow') AS allowed_by FROM m GROUP BY 1)
SELECT p.page_id, p.url, CAST(p.t AS BIGINT) AS fetched_unix, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, blocked_by, allowed_by,
       CASE WHEN allowed_by IS NOT NULL AND (blocked_by IS NULL OR len(allowed_by) >= len(blocked_by)) THEN 'allow' WHEN blocked_by IS NOT NULL THEN 'block' ELSE 'none' END AS verdict
FROM p LEFT JOIN g USING (page_id)
"""

QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_pseudonyms, op3_fingerprints, op4_mixing, op5_toxicity, op6_language_id, op7_decontamination, op8_main_text, op9_repeats, op10_url_filters)}
ORACLES: dict[str, str] = {"op1_near_duplicates": OP1_SQL, "op4_mixing": OP4_SQL, "op10_url_filters": OP10_SQL}
