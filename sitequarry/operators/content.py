"""Content scores, failure classes, volumes, link opportunities, generated snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions import url as u
from sitequarry.functions.common import any_of, bounded, half_up, half_up_int, let

# What an error text says, and the class it stands for, in the order that they are tried.
FAILURES = [
    ("budget_exhausted", ["discovery_request_budget_exhausted"]),
    ("robots_restricted", ["robots_rule_disallowed"]),
    ("environment_network_restricted", ["network access is disabled", "network access denied by"]),
    ("permission_denied", ["permissionerror", "permission denied", "operation not permitted"]),
    ("tool_unavailable", ["tool unavailable", "tool not available"]),
    ("missing_dependency", ["modulenotfounderror", "no module named", "executable doesn't exist", "browser executable not found"]),
    ("dns_failure", ["enotfound", "getaddrinfo", "name or service not known", "nodename nor servname"]),
    ("tls_failure", ["sslerror", "certificate_verify_failed", "unable to verify the first certificate", "self-signed certificate"]),
    ("connection_timeout", ["timeouterror", "timed out", "deadline exceeded", "aborterror"]),
    ("connection_failure", ["connectionrefusederror", "connectionreseterror", "network is unreachable", "connect failed", "fetch failed", "econnrefused", "econnreset"]),
]


def failure_class(error: Column, status: Column) -> Column:
    """Class of a failed attempt; null if nothing failed."""
    low = F.lower(F.coalesce(error, F.lit("")))
    out = F.when(status == 429, "provider_rate_limited").when(status.isin(401, 403), "http_access_denied").when(status >= 400, "http_error").when(low != "", "unknown").when(~status.between(200, 299), "unknown")
    for name, parts in reversed(FAILURES):
        out = F.when(any_of(lambda p: F.contains(low, F.lit(p)), parts), name).otherwise(out)
        if name == "environment_network_restricted":
            out = F.when(low.startswith("robots_"), "robots_unavailable").otherwise(out)
    return out


def live_readability(text: Column) -> dict[str, Column]:
    """Words, sentences and a reading ease in whole numbers, with vowel groups of two at most as syllables."""
    w = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s-]", " "), r"\s+"), lambda x: x != "")
    n = F.size(w)
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")))
    groups = lambda x: F.regexp_count(F.regexp_replace(x, "e$", ""), F.lit("[aeiouy]{1,2}"))
    syllables = F.aggregate(w, F.lit(0), lambda s, x: s + F.when(groups(x) > 0, groups(x)).otherwise(1))
    return {"n_words": n.cast("long"), "n_sentences": sentences.cast("long"), "n_syllables": syllables.cast("long")}


def live_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    per_word = F.when(words > 0, syllables / words).otherwise(1.0)
    return bounded(F.floor(206.835 - 1.015 * half_up(words / sentences, 1) - 84.6 * per_word + 0.5).cast("double"), 0.0, 100.0).cast("long")


def content_score(rows: DataFrame, keyword: str, target: int = 1000) -> DataFrame:
    """rows (title, body) with score, 0 to 100: keyword, length, headings, reading ease and form."""
    key = keyword.strip().lower()
    body, low = F.col("body"), F.lower("body")
    rows = rows.withColumns(live_readability(body))
    heads = lambda n: F.regexp_extract_all(body, F.lit(rf"(?md)^{'#' * n}\s+(.+)$"), 1)
    rows = rows.withColumns({"h1s": heads(1), "h2s": heads(2), "h3s": heads(3), "hits": F.regexp_count(low, F.lit(rf"\b{key}\b")), "ease": live_ease(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables"))})
    n = F.col("n_words")
    density = F.when(n > 0, half_up(F.col("hits") * len(key.split()) / n * 100, 1)).otherwise(0.0)
    intro = F.array_join(F.slice(F.filter(F.split(F.regexp_replace(low, r"[^\w\s-]", " "), r"\s+"), lambda x: x != ""), 1, 100), " ")
    holds = lambda a: F.exists(a, lambda h: F.contains(F.lower(h), F.lit(key)))
    under, over = (density < 0.5) | (F.col("hits") == 0), density > 2.8
    score = (
        F.when(F.contains(F.lower("title"), F.lit(key)), 8).otherwise(0)
        + F.when(holds(F.col("h1s")), 8).otherwise(0)
        + F.when(F.contains(intro, F.lit(key)), 7).otherwise(0)
        + F.when(holds(F.concat("h1s", "h2s", "h3s")), 4).otherwise(0)
        + F.when(~under & ~over, 8).when((F.col("hits") > 0) & ~over, 4).otherwise(0)
        + 15
        + F.when(n / target >= 0.9, 20).otherwise(half_up_int(n / target * 20))
        + F.when((F.size("h1s") == 1) & ((F.size("h3s") == 0) | (F.size("h2s") > 0)), 10).when(F.size("h1s") == 0, 0).otherwise(5)
        + F.when(F.col("ease").between(50, 80), 10).otherwise(5)
        + F.when(body.rlike(r"(?m)^(\s*[-*]|\s*\d+\.)\s+.+") | body.rlike(r"\|(.+)\|"), 5).otherwise(0)
    )
    return rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))


def analysed(pages: DataFrame, text: str = "clean", keyword: str = "") -> DataFrame:
    """pages with n_words, n_sentences, n_syllables, ease, grade, level and phrases (phrase, n, density, stuffing): those of one to three words, those of most first; with a keyword, keyword_n and keyword_density.

    An empty text has zeros and no phrases.
    """
    out = pages.withColumns(t.readability(F.col(text)))
    n = [F.col(x) for x in ("n_words", "n_sentences", "n_syllables")]
    out = out.withColumns({"ease": t.reading_ease(*n), "grade": t.grade(*n)}).withColumn("level", t.reading_level(F.col("ease"), F.col("n_words")))
    start = F.array().cast("array<struct<phrase:string,n:int>>")

    def counted(tokens: Column, k: int) -> Column:
        """Runs of equal phrases once they are sorted."""

        def step(s: Column, x: Column) -> Column:
            last = F.try_element_at(s, F.lit(-1))
            one = F.struct(x.alias("phrase"), F.lit(1).alias("n"))
            return F.when(last["phrase"] == x, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(x.alias("phrase"), (last["n"] + 1).alias("n"))))).otherwise(F.concat(s, F.array(one)))

        runs = F.aggregate(F.array_sort(t.ngrams(tokens, k)), start, step)
        return F.transform(runs, lambda r: F.struct(r["phrase"].alias("phrase"), r["n"].alias("n"), half_up(r["n"] * k / F.size(tokens) * 100, 2).alias("density"), F.lit(k).alias("words")))

    phrases = let(t.keyword_tokens(F.col(text)), lambda w: F.flatten(F.array(*[counted(w, k) for k in (1, 2, 3)])))
    out = out.withColumn("phrases", F.transform(F.array_sort(F.transform(phrases, lambda p: F.struct((-p["n"]).alias("m"), p["words"].alias("words"), p["phrase"].alias("phrase"), p["density"].alias("density")))), lambda p: F.struct(p["phrase"].alias("phrase"), (-p["m"]).alias("n"), p["density"].alias("density"), ((p["density"] > 3.5) & (-p["m"] >= 4)).alias("stuffing"))))
    if keyword:
        hits = F.regexp_count(F.lower(text), F.lit(rf"\b{keyword.lower()}\b"))
        out = out.withColumns({"keyword_n": hits.cast("long"), "keyword_density": half_up(hits * len(keyword.split()) / F.greatest(F.lit(1), F.col("n_words")) * 100, 2)})
    return out


def alignment(intent: Column, n_words: Column, table: Column, faq: Column, pricing: Column) -> Column:
    """How a page fits the intent of its keyword, 10 to 100; 70 and more is aligned."""
    minus = (
        F.when(intent == "commercial", F.when(table, 0).otherwise(25) + F.when(n_words < 600, 20).otherwise(0))
        .when(intent == "informational", F.when(faq, 0).otherwise(15) + F.when(n_words < 500, 25).otherwise(0))
        .when(intent == "transactional", F.when(pricing, 0).otherwise(30))
        .otherwise(0)
    )
    return F.greatest(F.lit(10), 100 - minus)


def opportunity(source: Column, target: Column, n_incoming: Column) -> Column:
    need = F.when(n_incoming <= 1, 25).when(n_incoming <= 3, 15).otherwise(5)
    return F.least(F.lit(100), half_up_int(source / 100 * 40) + need + half_up_int((100 - target) / 100 * 25) + 10)


def link_opportunities(targets: DataFrame, sources: DataFrame, links: DataFrame, per_target: int = 4, most_words: int = 5, least: int = 20) -> DataFrame:
    """(target, source, keyword, score) where a source's text has a target's keyword and no link to it.

    targets (target, keyword, equity, n_incoming), sources (source, text, equity), links (source, target).  Texts become runs of up to
    most_words words and meet keywords by equality; only runs that are some keyword are kept before the join.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\w\s'-]", " "), r"\s+"), lambda w: w != "")
    wanted = targets.select(F.lower("keyword").alias("keyword"), "target", F.col("equity").alias("te"), "n_incoming").where(F.size(F.split("keyword", " ")) <= most_words)
    # Each word with those after it, so that rows stay short: no text is carried along.
    runs = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.array_join(F.slice(w, i, most_words), " ")))
    each = sources.select("source", F.col("equity").alias("se"), F.explode(runs).alias("run")).withColumn("first", F.substring_index("run", " ", 1))
    firsts = wanted.select(F.substring_index("keyword", " ", 1).alias("first"), "keyword", "target", "te", "n_incoming")
    hit = each.join(firsts, "first").where(F.concat("run", F.lit(" ")).startswith(F.concat("keyword", F.lit(" "))))
    found = hit.where("source <> target").groupBy("source", "target").agg(F.min("keyword").alias("keyword"), F.first("se").alias("se"), F.first("te").alias("te"), F.first("n_incoming").alias("n_incoming"))
    found = found.join(links.select("source", "target"), ["source", "target"], "left_anti")
    scored = found.withColumn("score", opportunity(F.col("se"), F.col("te"), F.col("n_incoming"))).where(F.col("score") >= least)
    return scored.withColumn("r", F.row_number().over(W.partitionBy("target").orderBy(F.desc("score"), "source"))).where(F.col("r") <= per_target).select("target", "source", "keyword", "score")


def ladder(keywords: list[str], pivot: str, fetch: Callable[[list[str]], list[float]], levels: int = 4, clear: float = 5.0, signal: float = 0.5) -> dict[str, float]:
    """Interest of each keyword relative to the pivot, by comparisons of five at a time with ever smaller pivots.

    Weak readings are measured again against a smaller pivot and kept if nothing better comes.  fetch is the caller's.
    """
    found, weak, left, base = {pivot: 1.0}, {}, sorted(set(keywords) - {pivot}), pivot
    for _ in range(levels):
        missed = []
        for at in range(0, len(left), 4):
            group = left[at : at + 4]
            top, *values = fetch([base, *group])
            for word, v in zip(group, values, strict=True):
                if top > 0 and v >= clear:
                    found[word] = v / top * found[base]
                else:
                    if top > 0 and v >= signal:
                        weak[word] = v / top * found[base]
                    missed.append(word)
        smaller = [w for w, r in found.items() if w != base and found[base] * 0.03 <= r < found[base]]
        left = missed
        if not left or not smaller:
            break
        base = min(smaller, key=found.get)
    return {**{w: r for w, r in weak.items() if w not in found}, **found}


def volumes(keywords: DataFrame, console: DataFrame, relative: DataFrame) -> DataFrame:
    """(keyword, monthly, method): from impressions at position 5 or better, else from relative interest scaled by the median anchor."""
    c = console.withColumn("m", t.monthly_from_console(F.col("impressions"), F.col("position"), F.col("days")))
    anchors = c.where("position <= 5 and m >= 3").join(relative, c.query == relative.keyword).select((F.col("m") / F.col("rel")).alias("ratio"))
    scale = anchors.agg(F.median("ratio").alias("scale"))
    joined = keywords.join(c.withColumnRenamed("query", "keyword"), "keyword", "left").join(relative, "keyword", "left").crossJoin(F.broadcast(scale))
    own = F.when(F.col("position") <= 5, F.col("m"))
    floor = F.when(F.col("days") > 0, half_up(F.col("impressions") * 30 / F.col("days"))).otherwise(0.0)
    method = F.when(own.isNotNull(), "gsc").when(F.col("rel").isNull(), F.when(floor > 0, "gsc-floor").otherwise("below-trends-floor")).when(F.col("scale").isNull(), "uncalibrated").otherwise("trends")
    monthly = F.when(method == "gsc", half_up_int(own)).when(method == "trends", half_up_int(F.greatest(F.col("rel") * F.col("scale"), F.coalesce(floor, F.lit(0.0)))))
    return joined.select("keyword", F.coalesce(monthly, F.lit(-1)).cast("long").alias("monthly"), method.alias("method"))


def security_findings(headers: Column, url: Column) -> Column:
    """Array of finding ids of lower-cased response headers."""
    h = lambda n: F.coalesce(F.try_element_at(headers, F.lit(n)), F.lit(""))
    https = url.startswith("https://")
    age = F.regexp_extract(h("strict-transport-security"), r"(?i)max-age\s*=\s*(\d+)", 1).try_cast("long")
    hsts = h("strict-transport-security") != ""
    missing = F.lit(0)
    for test in (h("content-security-policy") == "", https & ~hsts, h("x-content-type-options") == "", (h("x-frame-options") == "") & ~h("content-security-policy").contains("frame-ancestors"), h("referrer-policy") == "", (h("permissions-policy") == "") & (h("feature-policy") == "")):
        missing = missing + test.cast("int")
    cookie = h("set-cookie")
    weak = (https & ~cookie.rlike(r"(?i);\s*secure")) | ~cookie.rlike(r"(?i);\s*httponly") | ~cookie.rlike(r"(?i);\s*samesite")
    rules = [
        ("hsts_weak", https & hsts & (F.coalesce(age, F.lit(0)) < 31_536_000)),
        ("hsts_no_subdomains", https & hsts & (age >= 31_536_000) & ~F.lower(h("strict-transport-security")).contains("includesubdomains")),
        ("xcto_invalid", (h("x-content-type-options") != "") & (F.lower(h("x-content-type-options")) != "nosniff")),
        ("missing_security_headers", missing >= 3),
        ("cookie_flags_missing", (cookie != "") & weak),
        ("server_version_exposed", h("server").rlike(r"\d+\.\d+")),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))


def llms_findings(status: Column, body: Column, content_type: Column | None = None) -> Column:
    """Array of finding ids of an llms.txt; an unknown type is taken as right."""
    kind = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    lines = F.split(body, r"\r?\n")
    h1 = F.size(F.filter(lines, lambda x: x.rlike(r"^#\s+\S")))
    rules = [("llms_txt_no_h1", h1 == 0), ("llms_txt_multi_h1", h1 > 1), ("llms_txt_no_summary", ~F.exists(lines, lambda x: x.startswith(">"))), ("llms_txt_no_links", ~body.rlike(r"\[[^\]]+\]\([^)]+\)")), ("llms_txt_too_large", F.octet_length(body) > 200 * 1024), ("llms_txt_content_type", (kind != "") & ~kind.contains("text/markdown") & ~kind.contains("text/plain"))]
    absent = (status != 200) | (F.coalesce(body, F.lit("")) == "")
    return F.when(absent, F.array(F.lit("llms_txt_missing"))).otherwise(F.array_compact(F.array(*[F.when(test, name) for name, test in rules])))


def redirect_rule(source: Column, target: Column, server: str) -> Column:
    """A rule for nginx or apache that moves a path for good."""
    quoted = F.regexp_replace(u.path(source), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    if server == "nginx":
        return F.concat(F.lit("rewrite ^"), quoted, F.lit("$ "), target, F.lit(" permanent;"))
    return F.concat(F.lit("RewriteRule ^"), F.regexp_replace(quoted, "^/", ""), F.lit("$ "), target, F.lit(" [R=301,L]"))


def breadcrumb(url: Column, home: str) -> Column:
    """JSON-LD of a page's place in its site."""
    parts = u.segments(url)
    item = lambda pos, name: F.struct(F.lit("ListItem").alias("@type"), pos.cast("int").alias("position"), name.alias("name"))
    rest = F.transform(parts, lambda x, i: item(i + 2, x))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), F.concat(F.array(item(F.lit(1), F.lit(home))), rest).alias("itemListElement")))
