"""Discovery of sources: result pages of searches, recorded attempts, challenges, budgets, and the union of channels."""

from __future__ import annotations

import re
import time
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.functions import url as u
from sitequarry.functions.common import any_of
from sitequarry.operators.content import failure_class
from sitequarry.operators.dom import Node, compiled
from sitequarry.operators.html import read
from sitequarry.operators.store import first_per_key

# Titles of interstitial pages, and what their markup has.
CHALLENGE_TITLES = ["just a moment...", "just a moment", "attention required! | cloudflare", "verify you are human", "security verification", "access denied"]
CHALLENGE_MARKS = ["/cdn-cgi/challenge-platform/", "cf-chl-", "cf_chl_opt", "g-recaptcha", "hcaptcha"]
# Where the providers' pages have results, say that there are none, or ask for a person.
RESULTS = {"duckduckgo-html": "a.result__a", "bing": "li.b_algo h2 a", "google": "a"}
NOTHING = ".no-results, .no-results__message, #b_results .b_no"
CHALLENGE = "#challenge-form, form[action*='anomaly'], #captcha-form"


def challenge(headers: Column, body: Column) -> Column:
    """What shows that a response is a challenge: the header that says so, or a title and a mark of one; null if it is none."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 131_072))
    title = F.trim(F.regexp_replace(F.regexp_extract(head, r"(?s)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    marked = title.isin(CHALLENGE_TITLES) & any_of(lambda m: F.contains(head, F.lit(m)), CHALLENGE_MARKS)
    by_header = F.lower(F.trim(F.coalesce(F.try_element_at(headers, F.lit("cf-mitigated")), F.lit("")))) == "challenge"
    return F.when(by_header, "header cf-mitigated").when(marked, F.concat(F.lit("title: "), title))


def _destination(raw: str, provider: str) -> str | None:
    """Where a result leads: out of the provider's redirect, relative to its host."""
    try:
        full = urljoin("https://www.google.com/" if provider == "google" else "https://html.duckduckgo.com/", raw)
        parts = urlsplit(full)
    except ValueError:
        return None
    asked = parse_qs(parts.query)
    if provider == "google" and parts.path == "/url":
        return next((asked[k][0] for k in ("q", "url") if k in asked), full)
    if provider == "duckduckgo-html" and "uddg" in asked:
        return asked["uddg"][0]
    return full


def _rss(text: str) -> tuple[str, list, str]:
    if not re.search(r"<(?:rss|channel)\b", text, re.I):
        return "parse_failed", [], "no channel in the feed"
    field = lambda item, name: " ".join(re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", m[1], flags=re.S).split()) if (m := re.search(rf"<{name}[^>]*>(.*?)</{name}>", item, re.S)) else ""
    from html import unescape

    rows = [tuple(unescape(field(item, n)) for n in ("link", "title", "description")) for item in re.findall(r"<item\b[^>]*>(.*?)</item>", text, re.S)]
    return ("results", rows, "") if rows else ("empty_results", [], "the feed has no items")


def parsed(text: str | None, provider: str) -> tuple[str, list[tuple[str, str, str]], str]:
    """(status, (url, title, snippet) of each result, note) of a result page; a page that is none of the known kinds failed, it isn't empty."""
    if provider == "bing-rss":
        return _rss(text or "")
    root = read(text).root
    find = lambda selector, within=root: [x for x in within.walk() if compiled_once(selector)(x)]
    if find(CHALLENGE):
        return "provider_challenge", [], "the page has a challenge form"
    if provider not in RESULTS:
        return "parse_failed", [], f"no known format: {provider}"
    rows = []
    for a in find(RESULTS[provider]):
        if provider == "google" and not any(x.tag == "h3" for x in a.walk()):
            continue
        url = _destination(a.attributes.get("href", ""), provider)
        if url:
            box = next((x for x in a.above() if "result" in x.attributes.get("class", "").split()), None)
            said = find(".result__snippet", box) if box is not None else []
            rows.append((url, a.text(), said[0].text() if said else ""))
    if rows:
        return "results", rows, ""
    empty = find(NOTHING)
    return ("empty_results", [], empty[0].text()[:500]) if empty else ("parse_failed", [], "neither results nor a mark that there are none")


_COMPILED: dict = {}


def compiled_once(selector: str):
    if selector not in _COMPILED:
        _COMPILED[selector] = compiled(selector)
    return _COMPILED[selector]


def results(pages: DataFrame) -> DataFrame:
    """(key, provider, status, place, url, title, snippet, note) of result pages (key, provider, body): a row for each valid result, one with null url for a page without.

    A null body, or one of an unknown kind, has status parse_failed.
    """
    schema = "key string, provider string, status string, place int, raw string, title string, snippet string, note string"
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["key", "provider", "status", "place", "raw", "title", "snippet", "note"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for key, provider, body in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    status, rows, note = parsed(body, (provider or "").lower())
                    out += [(key, provider, status, i + 1, *row, note) for i, row in enumerate(rows)] or [(key, provider, status, None, None, None, None, note)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    rows = pages.select(F.col("key").cast("string").alias("key"), "provider", "body").mapInArrow(run, schema).withColumn("url", u.candidate(F.col("raw")))
    valid = F.max(F.col("url").isNotNull()).over(W.partitionBy("key", "provider"))
    rows = rows.withColumn("valid", valid)
    lost = (F.col("status") == "results") & ~F.col("valid")
    rows = rows.where((F.col("status") != "results") | F.col("url").isNotNull() | (~F.col("valid") & (F.col("place") == 1)))
    return rows.select("key", "provider", F.when(lost, "parse_failed").otherwise(F.col("status")).alias("status"), F.when(~lost, F.col("place")).alias("place"), "url", F.when(~lost, F.col("title")).alias("title"), F.when(~lost, F.col("snippet")).alias("snippet"), F.when(lost, "no result has a valid address").otherwise(F.col("note")).alias("note"))


def saved_pages(spark: SparkSession, folder: str, provider: str, captured_at: str, most: int = 20, most_bytes: int = 5_000_000) -> DataFrame:
    """Result pages saved as files: (key, provider, body, sha256, captured_at).  At most `most` files of most_bytes each; the time of capture is needed."""
    if not captured_at:
        raise ValueError("saved pages need a time of capture")
    files = spark.read.format("binaryFile").load(folder)
    if files.limit(most + 1).count() > most or not files.where(F.col("length") > most_bytes).isEmpty():
        raise ValueError(f"at most {most} saved pages of {most_bytes} bytes")
    return files.select(F.col("path").alias("key"), F.lit(provider).alias("provider"), F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("sha256"), F.lit(captured_at).alias("captured_at"))


SUCCESS = ("results", "empty_results")


def host_attempts(records: DataFrame) -> DataFrame:
    """records (provider, query, captured_at, status, evidence, http_status, market, language, results) with problem, and status as it is judged.

    problem names what a record lacks, null for a good one.  Where a record says it failed, the raw evidence decides the class, not the record.
    """
    needed = ["provider", "query", "captured_at", "status", "evidence"]
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) == "", n) for n in needed]))
    none = (F.col("status") == "results") & (F.coalesce(F.size("results"), F.lit(0)) <= 0)
    problem = F.when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ", "))).when(F.try_to_timestamp("captured_at").isNull(), "captured_at is no time").when(none, "results without any")
    judged = F.when(F.col("status").isin(*SUCCESS), F.col("status")).otherwise(F.coalesce(failure_class(F.col("evidence"), F.coalesce("http_status", F.lit(0))), F.lit("unknown")))
    return records.withColumn("problem", problem).withColumn("status", judged)


def matched(records: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("query", "market", "language")) -> DataFrame:
    """records of the wanted queries, by all keys, null beside null."""
    wanted = queries.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return records.join(wanted, test, "left_semi")


def budgeted(requests: DataFrame, run: str, at: str, order: str, limit: int = 16, seconds: int = 90) -> DataFrame:
    """requests with allowed: the first `limit` of each run, within so many seconds of its first."""
    w = W.partitionBy(run).orderBy(at, order)
    start = F.min(F.unix_millis(F.col(at).cast("timestamp"))).over(W.partitionBy(run))
    return requests.withColumn("allowed", (F.row_number().over(w) <= limit) & (F.unix_millis(F.col(at).cast("timestamp")) - start < seconds * 1000))


class Budget:
    """Of a program: so many requests, within so many seconds."""

    def __init__(self, limit: int = 16, seconds: float = 90, clock=time.monotonic):
        self.limit, self.used, self._clock, self._end = limit, 0, clock, clock() + seconds

    def take(self) -> None:
        if self.used >= self.limit or self._clock() >= self._end:
            raise RuntimeError("discovery_request_budget_exhausted")
        self.used += 1

    def left(self) -> float:
        return max(0.0, self._end - self._clock())


def search_plan(targets: DataFrame, base: str, query: str, pages: int) -> DataFrame:
    """targets (target, brand) with (page, url) of the result pages to ask for; query is a template with {brand} and {target}."""
    text = F.replace(F.replace(F.lit(query), F.lit("{brand}"), F.col("brand")), F.lit("{target}"), F.col("target"))
    each = targets.select("target", "brand", F.url_encode(text).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))
    return each.select("target", "page", F.concat(F.lit(f"{base}?q="), "q", F.lit("&start="), (F.col("page") * 10).cast("string")).alias("url"))


# The order in which channels count, and hosts of providers themselves.
CHANNELS = ["supplied", "saved", "host", "native"]
PROVIDER_HOSTS = ["google.com", "bing.com", "duckduckgo.com"]


def discovered(candidates: DataFrame, target: str, most: int) -> DataFrame:
    """(url, channel, title, order) of candidates (url, channel, title, order): one for each address, of the first channel that has it, in their order.

    Pages of the target's own host and of search providers are no sources; addresses that cannot be read are left out.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel"))
    c = candidates.withColumn("url", u.candidate(F.col("url"))).where("url is not null").withColumn("rank", rank).where("rank > 0")
    own = u.root_domain(F.lit(target))
    c = c.where((u.root_domain(F.col("url")) != own) & ~u.root_domain(F.col("url")).isin(PROVIDER_HOSTS))
    one = first_per_key(c, ["url"], [F.col("rank"), F.col("order")])
    return one.orderBy("rank", "order", "url").limit(most).select("url", "channel", "title", "order")
