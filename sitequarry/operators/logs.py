"""Server logs: lines to entries, bots, and what they fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.common import half_up, let

# Bots by a part of their user agent, in the order that they are tried, and their kind.
BOTS = [
    ("Googlebot", "search", "googlebot"), ("GoogleOther", "search", "googleother"), ("Bingbot", "search", "bingbot"), ("DuckDuckBot", "search", "duckduckbot"), ("Applebot", "search", "applebot/"),
    ("PetalBot", "search", "petalbot"), ("YandexBot", "search", "yandexbot"), ("Baiduspider", "search", "baiduspider"), ("OAI-SearchBot", "ai-search", "oai-searchbot"), ("PerplexityBot", "ai-search", "perplexitybot"),
    ("Claude-SearchBot", "ai-search", "claude-searchbot"), ("DuckAssistBot", "ai-search", "duckassistbot"), ("Amazonbot", "ai-search", "amazonbot"), ("YouBot", "ai-search", "youbot"), ("GPTBot", "ai-training", "gptbot"),
    ("ClaudeBot", "ai-training", "claudebot/"), ("CCBot", "ai-training", "ccbot"), ("Bytespider", "ai-training", "bytespider"), ("ChatGPT-User", "user-fetcher", "chatgpt-user"), ("Claude-User", "user-fetcher", "claude-user/"),
    ("Perplexity-User", "user-fetcher", "perplexity-user"), ("MistralAI-User", "user-fetcher", "mistralai-user"), ("AhrefsBot", "seo-tool", "ahrefsbot"), ("SemrushBot", "seo-tool", "semrushbot"), ("MJ12bot", "seo-tool", "mj12bot"), ("DotBot", "seo-tool", "dotbot"),
]
# What else a bot calls itself, and the common log format.
OTHER = "(?i)bot|crawl|spider|slurp|mediapartners|adsbot|scanner|headless|python-requests|curl|wget"
LINE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+HTTP/[\d.]+"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
# Names of what hits are wasted on.
WASTE = {"dead": "Bot hits to %s dead URLs", "failing": "Bot hits to 5xx error URLs", "moved": "Bot hits to redirecting URLs", "tagged": "Bot hits to parameterised / ad-tagged URLs"}


def bot(agent: Column) -> Column:
    """The first bot whose part the agent has; one lookup in a literal list, however long that is."""
    low = F.lower(F.coalesce(agent, F.lit("")))
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(token).alias("token")) for name, _, token in BOTS])
    found = let(low, lambda x: F.get(F.filter(known, lambda b: F.contains(x, b["token"])), F.lit(0))["name"])
    return F.coalesce(found, F.when(F.coalesce(agent, F.lit("")).rlike(OTHER), "Other bot").otherwise("Human"))


def kind(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for n, k, _ in BOTS for x in (n, k)])
    return F.coalesce(F.try_element_at(known, name), F.lit("other-bot"))


def entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of lines in common log format or JSON; others are left out.  The time zone of a line is ignored."""
    v = F.trim(column)
    # One match of the pattern: its groups, joined by a character that a line must not hold, become an array.
    groups = "\u0001".join(f"${i}" for i in range(1, 9))
    parts = F.split(F.regexp_replace(v, LINE + ".*$", groups), "\u0001")
    read = lines.select(v.alias("v"), F.when(~v.startswith("{") & ~F.contains(v, F.lit("\u0001")), parts).alias("g"), F.when(v.startswith("{"), F.try_parse_json(v)).alias("j"))
    j, json = F.col("j"), F.col("v").startswith("{")
    get = lambda *names: F.coalesce(*[F.try_variant_get(j, f"$.{n}", "string") for n in names], F.lit(""))
    g = lambda i: F.get("g", F.lit(i - 1))
    at = F.try_to_timestamp(F.substring(g(2), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    number = F.try_variant_get(j, "$.timestamp", "double")
    out = read.where(j.isNotNull() | (F.size("g") == 8)).select(
        F.when(json, get("clientIp", "ip", "remoteAddr")).otherwise(g(1)).alias("ip"),
        F.when(json, F.coalesce(F.timestamp_millis((number * 1000).cast("long")), F.try_to_timestamp(get("timestamp", "time", "datetime")))).otherwise(at).alias("at"),
        F.when(json, F.coalesce(F.nullif(get("method"), F.lit("")), F.lit("GET"))).otherwise(g(3)).alias("method"),
        F.when(json, get("url", "requestUrl", "uri", "path")).otherwise(g(4)).alias("url"),
        F.coalesce(F.when(json, get("status", "statusCode")).otherwise(g(5)).try_cast("int"), F.lit(0)).alias("status"),
        F.coalesce(F.when(json, get("bytes", "size", "bytesSent")).otherwise(g(6)).try_cast("long"), F.lit(0)).alias("bytes"),
        F.when(json, get("userAgent", "user_agent", "ua")).otherwise(g(8)).alias("agent"),
    )
    return out.withColumn("bot", bot(F.col("agent")))


def bot_hits(log: DataFrame) -> DataFrame:
    """(bot, hits, pct, urls, bytes); the share is of all hits by bots, one digit."""
    from pyspark.sql import Window as W

    g = log.where("bot <> 'Human'").groupBy("bot").agg(F.count("*").alias("hits"), F.count_distinct("url").alias("urls"), F.sum("bytes").alias("bytes"))
    return g.withColumn("pct", half_up(F.col("hits") / F.sum("hits").over(W.partitionBy()) * 100, 1))


def url_stats(log: DataFrame) -> DataFrame:
    s = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return log.where("bot <> 'Human'").groupBy("url").agg(F.count("*").alias("hits"), s("bot").alias("bots"), F.max("at").alias("last"), s("status").alias("statuses"))


def status_by_bot(log: DataFrame) -> DataFrame:
    return log.where("bot <> 'Human'").groupBy("bot", "status").agg(F.count("*").alias("hits"))


def waste(log: DataFrame) -> DataFrame:
    """(kind, hits, urls): hits on dead, failing or moved URLs and on those with advertising parameters; one hit can be two kinds."""
    s = F.col("status")
    first = F.when(s.isin(404, 410), F.replace(F.lit(WASTE["dead"]), F.lit("%s"), s.cast("string"))).when(s >= 500, WASTE["failing"]).when(s.between(300, 399), WASTE["moved"])
    second = F.when(F.col("url").rlike("(?i)[?&](utm_|gclid|fbclid|msclkid)"), WASTE["tagged"])
    rows = log.where("bot <> 'Human'").select("url", F.explode(F.array_compact(F.array(first, second))).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("hits"), F.count_distinct("url").alias("urls"))


def never_crawled(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Served pages (url, path) that no bot fetched, neither by URL nor by path."""
    from sitequarry.functions.url import path, readable

    hits = log.where("bot <> 'Human'").select("url").distinct()
    paths = hits.select(F.when(readable(F.col("url")), path(F.col("url"))).otherwise(F.regexp_replace("url", "[?#].*$", "")).alias("path")).distinct()
    return pages.where("status = 200").join(hits, "url", "left_anti").join(paths, "path", "left_anti")
