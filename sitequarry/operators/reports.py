"""Comparisons between crawls, sites and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions import url as u
from sitequarry.functions.common import half_up, half_up_int


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, removed, or changed in one of the fields (null-safe); unchanged keys are left out."""
    b, a = before.select(F.col(key), *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b")), after.select(F.col(key), *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    both = b.join(a, key, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}"))
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~same, "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def issue_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(issue_id, new, resolved): pages that gained and lost each issue."""
    b, a = before.select("issue_id", "url", F.lit(1).alias("b")).distinct(), after.select("issue_id", "url", F.lit(1).alias("a")).distinct()
    both = b.join(a, ["issue_id", "url"], "full_outer")
    return both.groupBy("issue_id").agg(F.count_if(F.col("b").isNull()).alias("new"), F.count_if(F.col("a").isNull()).alias("resolved"))


def keyword_map(rows: DataFrame) -> DataFrame:
    """(site, keyword, pages, in_title) of (site, keyword, in_title)."""
    return rows.groupBy("site", "keyword").agg(F.count("*").alias("pages"), F.bool_or("in_title").alias("in_title"))


def content_gap(keywords: DataFrame, base: int, rivals: int) -> DataFrame:
    """Per keyword how the base stands against its rivals, with an opportunity of 0 to 100."""
    own = F.col("site") == base
    g = keywords.groupBy("keyword").agg(
        F.coalesce(F.sum(F.when(own, F.col("pages"))), F.lit(0)).alias("base"),
        F.coalesce(F.bool_or(own & F.col("in_title")), F.lit(False)).alias("base_title"),
        F.count_if(~own).alias("covering"),
        F.coalesce(F.bool_or(~own & F.col("in_title")), F.lit(False)).alias("their_title"),
    )
    missing = F.when((F.col("covering") == rivals) & F.lit(rivals > 1), "Missing").otherwise("Untapped")
    status = F.when(F.col("base") == 0, missing).when(~F.col("base_title") & F.col("their_title"), "Weak").when(F.col("base_title") & ~F.col("their_title"), "Strong").otherwise("Shared")
    g = g.withColumn("status", status).withColumn("intent", t.intent(F.col("keyword"))["primary"])
    worth = F.when(F.col("status") == "Missing", 30).when(F.col("status") == "Untapped", 25).when(F.col("status") == "Weak", 15).when(F.col("status") == "Shared", 5).otherwise(-20)
    opportunity = 50 + worth + F.when(F.col("intent").isin("commercial", "transactional"), 15).otherwise(0) + F.when(t.difficulty(F.col("keyword"), F.col("intent")) < 50, 10).otherwise(0)
    return g.withColumn("opportunity", F.greatest(F.lit(0), F.least(F.lit(100), opportunity)))


def link_intersect(backlinks: DataFrame, target: int, rivals: int, overlap: int = 2) -> DataFrame:
    """Per referring domain how many rivals it links to, whether it links to the target, and the priority of asking it."""
    g = backlinks.groupBy("domain").agg(F.count_distinct(F.when(F.col("site") != target, F.col("site"))).alias("competitors"), F.bool_or(F.col("site") == target).alias("has_target")).where("competitors > 0")
    n = F.col("competitors")
    return g.withColumn("priority", F.when(F.col("has_target"), "Low").when((n == rivals) & (n > 1), "Critical").when(n >= overlap, "High").otherwise("Medium"))


def site_metrics(pages: DataFrame) -> DataFrame:
    one = lambda c: half_up(F.avg(c), 1)
    return pages.groupBy("site").agg(
        one("aeo").alias("aeo"), one("n_words").alias("words"), one(F.when(F.col("url").startswith("https"), 100.0).otherwise(0.0)).alias("https"), one(F.length("title")).alias("title_length"), F.count_if(F.col("status") >= 400).cast("double").alias("broken")
    )


def shortfalls(metrics: DataFrame, base: int, lower_is_better: tuple[str, ...] = ("broken",)) -> DataFrame:
    """Per metric by how much the best rival is ahead of the base; metrics where none is are left out."""
    names = [c for c in metrics.columns if c != "site"]
    long = metrics.unpivot("site", names, "metric", "v")
    sign = F.when(F.col("metric").isin(*lower_is_better), -1.0).otherwise(1.0)
    own = long.where(F.col("site") == base).select("metric", F.col("v").alias("own"))
    rivals = long.where(F.col("site") != base).groupBy("metric").agg(F.max(F.col("v")).alias("top"), F.min("v").alias("low"))
    gap = F.when(sign > 0, F.col("top") - F.col("own")).otherwise(F.col("own") - F.col("low"))
    return own.join(rivals, "metric").select("metric", half_up(gap, 1).alias("shortfall")).where("shortfall > 0")


def anchor_profile(links: DataFrame, brand: str = "", keywords: list[str] = ()) -> DataFrame:
    """(kind, n, pct) of anchor texts: counts by text first, kinds of the few different texts after that."""
    texts = links.groupBy("anchor").agg(F.count("*").alias("n"))
    kinds = texts.groupBy(t.anchor_class(F.col("anchor"), brand, keywords).alias("kind")).agg(F.sum("n").alias("n"))
    return kinds.withColumn("pct", half_up_int(F.col("n") / F.sum("n").over(W.partitionBy()) * 100))


def autocorrelation(series: DataFrame, key: str, order: str, value: str, lags) -> DataFrame:
    """(key, lag, corr) of each series."""
    w = W.partitionBy(key)
    c = series.select(key, F.row_number().over(w.orderBy(order)).alias("i"), (F.col(value) - F.avg(value).over(w)).alias("v"))
    power = c.groupBy(key).agg(F.sum(F.col("v") * F.col("v")).alias("power"))
    a = c.select(key, "i", "v", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    b = c.select(key, F.col("i").alias("j"), F.col("v").alias("u"))
    return a.join(b, [key, "j"]).groupBy(key, "lag").agg(F.sum(F.col("v") * F.col("u")).alias("s")).join(power, key).select(key, "lag", F.round(F.col("s") / F.col("power"), 6).alias("corr"))


def gated(sites: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """sites with the first reason that excludes each, null if none does."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(gates):
        reason = F.when(test, name).otherwise(reason)
    return sites.withColumn("reason", reason)


def plan(sites: DataFrame, most: int, per_week: int) -> DataFrame:
    """The sites to post to, by readiness, then balance, with their week."""
    best = sites.where("reason is null").orderBy("readiness", F.desc("s_acctbal"), "s_suppkey").limit(most)
    return best.withColumn("place", F.row_number().over(W.orderBy("readiness", F.desc("s_acctbal"), "s_suppkey"))).withColumn("week", (F.floor((F.col("place") - 1) / per_week) + 2).cast("int"))


def scored(rows: DataFrame, maxima: dict[str, int]) -> DataFrame:
    """low and high: points with unknown dimensions (null) counted as nothing, and as their maximum."""
    low = high = F.lit(0)
    for name, most in maxima.items():
        low, high = low + F.coalesce(F.col(name), F.lit(0)), high + F.coalesce(F.col(name), F.lit(most))
    return rows.withColumns({"low": low, "high": high})


def reputation(rows: DataFrame, key: str) -> DataFrame:
    """Breadth over publishers and the mean of the five strongest, as an interval; each publisher counts once."""
    best = rows.withColumn("r", F.row_number().over(W.partitionBy("publisher").orderBy((F.col("high") + F.col("low")).desc(), key))).where("r = 1")
    top = best.orderBy((F.col("high") + F.col("low")).desc(), "publisher").limit(5).agg(F.avg("low").alias("l"), F.avg("high").alias("h"))
    n = best.agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(top)).select(half_up(25 * F.least(F.col("n") / 5, F.lit(1.0)), 1).alias("breadth"), half_up(0.6 * F.col("l"), 1).alias("low"), half_up(0.6 * F.col("h"), 1).alias("high"))



def diff_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: pages added, removed, of another status, and those that broke (under 400 before, 400 and up now); clean if none broke.  A status on one side only is no change."""
    both = before.select(key, F.col("status").alias("b"), F.lit(True).alias("in_b")).join(after.select(key, F.col("status").alias("a"), F.lit(True).alias("in_a")), key, "full_outer")
    broke = F.count_if((F.col("b") < 400) & (F.col("a") >= 400))
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("added"), F.count_if(F.col("in_a").isNull()).alias("removed"), F.count_if(F.col("b") != F.col("a")).alias("status_changes"), broke.alias("regressions"), (broke == 0).alias("clean"))


def domain_rollup(issues: DataFrame) -> DataFrame:
    """Findings of several sites by name: sites, distinct pages, and the sum of the sites' pages."""
    by_site = issues.select("name", u.hostname(F.col("url")).alias("host"), "url").distinct().groupBy("name", "host").agg(F.count("*").alias("n"))
    return by_site.groupBy("name").agg(F.count("*").alias("sites"), F.sum("n").alias("affected_pages"), F.sum("n").alias("total"))


def verified(pages: DataFrame, links: DataFrame, host: str) -> DataFrame:
    """(page_id, verification, n) of pages (page_id, status): whether what was captured links to the host or one below it."""
    target = u.hostname(F.col("target"))
    found = links.where((target == host) | target.endswith(f".{host}")).groupBy("page_id").agg(F.count("*").alias("n"))
    out = pages.join(found, "page_id", "left").withColumn("n", F.when(F.col("status").between(200, 299), F.coalesce("n", F.lit(0))).otherwise(0).cast("long"))
    kind = F.when(~F.col("status").between(200, 299), "unverified_access").when(F.col("n") > 0, "link_observed").otherwise("no_link_in_captured_content")
    return out.select("page_id", kind.alias("verification"), "n")
