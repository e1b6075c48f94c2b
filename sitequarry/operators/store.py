"""Filters, pages, ranks and roll-ups over pages, issues and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitequarry.functions import text as t
from sitequarry.functions.common import any_of, half_up
from sitequarry.operators.shared import cut


def newest(df: DataFrame, time: str, key: str, most: int) -> DataFrame:
    return df.orderBy(F.desc(time), key).limit(most)


def page(df: DataFrame, number: int, size: int, most: int = 50_000) -> DataFrame:
    """Page `number` (from 1) of an ordered DataFrame; sizes are held within 1 to most."""
    size = max(1, min(most, size))
    return df.offset((max(1, number) - 1) * size).limit(size)


def _search(columns: list[str], text: str) -> Column:
    """Any column holds the text, in any case of ASCII letters; % and _ are no wildcards."""
    return any_of(lambda c: F.contains(F.lower(c), F.lit(text.lower())), columns)


def filter_issues(issues: DataFrame, severity: str = "all", category: str = "all", search: str = "") -> DataFrame:
    if severity != "all":
        issues = issues.where(F.col("severity") == severity)
    if category != "all":
        issues = issues.where(F.col("category") == category)
    return issues.where(_search(["name", "url"], search)) if search else issues


def filter_pages(pages: DataFrame, search: str = "", bucket: str = "all", least_aeo: int | None = None, status: int | None = None) -> DataFrame:
    """bucket: ok (200), redirect (300 to 399), broken (400 and up); least_aeo keeps pages below it; status an exact one."""
    test = {"ok": F.col("status") == 200, "redirect": F.col("status").between(300, 399), "broken": F.col("status") >= 400}.get(bucket)
    if test is not None:
        pages = pages.where(test)
    if status is not None:
        pages = pages.where(F.col("status") == status)
    if least_aeo is not None:
        pages = pages.where(F.col("aeo") < least_aeo)
    return pages.where(_search(["url", "title", "h1"], search)) if search else pages


def filter_links(links: DataFrame, kind: str = "all", search: str = "", fields: list[str] = ("source", "target", "anchor")) -> DataFrame:
    from sitequarry.functions.url import host

    inside = host(F.col("source")) == host(F.col("target"))
    if kind in ("internal", "external"):
        links = links.where(inside if kind == "internal" else ~inside)
    if kind == "broken":
        links = links.where("target_status >= 400")
    return links.where(_search(list(fields), search)) if search else links


def with_details(df: DataFrame, column: str, path: str, type_: str, name: str) -> DataFrame:
    """A field of a JSON text; null where the text is no JSON."""
    return df.withColumn(name, F.try_variant_get(F.try_parse_json(column), path, type_))


def recommendations(issues: DataFrame) -> DataFrame:
    g = issues.groupBy("issue_id").agg(t.worst_severity(F.col("severity")).alias("severity"), F.count_distinct("url").alias("affected_pages"))
    return g.select("issue_id", "affected_pages", t.priority(F.col("severity"), F.col("affected_pages")).alias("priority"))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """place by order, for results that are small already: a rank over all rows is one task's work."""
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """place by order over all rows of any number: rows are dealt by ranges, numbered within each, and each range goes on where those before it end."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # of ranges: few
    starts = dealt.groupBy("__range").agg(F.count("*").alias("n")).withColumn("start", before).select("__range", "start")
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "__range").withColumn("place", F.col("start") + own).drop("__range", "start")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key; Spark prunes within partitions before the shuffle (WindowGroupLimit)."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("place")


def nth_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return top_per_key(df, keys, order, n).where(F.col("place") == n).drop("place")


def severity_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("severity").agg(F.sum("affected_pages").alias("total"))


def ci_gate(pages: DataFrame, summary: DataFrame, errors: int = 0, warnings: int = 10, aeo: int = 70) -> DataFrame:
    """(rule, value, violated) of the release gate."""
    total = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("affected_pages"))), F.lit(0)).cast("double")
    a = summary.agg(total("Error").alias("errors"), total("Warning").alias("warnings"))
    b = pages.agg(half_up(F.avg("aeo")).alias("aeo"), F.count_if(F.col("status") >= 400).cast("double").alias("broken"))
    row = lambda name, test: F.struct(F.lit(name).alias("rule"), F.col(name).alias("value"), test.alias("violated"))
    both = a.crossJoin(F.broadcast(b))  # one row each
    return both.select(F.explode(F.array(row("errors", F.col("errors") > errors), row("warnings", F.col("warnings") > warnings), row("aeo", F.col("aeo") < aeo), row("broken", F.col("broken") > 0))).alias("r")).select("r.*")


def schedule(sites: DataFrame, order: list[Column], start: str, per_week: int, pages: int) -> DataFrame:
    """Place in the plan, week, due date and the page in turn, from week two on."""
    out = numbered(sites, order).withColumn("i", F.col("place") - 1)
    week = F.floor(F.col("i") / per_week).cast("int")
    days = 7 + week * 7 + F.col("i") % per_week * (7 // per_week)
    return out.withColumns({"week": week + 2, "due": F.date_format(F.date_add(F.lit(start).cast("date"), days.cast("int")), "yyyy-MM-dd"), "page": F.col("i") % pages})


def skipped_levels(df: DataFrame, keys: list[str], position: str, level: str) -> DataFrame:
    """Rows whose level is more than one below that of the row before."""
    before = F.lag(level).over(W.partitionBy(*keys).orderBy(position))
    return df.withColumn("__before", before).where((F.col("__before") > 0) & (F.col(level) > F.col("__before") + 1)).drop("__before")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in a keyed random order: the same for the same seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))).limit(n)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
