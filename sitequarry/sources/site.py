"""A crawled site as DataFrames: pages and links from raw HTML, with regular expressions only.

The expressions are those that a SQL engine has as well; html.py parses pages properly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions import url as u
from sitequarry.functions.text import count_words

SCRIPTS = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head>.*?</head>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visible(html):
    """Text without scripts, styles, head and tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SCRIPTS, " "), "<[^>]*>", " "), r"\s+", " "))


def crawl(raw: DataFrame) -> DataFrame:
    """Pages with what an audit reads of them.

    The raw table has no fetch results, so status, depth, timings and score follow from page_id: of 25 pages one each
    is missing, moved, failing and moved for a time.
    """
    i = F.col("page_id")
    p = raw.select(
        i,
        "url",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("h1"),
        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
        visible(F.col("html")).alias("body"),
        F.length("html").cast("long").alias("html_chars"),
    )
    status = F.when(i % 25 == 0, 404).when(i % 25 == 1, 301).when(i % 25 == 2, 500).when(i % 25 == 3, 302).otherwise(200)
    return p.withColumns(
        {
            "norm": u.normalize(F.col("url")),
            "n_words": count_words(F.col("body")),
            "status": status,
            "depth": (i % 5).cast("int"),
            "aeo": (i * 37 % 101).cast("int"),
            "ttfb_ms": (i * 53 % 1500).cast("int"),
            "response_ms": (i * 131 % 3000).cast("int"),
        }
    )


def links(raw: DataFrame) -> DataFrame:
    """Edges: source, target (both normal forms), href, anchor and place on the page."""
    found = raw.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(<a href="[^"]*">[^<]*</a>)'), 1)).alias("pos", "a"))
    found = found.withColumns({"href": F.regexp_extract("a", 'href="([^"]*)"', 1), "anchor": F.trim(F.regexp_extract("a", ">([^<]*)<", 1))})
    target = u.resolve(F.col("url"), F.col("href"))
    return found.select("page_id", F.col("pos").cast("int").alias("pos"), u.normalize(F.col("url")).alias("source"), u.normalize(target).alias("target"), "href", "anchor").where("target is not null")


def internal_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (source, target) between parts of one supplier, as a link graph that is dense enough to rank."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 97).alias("target")).where("source <> target").distinct()
