"""Readers of lists, logs, snapshots, sitemaps and saved pages, and writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = T.StructType([T.StructField("id", T.StringType()), T.StructField("pages", T.MapType(T.StringType(), T.StructType([T.StructField("title", T.StringType()), T.StructField("status", T.IntegerType())])))])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a list, one to a line; blank lines and comments are left out."""
    v = F.trim("value")
    return spark.read.text(path).select(v.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a list as .json (array or lines), .csv with a column url, or text."""
    if path.endswith(".json"):
        raw = spark.read.option("multiLine", True).text(path, wholetext=True)
        each = raw.select(F.explode(F.from_json("value", "array<string>")).alias("url"))
        return each.where("url is not null")
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).select(F.trim("url").alias("url")).where("url <> ''")
    return seeds(spark, path)


def snapshots(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Pages of JSON snapshots (id, pages by URL); those of known ids are left out."""
    s = spark.read.schema(SNAPSHOT).json(path)
    if known is not None:
        s = s.join(known.select("id"), "id", "left_anti")
    return s.select("id", F.explode("pages").alias("url", "page")).select("id", "url", "page.title", "page.status")


def sitemap(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, loc, lastmod, kind) of sitemaps and sitemap indexes as text; kind is url or sitemap."""
    body = F.regexp_extract_all(text, F.lit(r"(?s)<(url|sitemap)>(.*?)</(?:url|sitemap)>"), 2)
    kinds = F.regexp_extract_all(text, F.lit(r"(?s)<(url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)
    e = files.select(key, F.explode(F.arrays_zip(kinds.alias("kind"), body.alias("body"))).alias("e")).select(key, "e.kind", "e.body")
    tag = lambda n: F.trim(F.regexp_extract("body", rf"(?s)<{n}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{n}>", 1))
    return e.select(key, tag("loc").alias("loc"), tag("lastmod").alias("lastmod"), "kind").where("loc <> ''")


def probed(fetched: DataFrame, files: dict[str, str]) -> DataFrame:
    """(host, a column for each name) of fetched (url, status): whether the host serves that path with 200; never asked counts as no."""
    from sitequarry.functions.url import hostname, path

    host, at = hostname(F.col("url")), path(F.col("url"))
    return fetched.where(host != "").groupBy(host.alias("host")).agg(*[F.coalesce(F.bool_or((at == p) & (F.col("status") == 200)), F.lit(False)).alias(n) for n, p in files.items()])


def guarded(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would run as a formula get an apostrophe in front."""
    return df.select(*[F.when(F.col(n).rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), F.col(n))).otherwise(F.col(n)).alias(n) if kind == "string" else F.col(n) for n, kind in df.dtypes])


def flat(df: DataFrame, bar: str = "|") -> DataFrame:
    """Columns as CSV has them: booleans yes and no, lists joined."""

    def one(name: str, kind: str):
        c = F.col(name)
        return (F.when(c, "yes").when(~c, "no") if kind == "boolean" else F.array_join(c, bar) if kind.startswith("array") else c).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def save_crawl(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table by crawl_id; a crawl that is saved again replaces its own partitions only.  `crawls` goes last: it marks the rest as whole."""
    for name in sorted(tables, key=lambda n: n == "crawls"):
        tables[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id").parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    guarded(flat(df)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
