"""Link graph: degrees, rank, breadth-first levels, orphans, and the links that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.operators.shared import cut, discard


def edges_between(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct links (source, target) between crawled pages, without those to themselves."""
    known = pages.select("norm").distinct()
    found = links.where("source <> target").select("source", "target").distinct()
    return found.join(known.withColumnRenamed("norm", "target"), "target", "left_semi").join(known.withColumnRenamed("norm", "source"), "source", "left_semi")


def incoming(links: DataFrame) -> DataFrame:
    return links.where("source <> target").groupBy("target").agg(F.count_distinct("source").alias("n_sources"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count_distinct("target").alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, rank, score) after so many synchronous rounds; score is the share of the highest rank, 0 to 100.

    Rank starts at 1/N; that of nodes without links isn't passed on.  Edges are dealt by source once and carry the degree; each
    round sums by target.  Every few rounds the ranks go through the shared folder.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"), F.lit(0).cast("long").alias("score"))
    carried = cut(edges.join(out_degree(edges), "source").select("source", "target", "degree"))
    rank = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    kept = None
    for i in range(1, rounds + 1):
        given = carried.join(rank.withColumnRenamed("node", "source"), "source").groupBy("target").agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        rank = nodes.select("node").join(given.withColumnRenamed("target", "node"), "node", "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if i % every == 0:
            rank = cut(rank)
            if kept is not None:
                discard(kept)
            kept = rank
    top = rank.agg(F.max("rank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("node", "rank", F.floor(F.col("rank") / F.greatest("top", F.lit(1e-9)) * 100 + 0.5).cast("long").alias("score"))


def levels(seeds: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(node, level) of the nodes that breadth-first search reaches from the seeds (node)."""
    seen = cut(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, most + 1):
        front = cut(front.join(edges, front.node == edges.source).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def orphans(pages: DataFrame, links: DataFrame, root: str = "") -> DataFrame:
    """Served pages that no other page links to, but for the root."""
    return pages.where((F.col("status") == 200) & (F.col("norm") != root)).join(links.where("source <> target").select(F.col("target").alias("norm")), "norm", "left_anti")


def lonely(pages: DataFrame, links: DataFrame, root: str = "") -> DataFrame:
    """Served pages that exactly one other page links to, but for the root, with the finding's id."""
    few = incoming(links).where("n_sources = 1").select(F.col("target").alias("norm"))
    return pages.where((F.col("status") == 200) & (F.col("norm") != root)).join(few, "norm", "left_semi").withColumn("issue_id", F.lit("single_incoming_link"))


def with_status(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with the status of their target: null where it wasn't crawled."""
    status = pages.groupBy(F.col("norm").alias("target")).agg(F.min("status").alias("target_status"))
    return links.join(status, "target", "left")


def link_issues(links: DataFrame) -> DataFrame:
    """One row for each pair of pages whose link is broken or moved; of several links the first counts."""
    from sitequarry.operators.store import first_per_key

    one = first_per_key(links, ["source", "target"], [F.col("page_id"), F.col("pos")])
    inside = F.col("internal") if "internal" in links.columns else F.lit(True)
    kind = F.when((F.col("target_status") >= 400) & ~inside, "broken_external_link").when(~inside, None).when(F.col("target_status") >= 400, "broken_internal_link").when(F.col("target_status").between(300, 399), "redirecting_internal_link")
    return one.withColumn("issue_id", kind).where("issue_id is not null")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the least node that can be reached, by alternating large and small stars.

    Rounds grow with the logarithm of the nodes, not with the length of a chain; each goes through the shared folder.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(down.select("m", "b")).where("a <> b").distinct()
        last, now = now, cut(small)
        discard(last)
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a")).distinct()


def stars(pairs: DataFrame) -> DataFrame:
    """(node, centre) of the nodes of pairs (a, b): greedy clusters in the order of nodes.

    The least node is a centre and takes its neighbours, then the least that is left, and so on: a node is a centre if and only if no
    smaller neighbour is one, and belongs to its least centre.  Each round decides all nodes whose smaller neighbours are decided.
    """
    down = cut(pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).where("node <> low").distinct())
    nodes = cut(down.select("node").union(down.select("low")).distinct())
    total = nodes.count()
    done = cut(nodes.join(down, "node", "left_anti").select("node", F.col("node").alias("centre")))
    while done.count() < total:
        left = nodes.join(done, "node", "left_anti")
        told = down.join(left, "node", "left_semi").join(done.select(F.col("node").alias("low"), "centre"), "low", "left")
        each = told.groupBy("node").agg(F.min(F.when(F.col("centre") == F.col("low"), F.col("low"))).alias("c"), F.min(F.when(F.col("centre").isNull(), F.col("low"))).alias("open"))
        # Taken by its least centre once no smaller neighbour that is still open could become one; a centre once none is open and none is one.
        new = each.where("open is null or c < open").select("node", F.coalesce("c", "node").alias("centre"))
        last, done = done, cut(done.unionByName(new))
        discard(last)
    discard(nodes, down)
    return done
