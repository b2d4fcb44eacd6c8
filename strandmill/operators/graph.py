"""Reachability and components over edge tables, by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


#: Rounds after which what has been reached is written as one, so that plans stay small.
PIECES = 8


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, without loops, repeats and nulls."""
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, hops): everything that paths along edges reach from the sources (column node), which have 0 hops.

    Each round joins the newest nodes only and is cut at a checkpoint; the rounds are as
    many as the longest shortest path. Sources without edges are in the result.
    """
    links = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = frontier = cut(sources.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)))
    hops = 0
    while not frontier.isEmpty():
        hops += 1
        if hops % PIECES == 0:
            seen = cut(seen)
        step = frontier.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hops)))
        seen = seen.unionByName(frontier)
    return seen


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(20, 0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of an undirected edge table, named by their smallest node.

    Large-star and small-star rounds: every node sends its neighbours to the smallest
    one it knows, until no edge changes; the edges never outgrow the input.
    """
    star = cut(edges.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).where("low is not null and high is not null and low <> high").distinct())
    sums = _sums(star)
    while True:
        both = star.unionByName(star.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy(F.col("low").alias("u")).agg(F.least(F.min("high"), F.first("low")).alias("m"))
        large = both.join(least, both.low == least.u).where("high > u").select(F.col("m").alias("low"), "high").distinct()
        lower = large.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        small = large.join(lower, large.high == lower.u)
        small = small.select(F.col("m").alias("low"), F.col("low").alias("high")).unionByName(lower.select(F.col("m").alias("low"), F.col("u").alias("high"))).where("low <> high").distinct()
        new = cut(small)
        # Sums of hashes differ in all rounds but the last; only then the edges themselves are compared.
        sums, before = _sums(new), sums
        same = sums == before and new.exceptAll(star).isEmpty() and star.exceptAll(new).isEmpty()
        star = new
        if same:
            break
    return star.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(star.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
