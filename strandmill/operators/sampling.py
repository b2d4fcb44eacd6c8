"""Seeded sampling that does not depend on partitioning: rows are ranked by a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(row_id: Column | str, seed: int = 1) -> Column:
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def first_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in the given order, with their rank from 1."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def sample_per_group(df: DataFrame, groups: list[str], row_id: str, n: int, seed: int = 1) -> DataFrame:
    """At most n rows of each group, by seeded order; ids are distinct within a group."""
    w = Window.partitionBy(*groups).orderBy(seeded_order(row_id, seed), row_id)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def proportional_quotas(sizes: DataFrame, scope: list[str], group: str, size: str, total: int, whole_below: int = 30) -> DataFrame:
    """sizes with quota: groups below whole_below are taken whole, the rest share what is left by size.

    Shares are rounded down; what remains goes one each to the largest fractions, ties by
    group name. If the small groups alone exceed total, they share it the same way. A
    quota never exceeds its group, and a shortfall is not given to others.
    """
    w = Window.partitionBy(*scope)
    s = sizes.withColumn("__small", F.col(size) < whole_below)
    s = s.withColumn("__small_sum", F.coalesce(F.sum(F.when(F.col("__small"), F.col(size))).over(w), F.lit(0)))
    over = F.col("__small_sum") > total
    pool = F.when(over, F.col("__small")).otherwise(~F.col("__small"))
    s = s.withColumn("__pool", pool).withColumn("__room", F.when(over, F.lit(total)).otherwise(F.lit(total) - F.col("__small_sum")))
    s = s.withColumn("__pool_sum", F.sum(F.when(F.col("__pool"), F.col(size))).over(w))
    # Whole numbers throughout: quotient and remainder, no rounding of fractions.
    product = F.col(size).cast("bigint") * F.col("__room")
    s = s.withColumn("__floor", F.when(F.col("__pool"), F.expr(f"{size} * __room div __pool_sum"))).withColumn("__rest", F.when(F.col("__pool"), product % F.col("__pool_sum")))
    s = s.withColumn("__left", F.col("__room") - F.sum("__floor").over(w))
    s = s.withColumn("__rank", F.row_number().over(Window.partitionBy(*scope, "__pool").orderBy(F.desc("__rest"), group)))
    share = F.least(F.col(size), F.col("__floor") + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0))
    quota = F.when(F.col("__pool"), share).when(F.col("__small") & ~over, F.col(size)).otherwise(0)
    return s.withColumn("quota", quota.cast("bigint")).drop(*[c for c in s.columns if c.startswith("__")])


def sample_by_quota(df: DataFrame, quotas: DataFrame, keys: list[str], row_id: str, seed: int = 1, most: int | None = None) -> DataFrame:
    """As many rows of each group as its quota says, by seeded order.

    most is the greatest quota (looked up if not given): a group's ranking is pruned to it
    in every task before its rows are shuffled.
    """
    if most is None:
        most = quotas.agg(F.max("quota")).first()[0] or 0
    w = Window.partitionBy(*keys).orderBy(seeded_order(row_id, seed), row_id)
    ranked = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most)
    return ranked.join(quotas.select(*keys, "quota"), keys).where(F.col("__rn") <= F.col("quota")).drop("__rn", "quota")


def largest_groups(df: DataFrame, scope: list[str], group: str, row_id: str, n: int, seed: int = 1) -> DataFrame:
    """One seeded member of each of the n largest groups of a scope; equal sizes by group name."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(*scope, group).agg(F.count("*").alias("size"), F.min(F.struct(seeded_order(row_id, seed).alias("h"), F.col(row_id))).alias("first"))
    w = Window.partitionBy(*scope).orderBy(F.desc("size"), group)
    return sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*scope, group, "rank", "size", F.col(f"first.{row_id}").alias(row_id))
