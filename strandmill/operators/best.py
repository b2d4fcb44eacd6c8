"""Best rows and representatives per key, with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total for the kept columns.

    Spark prunes the ranking on the map side (a window group limit), so a hot key sends
    one row a task. Null keys form a group of their own; an empty table gives no rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_by_content(df: DataFrame, content: str, ordinal: str) -> DataFrame:
    """One (content, first ordinal, copies) row for each distinct non-null content, counted on the map side first.

    For long contents pass a digest of them, so that the shuffle carries no texts.
    """
    return df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(ordinal).alias(ordinal), F.count("*").alias("copies"))


def floor_rank_quantile(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, n, value): the value at rank floor(q * (n - 1)), counted from 0, of each key's values in order.

    Values are counted before they are ordered: a hot key's window holds its distinct
    values only. Null values count as 0, as a missing length does; null keys are left out.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.coalesce(F.col(value), F.lit(0)).alias("value")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("key")
    c = counts.withColumn("upto", F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = F.floor(F.lit(q) * (F.col("n") - 1)) + 1
    return c.where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select("key", "n", "value")


def nearest_to_quantile(df: DataFrame, key: str, row_id: str, value: str, q: float = 0.8) -> DataFrame:
    """(key, row_id): of each key the row nearest to its floor-rank quantile, ties to the smallest id."""
    target = floor_rank_quantile(df, key, value, q).select(F.col("key"), F.col("value").alias("target"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(row_id).alias("row_id"), F.coalesce(F.col(value), F.lit(0)).alias("value"))
    # Of equal values only the smallest id can win: one row for each key and value remains.
    rows = rows.groupBy("key", "value").agg(F.min("row_id").alias("row_id"))
    near = rows.join(target, "key").withColumn("off", F.abs(F.col("value") - F.col("target")))
    return best_per_key(near, ["key"], [F.col("off"), F.col("row_id")]).select("key", "row_id")


def missing_references(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Distinct non-null keys of df that lookup does not have."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    return keys.join(lookup.select(F.col(lookup_key).alias("key")).distinct(), "key", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of new replace those of old with the same key; within each side the first in order counts."""
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    return best_per_key(both, keys, [F.col("__side").desc(), *order]).drop("__side")


def set_difference_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the distinct non-null keys that only one side has; empty if the sets are equal."""
    a = left.select(F.col(key).alias("key")).where("key is not null").distinct()
    b = right.select(F.col(key).alias("key")).where("key is not null").distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "key", "left_anti").withColumn("side", F.lit("right")))
