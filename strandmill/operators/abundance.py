"""Length-normalised abundance and alignment filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Least mapping quality, the flag of properly paired reads, greatest template length.
MIN_MAPQ, PROPER_PAIR, MAX_TEMPLATE = 10, 2, 1500


def tpm(counts: DataFrame, library: str, length: str, fragments: str) -> DataFrame:
    """counts with tpm: fragments per length, scaled so that each library sums to a million; 0 where it has none.

    Library totals are pre-aggregated and joined back, so no library is gathered in one
    task. Rows of unknown or non-positive length have a rate of 0.
    """
    rate = F.when(F.col(length) > 0, F.coalesce(F.col(fragments), F.lit(0)) / F.col(length)).otherwise(0.0)
    rated = counts.withColumn("__rate", rate)
    totals = rated.groupBy(library).agg(F.sum("__rate").alias("__total"))
    joined = rated.join(totals, rated[library].eqNullSafe(totals[library])).drop(totals[library])
    return joined.withColumn("tpm", F.when(F.col("__total") > 0, F.col("__rate") / F.col("__total") * 1e6).otherwise(0.0)).drop("__rate", "__total")


def share_of_total(df: DataFrame, group: str, value: str, of: str) -> DataFrame:
    """(group, share): the part of value in rows where the boolean column of holds."""
    g = df.groupBy(group).agg(F.sum(F.when(F.col(of), F.col(value)).otherwise(0)).alias("part"), F.sum(value).alias("whole"))
    return g.select(group, F.when(F.col("whole") != 0, F.col("part") / F.col("whole")).otherwise(0.0).alias("share"))


def proper_alignments(df: DataFrame, mapq: str = "mapq", flag: str = "flag", template: str = "tlen") -> DataFrame:
    """Rows of sufficient mapping quality, properly paired, with a template of at most MAX_TEMPLATE either way."""
    return df.where((F.col(mapq) >= MIN_MAPQ) & (F.col(flag).bitwiseAND(F.lit(PROPER_PAIR)) != 0) & F.col(template).between(-MAX_TEMPLATE, MAX_TEMPLATE))


def rank_latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """df with age, 0 for the latest row of a key; equal times share an age."""
    return df.withColumn("age", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at))) - 1)
