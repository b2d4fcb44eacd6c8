"""Tiered assignment of targets to classes from hit tables and neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .best import best_per_key

# Thresholds of the three tiers, and the labels that name no class.
MARGIN, MIN_SCORE, MIN_COVERAGE, MIN_IDENTITY, NEIGHBOURS = 10.0, 150.0, 0.5, 0.30, 5
NO_CLASS = ("unplaced", "-", "")
#: Least score of tier 1 by class, and of classes that are not named; the paper gives no values of its own for them.
FLOORS = {"retron": 100.0, "UG": 100.0, "group II intron": 100.0, "DGR": 100.0, "CRISPR-assoc": 100.0, "group II-like": 100.0, "Abi": 100.0, "novel": 100.0}
DEFAULT_FLOOR = 100.0


def _two_best(hits: DataFrame) -> DataFrame:
    """(target, rt_class, s1, s2): the best class of each target, its score, and the best score of any other class."""
    ok = hits.where("target_id is not null and rt_class is not null and bitscore is not null and not isnan(bitscore)")
    per = ok.groupBy(F.col("target_id").alias("target"), "rt_class").agg(F.max("bitscore").alias("s"))
    w = Window.partitionBy("target").orderBy(F.desc("s"), "rt_class")
    ranked = per.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return ranked.groupBy("target").agg(F.max(F.when(F.col("rn") == 1, F.col("rt_class"))).alias("rt_class"), F.max(F.when(F.col("rn") == 1, F.col("s"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("s"))).alias("s2"))


def tier1_margin(hits: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(target, rt_class): targets whose best profile beats the best one of any other class by at least margin.

    A target with hits of one class only is assigned to it. Scores are reduced to one a
    class before they are compared; null and NaN scores are left out. This is the margin
    only: tier1_assign is the whole rule of tier 1.
    """
    return _two_best(hits).where(F.col("s2").isNull() | (F.col("s1") - F.col("s2") >= margin)).select("target", "rt_class")


def tier1_assign(hits: DataFrame, floors: dict[str, float] = FLOORS, default_floor: float = DEFAULT_FLOOR, margin: float = MARGIN) -> DataFrame:
    """(target, rt_class): tier1_margin, if the best score also reaches the floor of its class (inclusive)."""
    floor = F.lit(default_floor)
    for name, least in floors.items():
        floor = F.when(F.col("rt_class") == name, least).otherwise(floor)
    clear = F.col("s2").isNull() | (F.col("s1") - F.col("s2") >= margin)
    return _two_best(hits).where(clear & (F.col("s1") >= floor)).select("target", "rt_class")


def tier2_best(hits: DataFrame) -> DataFrame:
    """(target, label): the best hit of each target by score, ties by label, if it passes all three thresholds (inclusive)."""
    ok = hits.where("target_id is not null and bitscore is not null and not isnan(bitscore)")
    best = best_per_key(ok, ["target_id"], [F.desc("bitscore"), F.col("label"), F.desc("coverage"), F.desc("seq_identity")])
    passed = best.where((F.col("bitscore") >= MIN_SCORE) & (F.col("coverage") >= MIN_COVERAGE) & (F.col("seq_identity") >= MIN_IDENTITY))
    return passed.select(F.col("target_id").alias("target"), "label")


def _nearest(neighbours: DataFrame, k: int) -> DataFrame:
    """(target, n, kinds, one, none): number of the k nearest neighbours, of their labels, the first label, and how many carry none."""
    w = Window.partitionBy("target").orderBy("rank", "label")
    near = neighbours.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    label = F.coalesce("label", F.lit(""))
    return near.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct(label).alias("kinds"), F.min(label).alias("one"), F.count_if(label.isin(*NO_CLASS)).alias("none"))


def tier3_neighbours(neighbours: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(target, label): targets whose k nearest neighbours (by rank) carry one label, or `novel` if most carry none.

    Five equal neighbours without a class are novel too. Targets with fewer than k
    neighbours are left out; tier3_assign has them.
    """
    agg = _nearest(neighbours, k).where(F.col("n") == k)
    return agg.select("target", F.when(F.col("none") * 2 > k, "novel").when(F.col("kinds") == 1, F.col("one")).alias("label")).where("label is not null")


def tier3_assign(neighbours: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(target, label): tier3_neighbours, with targets of fewer than k neighbours, which are novel if most of these carry no label.

    One label of all counts only where there are k neighbours.
    """
    agg = _nearest(neighbours, k)
    one = F.when((F.col("n") == k) & (F.col("kinds") == 1), F.col("one"))
    return agg.select("target", F.when(F.col("none") * 2 > F.col("n"), "novel").otherwise(one).alias("label")).where("label is not null")


def classify(tier1: DataFrame, tier2: DataFrame, tier3: DataFrame | None, targets: DataFrame) -> DataFrame:
    """(target, tier, label): the first tier that places a target; `unplaced` otherwise."""
    out = targets.select("target").distinct().join(tier1.select("target", F.col("rt_class").alias("l1")), "target", "left").join(tier2.select("target", F.col("label").alias("l2")), "target", "left")
    out = out.join(tier3.select("target", F.col("label").alias("l3")), "target", "left") if tier3 is not None else out.withColumn("l3", F.lit(None).cast("string"))
    tier = F.when(F.col("l1").isNotNull(), "tier1").when(F.col("l2").isNotNull(), "tier2").when(F.col("l3").isNotNull(), "tier3").otherwise("none")
    return out.select("target", tier.alias("tier"), F.coalesce("l1", "l2", "l3", F.lit("unplaced")).alias("label"))
