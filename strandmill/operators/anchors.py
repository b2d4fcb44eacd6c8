"""The plan of anchors: how many members of each class are taken, and which."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import largest_groups, proportional_quotas, sample_by_quota, sample_per_group, seeded_order

# The quotas by class.
EXHAUSTIVE = {"Abi": 680, "group II-like": 827}
RANDOM = {"DGR": 1000, "CRISPR-assoc": 1000, "retron": 1000, "group II intron": 500}
CONTROLS = {"retron": 1}
PROPORTIONAL, WHOLE_BELOW = {"UG": 700}, 30
PER_CLADE = {"novel": 60}
LINEAGES, SINGLETONS = {"unplaced": 440}, {"unplaced": 200}


def _up_to(df: DataFrame, quotas: dict[str, int], order) -> DataFrame:
    """The first rows of each named class, as many as its quota."""
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("rt_class") == name, n).otherwise(quota)
    w = Window.partitionBy("rt_class").orderBy(order, "rt_id")
    ranked = df.where(F.col("rt_class").isin(*quotas)).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(quotas.values()))
    return ranked.where(F.col("__rn") <= quota).drop("__rn")


def plan_anchors(anchors: DataFrame, seed: int = 1, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """(rt_id, rt_class, clade, part, control): the anchors taken of each class.

    anchors: rt_id (distinct), rt_class, clade (null or empty if none) and kind, one of
    member, control and singleton (anything else is a member). Classes are taken by their
    first members in order of id, by a seeded sample, in proportion to their clades (small
    ones whole), so many a clade, or one of each of the largest lineages and a sample of
    singletons; an anchor with a clade counts there whatever its kind is. Rows without an
    id are left out; a class without anchors gives none.
    """
    a = anchors.where("rt_id is not null").select("rt_id", "rt_class", "clade", "kind")
    kind = F.coalesce("kind", F.lit("member"))
    members, controls, singles = a.where(~kind.isin("control", "singleton")), a.where(kind == "control"), a.where(kind == "singleton")
    in_clade = a.where("clade is not null and clade <> ''")
    of = lambda quotas, df=in_clade: df.where(F.col("rt_class").isin(*quotas))
    sizes = of(PROPORTIONAL).groupBy("rt_class", "clade").agg(F.count("*").alias("size"))
    (_, total), (_, clade_n), (_, lineages) = (next(iter(q.items())) for q in (PROPORTIONAL, PER_CLADE, LINEAGES))
    largest = largest_groups(of(LINEAGES), ["rt_class"], "clade", "rt_id", lineages, seed).select("rt_id", "rt_class", "clade")
    parts = {
        "first": _up_to(members, EXHAUSTIVE, F.lit("")),
        "random": _up_to(members, RANDOM, seeded_order("rt_id", seed)),
        "control": _up_to(controls, CONTROLS, F.lit("")),
        "proportional": sample_by_quota(of(PROPORTIONAL), proportional_quotas(sizes, ["rt_class"], "clade", "size", total, whole_below), ["rt_class", "clade"], "rt_id", seed, total),
        "clade": sample_per_group(of(PER_CLADE), ["rt_class", "clade"], "rt_id", clade_n, seed),
        "lineage": largest,
        "singleton": _up_to(singles, SINGLETONS, seeded_order("rt_id", seed)),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select("rt_id", "rt_class", "clade", F.lit(name).alias("part"), F.lit(name == "control").alias("control"))
        out = rows if out is None else out.unionByName(rows)
    return out
