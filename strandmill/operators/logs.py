"""Summaries of append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary_by(df: DataFrame, group: str, measures: dict[str, Column]) -> DataFrame:
    """Rows per group with sums of measures; null measures count as 0."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in measures.items()])


def task_kind(extra: Column, stage: Column) -> Column:
    """The kind that a task's JSON names, else one by its stage; broken or empty JSON names none."""
    told = F.get_json_object(F.when(extra != "", extra), "$.kind")
    return F.coalesce(told, F.when(stage == "reports", "report_writing").otherwise("analysis"))


def latest_state(df: DataFrame, key: Column, at: str, columns: list[str]) -> DataFrame:
    """key and columns of each key's latest row; equal times go to the greatest values in column order."""
    last = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.max(F.struct(at, *columns)).alias("last"))
    return last.select("key", *[F.col(f"last.{c}").alias(c) for c in [at, *columns]])


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows that no finished row equals in all keys; null keys equal each other."""
    d = done.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = planned[k].eqNullSafe(d[f"__{k}"])
        on = same if on is None else on & same
    return planned.join(d, on, "left_anti")
