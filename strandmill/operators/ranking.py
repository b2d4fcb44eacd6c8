"""Pairwise games and Bradley-Terry strengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: The least strength; strengths of up to so many names (counted) are broadcast, more are joined by shuffle.
LEAST_STRENGTH, BROADCAST_NAMES = 1e-6, 20_000
#: Pairs that are fitted without a job an iteration.
SMALL_PAIRS = 10_000


def pair_wins(scores: DataFrame, game: str, name: str, score: str) -> DataFrame:
    """(a, b, wins_a, wins_b) for every pair a < b that met in a game; the higher score wins, ties are discarded.

    scores has one row a game and name; the number of names in one game is small. Null
    and NaN scores do not play.
    """
    s = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(game).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("n"), F.col(score).alias("s")))).alias("xs")).where(F.size("xs") > 1)
    left = s.select("xs", F.posexplode("xs").alias("i", "x"))
    games = left.select("x", F.explode(F.expr("slice(xs, i + 2, size(xs))")).alias("y"))
    games = games.select(F.col("x.n").alias("a"), F.col("y.n").alias("b"), (F.col("x.s") > F.col("y.s")).cast("int").alias("wa"), (F.col("x.s") < F.col("y.s")).cast("int").alias("wb")).where("wa + wb > 0")
    return games.groupBy("a", "b").agg(F.sum("wa").alias("wins_a"), F.sum("wb").alias("wins_b"))


def _fit_small(rows: list, iterations: int, tolerance: float) -> list[tuple]:
    """(name, wins, strength) of at most SMALL_PAIRS rows of a pair table."""
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    games, wins = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in rows:
        i, j = at[r["a"]], at[r["b"]]
        games[i, j] = games[j, i] = r["wins_a"] + r["wins_b"]
        wins[i] += r["wins_a"]
        wins[j] += r["wins_b"]
    p = np.ones(len(names))
    for _ in range(iterations if wins.sum() else 0):
        rate = (games / (p[:, None] + p[None, :])).sum(1)
        new = np.where(rate > 0, wins / np.where(rate > 0, rate, 1), p)
        moved, p = np.abs(new - p).max(), np.maximum(new / new.sum() * len(names), LEAST_STRENGTH)
        if moved < tolerance:
            break
    return [(n, int(wins[i]), float(p[i])) for n, i in at.items()]


def bradley_terry(pairs: DataFrame, iterations: int = 200, tolerance: float = 1e-8, small: int = SMALL_PAIRS) -> DataFrame:
    """(name, wins, strength) fitted to a pair table, strengths summing to the number of names; all 1 without wins.

    A pair table of at most small rows (counted) is fitted at once, where a job an
    iteration would only cost time; any larger one by Spark, with the same steps: each iteration is a join of the pair table with the strengths and a sum by name. The
    driver sees two numbers an iteration: the sum of the strengths, by which they are
    scaled, and their greatest change.
    """
    pairs = cut(pairs)
    if len(rows := pairs.limit(small + 1).collect()) <= small:
        return pairs.sparkSession.createDataFrame(_fit_small(rows, iterations, tolerance), "name string, wins bigint, strength double")
    one = pairs.select(F.col("a").alias("name"), F.col("b").alias("other"), F.col("wins_a").alias("wins"), (F.col("wins_a") + F.col("wins_b")).alias("games"))
    two = pairs.select(F.col("b").alias("name"), F.col("a").alias("other"), F.col("wins_b").alias("wins"), (F.col("wins_a") + F.col("wins_b")).alias("games"))
    met = cut(one.unionByName(two))
    names = cut(met.groupBy("name").agg(F.sum("wins").cast("bigint").alias("wins")).withColumn("strength", F.lit(1.0)))
    n, won = names.agg(F.count("*"), F.coalesce(F.sum("wins"), F.lit(0))).first()
    hint = F.broadcast if n <= BROADCAST_NAMES else lambda df: df
    for _ in range(iterations if won else 0):
        theirs = names.select(F.col("name").alias("other"), F.col("strength").alias("q"))
        rate = met.join(hint(names.select("name", F.col("strength").alias("p"))), "name").join(hint(theirs), "other").groupBy("name").agg(F.sum(F.col("games") / (F.col("p") + F.col("q"))).alias("rate"))
        new = hint(names).join(rate, "name").select("name", "wins", F.col("strength").alias("before"), F.when(F.col("rate") > 0, F.col("wins") / F.col("rate")).otherwise(F.col("strength")).alias("strength"))
        new = cut(new)
        total, moved = new.agg(F.sum("strength"), F.max(F.abs(F.col("strength") - F.col("before")))).first()
        names = new.select("name", "wins", F.greatest(F.lit(LEAST_STRENGTH), F.col("strength") * (n / total)).alias("strength"))
        if moved < tolerance:
            break
    return names
