"""Percentiles of large numeric columns by merging centroid digests.

A digest is a list of centroids (mean, weight, least and greatest value) in order. Sorted
values are clustered under the size function k(q) = c / (2 pi) * asin(2 q - 1): values
or centroids whose middle falls between the same two whole numbers of k form one
centroid, so centroids are small at the tails and hold at most about pi / (2 c) of the
weight in the middle. Digests of partitions, loads or days merge by clustering all
their centroids again.

Every task makes digests of its own rows before anything is shuffled, so a group with
a third of all rows sends one short digest a task. The rank error of an estimate is
certified by a second pass that counts the values below and at it. Where an exact
percentile is asked for, that pass also counts the values between two digest bounds,
and the true order statistic is read off there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, kept, shuffle_partitions

#: c of the size function; the number of centroids of a digest is at most about this.
COMPRESSION = 200
#: Rows of a task that are digested together; bounds its memory.
HELD = 1 << 20
#: Distinct values of a group that are ordered in one window at most; more are ordered over ranges of value.
WINDOW_VALUES = 1 << 18

DIGEST_DDL = "g string, mean array<double>, weight array<bigint>, low array<double>, high array<double>"
SCHEMA = pa.schema([("g", pa.string()), ("mean", pa.list_(pa.float64())), ("weight", pa.list_(pa.int64())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _cluster(g: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, compression: int):
    """Centroids of each group (numbers from 0) clustered under the size function; sorted by group and mean."""
    order = np.lexsort((mean, g))
    g, mean, weight, low, high = g[order], mean[order], weight[order], low[order], high[order]
    heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    total = np.add.reduceat(weight, heads)
    sizes = np.diff(np.append(heads, len(g)))
    before = np.cumsum(weight) - weight
    before = before - np.repeat(before[heads], sizes)
    q = (before + weight / 2) / np.repeat(total, sizes)
    k = np.floor(compression / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1)))
    # Equal values belong together whatever k says: that loses nothing. Where they fill more than one step of k they stay by themselves.
    same = (g[1:] == g[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1]) & (high[1:] == low[1:])
    run = np.flatnonzero(np.append(True, ~same))
    wide = k[run] != k[np.append(run[1:], len(k)) - 1]
    new = np.zeros(len(g), bool)
    new[run] = np.append(True, (g[run[1:]] != g[run[1:] - 1]) | (k[run[1:]] != k[run[1:] - 1]) | wide[1:] | wide[:-1])
    cut_ = np.flatnonzero(new)
    w = np.add.reduceat(weight, cut_)
    return g[cut_], np.add.reduceat(mean * weight, cut_) / w, w, np.minimum.reduceat(low, cut_), np.maximum.reduceat(high, cut_)


def _batch(names: np.ndarray, g, mean, weight, low, high) -> pa.RecordBatch:
    heads = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    at = pa.array(np.append(heads, len(g)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (mean, weight.astype(np.int64), low, high)]
    return pa.RecordBatch.from_arrays([pa.array(names[g[heads]], pa.string()), *lists], schema=SCHEMA)


def _digest_rows(compression: int):
    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        codes, names = pd.factorize(t.column("g").to_numpy())
        v = t.column("v").to_numpy()
        return _batch(names, *_cluster(codes, v, np.ones(len(v), np.int64), v, v, compression))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return work


def _merge(compression: int):
    """Merges digests that arrive sorted by group; a group that goes on is carried merged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(c) for c in ("mean", "weight", "low", "high")]
            g = np.repeat(batch.column("g").to_numpy(zero_copy_only=False), np.asarray(lists[0].value_lengths()))
            cols = [g, *(np.asarray(x.flatten()) for x in lists)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            codes, names = pd.factorize(cols[0])
            out = _cluster(codes, *cols[1:], compression)
            last = names[out[0]] == batch.column("g")[batch.num_rows - 1].as_py()
            yield _batch(names, *(x[~last] for x in out))
            rest = (names[out[0][last]], *(x[last] for x in out[1:]))
        if rest is not None:
            codes, names = pd.factorize(rest[0])
            yield _batch(names, codes, *rest[1:])

    return work


def digest(df: DataFrame, group: str, value: str, compression: int = COMPRESSION) -> DataFrame:
    """One digest a group: g, mean, weight, low, high (arrays in order).

    Rows with a null group or a null, NaN or infinite value are left out; an empty string is a
    group; repeated rows are values of their own; an empty table gives no digests.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null and not isnan(v) and abs(v) < double('infinity')")
    return merge_digests(rows.mapInArrow(_digest_rows(compression), DIGEST_DDL), compression)


def merge_digests(digests: DataFrame, compression: int = COMPRESSION) -> DataFrame:
    """Digests of the same groups, of any number of loads, merged to one a group."""
    return digests.repartition("g").sortWithinPartitions("g").mapInArrow(_merge(compression), DIGEST_DDL)


def digest_quantiles(digests: DataFrame, quantiles: list[float]) -> DataFrame:
    """(g, n, q, estimate): the centroid in which rank q * n falls, by a straight line between its least and greatest value.

    A centroid of equal values is that value, so groups with few values are exact; else
    the rank is off by a centroid's weight at most where digests don't interleave.
    """
    n = F.aggregate("weight", F.lit(0).cast("bigint"), lambda s, w: s + w).alias("n")
    spread = digests.select("g", n, F.arrays_zip("weight", "low", "high").alias("c"))
    start = F.struct(F.lit(0).cast("bigint").alias("cum"), F.lit(None).cast("double").alias("x"))

    def estimate(q: float):
        target = F.col("n") * F.lit(q)

        def step(s, c):
            here = c["low"] + (c["high"] - c["low"]) * (target - s["cum"]) / c["weight"]
            return F.struct((s["cum"] + c["weight"]).alias("cum"), F.coalesce(s["x"], F.when(s["cum"] + c["weight"] >= target, here)).alias("x"))

        return F.coalesce(F.aggregate("c", start, step)["x"], F.element_at("c", -1)["high"])

    return spread.select("g", "n", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), estimate(q).alias("estimate")) for q in quantiles])).alias("e")).select("g", "n", "e.q", "e.estimate")


def certify(df: DataFrame, group: str, value: str, estimates: DataFrame) -> DataFrame:
    """(g, n, q, estimate, rank_error): the second pass, counting values below and at each estimate.

    rank_error is the least distance of q from the ranks (as shares) that the estimate
    truly holds among the group's values; 0 if q is among them.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null and not isnan(v) and abs(v) < double('infinity')")
    per = estimates.groupBy("g").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("q", "estimate"))).alias("e"))
    # Equal values of a group are one row before they meet the estimates.
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    one = counted.join(per, "g").select("g", "n", "v", "c", F.inline("e"))
    one = one.groupBy("g", "n", "q", "estimate").agg(F.sum(F.when(F.col("v") < F.col("estimate"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("estimate"), F.col("c")).otherwise(0)).alias("upto"))
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("q"), F.col("q") - F.col("upto") / F.col("n"))
    return one.select("g", "n", "q", "estimate", error.alias("rank_error"))


def median_bounds(digests: DataFrame, slack: float, least: int = 1) -> DataFrame:
    """(g, n, lo, hi): bounds between which the median lies, by the digest, with slack * n ranks on both sides.

    lo equals hi where the digest holds the middle values unmixed in one centroid.
    """
    n = F.aggregate("weight", F.lit(0).cast("bigint"), lambda s, w: s + w)
    c = digests.select("g", n.alias("n"), F.arrays_zip("weight", "low", "high").alias("c")).where(F.col("n") >= least)
    exact = c.where(F.size("c") == 1).select("g", "n", F.col("c")[0]["low"].alias("lo"), F.col("c")[0]["high"].alias("hi"))
    start = F.struct(F.lit(0).cast("bigint").alias("cum"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    # Without mixed centroids ranks are exact and need no slack.
    pure = F.forall("c", lambda x: x["low"] == x["high"])
    room = F.when(pure, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), F.col("n") * F.lit(slack)))
    first, second = F.floor((F.col("n") + 1) / 2) - room, F.floor((F.col("n") + 2) / 2) + room

    def step(s, x):
        cum = s["cum"] + x["weight"]
        meets = (cum >= first) & (s["cum"] + 1 <= second)
        return F.struct(cum.alias("cum"), F.when(meets, F.least(s["lo"], x["low"])).otherwise(s["lo"]).alias("lo"), F.when(meets, F.greatest(s["hi"], x["high"])).otherwise(s["hi"]).alias("hi"))

    many = c.where(F.size("c") > 1).withColumn("s", F.aggregate("c", start, step)).select("g", "n", "s.lo", "s.hi", pure.alias("pure"))
    return many.unionByName(exact.withColumn("pure", F.col("lo") == F.col("hi")))


def exact_medians(rows: DataFrame, bounds: DataFrame, most: int = WINDOW_VALUES) -> tuple[DataFrame, DataFrame]:
    """(g, n, median): exact, by counting (g, v) rows below and between the bounds; and (g, n) of the groups whose bounds don't hold their middle.

    The latter are counted over their whole range.
    """
    joined = rows.join(bounds.where("not pure").drop("pure"), "g").where(F.col("v") <= F.col("hi"))
    counted = joined.groupBy("g", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    first = cut(_order_statistics(counted, most))
    lost = cut(bounds.where("not pure").join(first.select("g"), "g", "left_anti").select("g", "n"))
    out = bounds.where("pure").select("g", "n", ((F.col("lo") + F.col("hi")) / 2).alias("median")).unionByName(first)
    if not lost.isEmpty():
        out = out.unionByName(_order_statistics(rows.join(lost, "g").groupBy("g", "n", "v").agg(F.count("*").alias("c")), most))
    return out, lost


def _order_statistics(counted: DataFrame, most: int) -> DataFrame:
    """(g, n, median) of groups whose two middle ranks lie on counted values; a null value stands for all below.

    Groups with up to most counted values are ordered in a window; those with more are
    put into ranges of value, and the counts of the ranges before give a range's first rank.
    """
    counted = kept(counted)
    large = cut(counted.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > most).select("g"))
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first())
    if large.isEmpty():
        return _middle(counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    few = counted.join(large, "g", "left_anti").withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _middle(few).unionByName(_middle(_ranked(counted.join(large, "g", "left_semi"))))


def _middle(c: DataFrame) -> DataFrame:
    c = c.withColumn("before", F.col("upto") - F.col("c"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    holds = lambda r: (F.col("before") < r) & (F.col("upto") >= r) & F.col("v").isNotNull()
    m = c.groupBy("g", "n").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    return m.where("a is not null and b is not null").select("g", "n", ((F.col("a") + F.col("b")) / 2).alias("median"))


def _ranked(counted: DataFrame) -> DataFrame:
    """counted with upto, the rows of the group up to and at v; every group may lie in many ranges."""
    n = shuffle_partitions(counted.sparkSession)
    ranges = cut(counted.repartitionByRange(n, "g", F.col("v").asc_nulls_first()).withColumn("pid", F.spark_partition_id()))
    # Few rows: one for each range and group that lies in it.
    sums = ranges.groupBy("g", "pid").agg(F.sum("c").alias("here"))
    before = sums.withColumn("ahead", F.coalesce(F.sum("here").over(Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("here")
    w = Window.partitionBy("g", "pid").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return ranges.join(before, ["g", "pid"]).withColumn("upto", F.col("ahead") + F.sum("c").over(w)).drop("ahead", "pid")


def far_from_median(df: DataFrame, row_id: str, group: str, value: str, least: int = 20, factor: float = 2.0, compression: int = COMPRESSION, most: int = WINDOW_VALUES) -> DataFrame:
    """(row_id, group, value, median) of rows above factor times, or below 1 / factor of, their group's exact median.

    Groups with fewer than least rows have no cases. Digests bound every median, a
    counting pass makes it exact, and only rows outside the bounds' reach can be cases;
    of a group whose bounds miss its middle all rows are looked at. Null groups and null,
    NaN or infinite values are left out; df has one row an id.
    """
    rows = kept(df.select(F.col(row_id).alias("id"), F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null and not isnan(v) and abs(v) < double('infinity')"))
    bounds = cut(median_bounds(digest(rows, "g", "v", compression), 2.0 / compression, least))
    medians, lost = exact_medians(rows.select("g", "v"), bounds, most)
    reach = bounds.join(lost.select("g", F.lit(True).alias("lost")), "g", "left").select("g", "lo", "hi", F.coalesce("lost", F.lit(False)).alias("lost"))
    maybe = rows.join(reach, "g").where(F.col("lost") | (F.col("v") > factor * F.col("lo")) | (factor * F.col("v") < F.col("hi"))).drop("lo", "hi", "lost")
    found = maybe.join(medians.select("g", "median"), "g").where((F.col("v") > factor * F.col("median")) | (factor * F.col("v") < F.col("median")))
    return found.select("id", "g", "v", "median")
