"""Items that appear together: co-occurrence stripes and their significance.

A record's items become one sorted array. Every task turns its arrays into stripes
(item -> counts of the neighbours after it) and merges them in memory before it sends
one associative array an item; these are merged by item. Two exact prunings come
first: a pair can't occur more often than its rarer item, and at a lift of L no item
of a wanted pair is in more than N / L records. Very common items, which would make
most pairs, never reach a stripe when a minimum lift is asked for.

A record with more items than a block is never held whole nor crossed with itself while
a scope has fewer of them than a pair's least count: a wanted pair must then occur in
some smaller record too, so pairs are counted there with a lower bound, and what the
large records add is looked up for those pairs only, from the few large records that
each item is in. Where there are more, a large record's items are dealt to blocks and
each pair of blocks is a task's group of its own. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items of one record that form a block.
BLOCK = 512
#: Pair counts that a task holds before it merges them, and after merging before it sends them.
HELD = 4_000_000
#: Neighbours of one stripe; an item with more sends several stripes, which its merge adds up.
STRIPE = 1024

STRIPES = pa.schema([("a", pa.int64()), ("b", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal pairs added up; sorted by a, then b."""
    if not len(a):
        return a, b, n
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    pair = codes[: len(a)].astype(np.int64) * len(names) + codes[len(a) :]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return names[pair[heads] // len(names)], names[pair[heads] % len(names)], np.add.reduceat(n[order], heads)


def _stripes(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    number = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    heads = np.flatnonzero(number % STRIPE == 0)
    at = pa.array(np.append(heads, len(a)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(a[heads]), pa.ListArray.from_arrays(at, pa.array(b)), pa.ListArray.from_arrays(at, pa.array(n))], schema=STRIPES)


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of the arrays of a batch; left and right are the same array, or two blocks of one record."""
    sides = []
    for name in ("left", "right"):
        c = batch.column(name)
        sides.append((c.flatten().to_numpy(zero_copy_only=False), np.asarray(c.value_lengths().fill_null(0))))
    (left, n_left), (right, n_right) = sides
    first = np.append(0, np.cumsum(n_left))
    for size in np.unique(n_left[n_right == 0]):
        if size < 2:
            continue
        x, y = np.triu_indices(size, 1)
        rows = first[:-1][(n_left == size) & (n_right == 0)]
        step = max(1, HELD // len(x))
        for i in range(0, len(rows), step):
            items = left[rows[i : i + step, None] + np.arange(size)]
            yield items[:, x].ravel(), items[:, y].ravel()
    second = np.append(0, np.cumsum(n_right))
    for i in np.flatnonzero(n_right):
        x = np.repeat(left[first[i] : first[i + 1]], n_right[i])
        y = np.tile(right[second[i] : second[i + 1]], n_left[i])
        yield np.minimum(x, y), np.maximum(x, y)


def _make_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        for a, b in _pairs(batch):
            held.append((a, b, np.ones(len(a), np.int64)))
            rows += len(a)
            if rows >= HELD:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                rows = len(held[0][0])
                if rows >= HELD // 2:
                    yield _stripes(*held[0])
                    held, rows = [], 0
    if rows:
        yield _stripes(*_summed(*map(np.concatenate, zip(*held))))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_ab", pa.int64())])


def _merge_stripes(least: int):
    """Merges the stripes of each item, which arrive sorted by item; keeps counts from least on."""

    def out(a, b, n) -> pa.RecordBatch:
        keep = n >= least
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(n[keep])], schema=PAIRS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("b")
            a = np.repeat(np.asarray(batch.column("a")), np.asarray(lists.value_lengths()))
            a, b, n = _summed(*(np.concatenate(x) for x in zip(rest, (a, np.asarray(lists.flatten()), np.asarray(batch.column("n").flatten())))))
            # The last item may go on; it is carried as one merged stripe.
            whole = a != batch.column("a")[batch.num_rows - 1].as_py()
            yield out(a[whole], b[whole], n[whole])
            rest = (a[~whole], b[~whole], n[~whole])
        yield out(*rest)

    return work


NOTHING = "cast(array() as array<bigint>)"


def _whole(kept: DataFrame) -> DataFrame:
    """(left, right): the sorted items of each record, and nothing."""
    return kept.groupBy("scope", "record").agg(F.sort_array(F.collect_list("id")).alias("left")).where(F.size("left") > 1).select("left", F.expr(NOTHING).alias("right"))


def _dealt(kept: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(left, right): the sorted items of each pair of blocks of the large records."""
    dealt = kept.join(large, ["scope", "record"]).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.groupBy("scope", "record", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = dealt.agg(F.sort_array(F.collect_list(F.when(F.col("mine") == F.least("mine", "other"), F.col("id")))).alias("left"), F.sort_array(F.collect_list(F.when(F.col("mine") > F.col("other"), F.col("id")))).alias("right"))
    # A block with itself comes in left alone; without a partner in the other block there is no pair.
    return dealt.where((F.col("i") == F.col("j")) | (F.size("right") > 0)).select("left", "right")


def _count_pairs(arrays: DataFrame, least: int) -> DataFrame:
    stripes = arrays.mapInArrow(_make_stripes, "a bigint, b array<bigint>, n array<bigint>")
    return stripes.repartition("a").sortWithinPartitions("a").mapInArrow(_merge_stripes(least), "a bigint, b bigint, n_ab bigint")


def _pair_counts(kept: DataFrame, least: int, block: int) -> DataFrame:
    """(a, b, n_ab) of the pairs of items that at least least records hold; kept has scope, record, id."""
    large = cut(kept.groupBy("scope", "record").count().where(F.col("count") > block))
    most = large.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    if not most:
        return _count_pairs(_whole(kept), least)
    small = kept.join(large, ["scope", "record"], "left_anti")
    if most >= least:
        return _count_pairs(_whole(small).unionByName(_dealt(kept, large, block)), least)
    # At most `most` records are looked up for an item: an item belongs to one scope.
    inside = kept.join(large, ["scope", "record"]).groupBy("id").agg(F.collect_list("record").alias("in"))
    pairs = _count_pairs(_whole(small), least - most)
    pairs = pairs.join(inside.select(F.col("id").alias("a"), F.col("in").alias("in_a")), "a", "left").join(inside.select(F.col("id").alias("b"), F.col("in").alias("in_b")), "b", "left")
    more = F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), F.size(F.array_intersect("in_a", "in_b"))).otherwise(0)
    return pairs.select("a", "b", (F.col("n_ab") + more).alias("n_ab")).where(F.col("n_ab") >= least)


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """G2 of the 2 x 2 table of two items, from their joint, single and total counts."""
    term = lambda k: F.when(k > 0, k * F.log(k.cast("double"))).otherwise(0.0)
    cells = term(n_ab) + term(n_a - n_ab) + term(n_b - n_ab) + term(n - n_a - n_b + n_ab)
    sides = term(n_a) + term(n - n_a) + term(n_b) + term(n - n_b)
    return F.greatest(F.lit(0.0), 2 * (cells - sides + term(n)))


def cooccurrence(df: DataFrame, scope: Column, record: Column, item: Column, min_count: int = 8, min_lift: float = 0.0, min_llr: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(scope, item_a, item_b, n_ab, n_a, n_b, n, lift, llr) of pairs item_a < item_b.

    Within a scope n is the records with at least one item, n_a and n_b those with the
    item, n_ab those with both; lift = n_ab * n / (n_a * n_b). Kept are pairs with n_ab,
    lift and log-likelihood ratio at least as large as asked for. An item counts once in
    a record; null and empty items, null scopes and null records are left out; an empty
    table gives an empty result.
    """
    rows = df.select(scope.alias("scope"), record.alias("record"), item.alias("item")).where("scope is not null and record is not null and item is not null and item <> ''").distinct()
    totals = rows.select("scope", "record").distinct().groupBy("scope").agg(F.count("*").alias("n"))
    items = rows.groupBy("scope", "item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= min_count).join(totals, "scope")
    items = cut(items.where(F.col("n") >= min_lift * F.col("n_item")).withColumn("id", F.monotonically_increasing_id()))
    kept = rows.join(items.select("scope", "item", "id"), ["scope", "item"]).select("scope", "record", "id")
    pairs = _pair_counts(kept, min_count, block)
    one = items.select(F.col("id").alias("a"), "scope", F.col("item").alias("x"), F.col("n_item").alias("n_x"), "n")
    two = items.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("n_item").alias("n_y"))
    named = pairs.join(one, "a").join(two, "b")
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    named = named.select("scope", pick("x", "y").alias("item_a"), pick("y", "x").alias("item_b"), "n_ab", pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"), "n")
    named = named.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).withColumn("llr", log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")))
    return named.where((F.col("n_ab") * F.col("n") >= min_lift * F.col("n_a") * F.col("n_b")) & (F.col("llr") >= min_llr))
