"""Continuous periods and gaps of overlapping integer intervals, by dyadic blocks.

The coordinate line is cut into bins of 2**16 positions. Inside a bin every interval
is decomposed into its canonical dyadic blocks; blocks covered by an ancestor are
removed, sibling pairs merge upward, and adjacent blocks coalesce into stretches.
Bins that an interval covers wholly form the same problem one stratum higher, over
bin numbers, so that a very long interval costs a few blocks there and never a row
for each position or bin; four strata hold all 64-bit coordinates.

Every task first reduces its own input rows this way (union of covers is
associative), so a bin never receives more than 2**15 stretches from one map task
however many rows repeat there. A key's bins are spread over all tasks. Stretches that
may go on in another bin, at most two a bin, are put into one global order of key and
position, in ranges of about equal size: a hot key lies in many of them, and what a
range hands on to the next is one small row (its last key, how far that is covered, and
where the open period began).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, kept, shuffle_partitions

BITS = 16
SIZE = 1 << BITS
MASK = SIZE - 1
#: Rows that a task holds before it reduces them; bounds its memory, not the result.
COMBINE_ROWS = 1 << 19


def dyadic_cover(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The covered stretches of each group, as (group, lo, hi) sorted by group and lo.

    group holds numbers from 0, lo and hi (both inside) lie in [0, 2**bits).
    """
    left = (group.astype(np.int64) << bits) + lo
    right = (group.astype(np.int64) << bits) + hi + 1
    levels: list[np.ndarray] = []
    for level in range(bits + 1):
        open_ = left < right
        if level == bits:
            levels.append(np.unique(left[open_]))
            break
        odd_left = open_ & ((left & 1) == 1)
        found = [left[odd_left]]
        left = left + odd_left
        odd_right = (left < right) & ((right & 1) == 1)
        right = right - odd_right
        found.append(right[odd_right])
        levels.append(np.unique(np.concatenate(found)))
        left, right = left >> 1, right >> 1

    # Blocks inside a larger one go: dyadic blocks nest or are disjoint, so the start decides.
    starts = np.empty(0, np.int64)
    ends = np.empty(0, np.int64)
    for level in range(bits, -1, -1):
        first = levels[level] << level
        if len(starts) and len(first):
            at = np.searchsorted(starts, first, side="right") - 1
            inside = (at >= 0) & (ends[np.maximum(at, 0)] >= first)
            levels[level] = levels[level][~inside]
            first = first[~inside]
        if len(first):
            starts = np.concatenate([starts, first])
            ends = np.concatenate([ends, first + (1 << level) - 1])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]

    # Two siblings become their parent; a parent made here may pair again one level up.
    for level in range(bits):
        block = levels[level]
        if len(block) > 1:
            pair = np.flatnonzero((block[:-1] & 1 == 0) & (block[1:] == block[:-1] + 1))
            if len(pair):
                levels[level + 1] = np.union1d(levels[level + 1], block[pair] >> 1)
                levels[level] = np.delete(block, np.concatenate([pair, pair + 1]))

    starts = np.concatenate([b << level for level, b in enumerate(levels)])
    ends = np.concatenate([((b + 1) << level) - 1 for level, b in enumerate(levels)])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    if not len(starts):
        return starts, starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != ends[:-1] + 1) | (starts[1:] & ((1 << bits) - 1) == 0)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(starts)) - 1
    lo_, hi_ = starts[head], ends[last]
    return lo_ >> bits, lo_ & ((1 << bits) - 1), hi_ & ((1 << bits) - 1)


PIECE = pa.schema([("k", pa.string()), ("bin", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
PIECE_DDL = "k string, bin bigint, lo int, hi int"


def _covered(k: np.ndarray, bins: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, bin, lo, hi of the covered stretches; groups come in order of their first row."""
    code, names = pd.factorize(k)
    place, places = pd.factorize(bins)
    group, heads = pd.factorize(code.astype(np.int64) * max(1, len(places)) + place)
    g, a, b = dyadic_cover(group, lo, hi)
    of = heads[g]
    return names[of // max(1, len(places))], places[of % max(1, len(places))], a, b


def _table(k, bins, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(bins.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], schema=PIECE)


def _columns(t) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, b, lo, hi = (t.column(n) for n in ("k", "bin", "lo", "hi"))
    return (k.to_numpy(zero_copy_only=False) if isinstance(k, pa.Array) else k.to_numpy(), *(np.asarray(c).astype(np.int64) for c in (b, lo, hi)))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= COMBINE_ROWS:
            yield _table(*_covered(*_columns(pa.Table.from_batches(held))))
            held, rows = [], 0
    if rows:
        yield _table(*_covered(*_columns(pa.Table.from_batches(held))))


def _by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Covered stretches of complete bins, from batches sorted by k and bin."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, b, lo, hi = _columns(batch)
        if rest is not None:
            k, b, lo, hi = (np.concatenate(x) for x in zip(rest, (k, b, lo, hi)))
        open_ = (k == k[-1]) & (b == b[-1])
        if not open_.all():
            yield _covered(k[~open_], b[~open_], lo[~open_], hi[~open_])
        # The bin that may go on in the next batch is carried as its stretches.
        rest = _covered(k[open_], b[open_], lo[open_], hi[open_])
    if rest is not None:
        yield _covered(*rest)


SPAN = pa.schema([("k", pa.string()), ("what", pa.int8()), ("lo", pa.int64()), ("hi", pa.int64())])
SPAN_DDL = "k string, what byte, lo bigint, hi bigint"
#: Final periods and gaps, the first and last stretch of a bin, a run of wholly covered bins, a bin inside such a run.
PERIOD, GAP, FIRST, LAST, WHOLE, INSIDE = range(6)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bin its inner periods and gaps, which are final, and its first and last stretch."""
    for k, b, lo, hi in _by_bin(batches):
        lo, hi = (b << BITS) + lo, (b << BITS) + hi
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        tail = np.append(head[1:], True)
        what = np.select([head, tail], [FIRST, LAST], PERIOD).astype(np.int8)
        inner = np.flatnonzero(~head)
        yield _span_batch(np.concatenate([k, k[inner]]), np.concatenate([what, np.full(len(inner), GAP, np.int8)]), np.concatenate([lo, hi[inner - 1] + 1]), np.concatenate([hi, lo[inner] - 1]))


def _span_batch(k, what, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(what, pa.int8()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], schema=SPAN)


LEAST = -(2**63)


def _ordered(batches: Iterator[pa.RecordBatch], key: str | None, top: int, whole: int) -> Iterator[tuple]:
    """k, what, lo, hi, whether a row is its key's first, and how far the rows before cover its key, by any stretch and by whole bins.

    The rows come in order of k and lo; key, top and whole are what the rows before this range left.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("k").to_numpy(zero_copy_only=False)
        what, lo, hi = (np.asarray(batch.column(c)).astype(np.int64) for c in ("what", "lo", "hi"))
        first = np.append(k[0] != key, k[1:] != k[:-1])
        code = np.cumsum(first)
        before = []
        for values, start in ((hi, top), (np.where(what == WHOLE, hi, LEAST), whole)):
            grown = pd.Series(np.append(start if not first[0] else LEAST, values)).groupby(np.append(code[0], code)).cummax().to_numpy()
            before.append((np.where(first, LEAST, grown[:-1]), grown[-1]))
        (cover, top), (bins, whole) = before
        key = k[-1]
        yield k, what, lo, hi, first, cover, bins, top, whole


def _range_of(batches: Iterator[pa.RecordBatch]) -> tuple[int, Iterator[pa.RecordBatch]]:
    """The number of the range that the rows belong to, -1 without rows; and the batches."""
    for batch in batches:
        if batch.num_rows:
            return batch.column("pid")[0].as_py(), chain([batch], batches)
    return -1, iter(())


def _range_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the first and last key of the range, and how far the last one is covered here."""
    one = last = None
    pid, batches = _range_of(batches)
    for k, *_, top, whole in _ordered(batches, None, LEAST, LEAST):
        one, last = (k[0] if last is None else one), (k[-1], top, whole)
    if last is not None:
        yield pa.RecordBatch.from_pydict({"pid": [pid], "first": [one], "last": [last[0]], "top": [int(last[1])], "whole": [int(last[2])]})


def _begun(carried: dict[int, tuple]):
    """One row: where the last period that begins in the range does so; none if no period begins there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        pid, batches = _range_of(batches)
        if pid < 0:
            return
        for _, _, lo, _, first, cover, *_ in _ordered(batches, *carried[pid]):
            new = np.flatnonzero(first | ((lo > cover) & (lo - 1 > cover)))
            at = int(lo[new[-1]]) if len(new) else at
        if at is not None:
            yield pa.RecordBatch.from_pydict({"pid": [pid], "at": [at]})

    return work


def _coalesced(carried: dict[int, tuple]):
    """Periods and gaps of the ordered stretches; the last range closes what is open. Bins inside whole runs are named."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, batches = _range_of(batches)
        if pid < 0:
            return
        key, top, whole, begun, is_last = carried[pid]
        for k, what, lo, hi, first, cover, bins, top_, whole_ in _ordered(batches, key, top, whole):
            new = np.flatnonzero(first | ((lo > cover) & (lo - 1 > cover)))
            # A period ends where the next begins: with it comes the end of the one before.
            prev = np.append(-1, np.arange(len(k) - 1))[new]
            name = np.where(prev < 0, key, k[prev])
            grown = np.maximum(cover[prev], hi[prev])
            end = np.where(prev < 0, top, grown)
            start = np.append(begun if begun is not None else 0, lo[new])[:-1]
            known = np.ones(len(new), bool)
            if begun is None and len(new):
                known[0] = False
            # Gaps within a bin are final already.
            gap = new[~first[new] & (what[new] != LAST)]
            inside = np.flatnonzero((what == FIRST) & (bins >= (lo | MASK)))
            yield _span_batch(
                np.concatenate([name[known], k[gap], k[inside]]),
                np.concatenate([np.full(known.sum(), PERIOD), np.full(len(gap), GAP), np.full(len(inside), INSIDE)]).astype(np.int8),
                np.concatenate([start[known], cover[gap] + 1, lo[inside] >> BITS]),
                np.concatenate([end[known], lo[gap] - 1, lo[inside] >> BITS]),
            )
            key, top, begun = k[-1], top_, int(lo[new[-1]]) if len(new) else begun
        if is_last and begun is not None:
            yield _span_batch([key], [PERIOD], [begun], [top])

    return work


def _coalesce(stretches: DataFrame) -> DataFrame:
    """Periods, gaps and inside bins (SPAN_DDL) of stretches that may touch or overlap, coalesced over the whole line of each key."""
    n = shuffle_partitions(stretches.sparkSession)
    # The range's number is a column, since a union numbers tasks anew.
    ordered = cut(stretches.repartitionByRange(n, "k", "lo").sortWithinPartitions("k", "lo", F.desc("what")).withColumn("pid", F.spark_partition_id()))
    ends = {r["pid"]: r for r in ordered.mapInArrow(_range_ends, "pid bigint, first string, last string, top bigint, whole bigint").collect()}  # one row a range
    carried, state = {}, (None, LEAST, LEAST)
    for pid, e in sorted(ends.items()):
        carried[pid] = state
        on = e["first"] == e["last"] == state[0]
        state = (e["last"], max(e["top"], state[1]) if on else e["top"], max(e["whole"], state[2]) if on else e["whole"])
    began = {r["pid"]: r["at"] for r in ordered.mapInArrow(_begun(carried), "pid bigint, at bigint").collect()}  # one row a range
    begun, last = None, max(ends, default=-1)
    for pid in sorted(ends):
        carried[pid] = (*carried[pid], begun, pid == last)
        begun = began.get(pid, begun)
    return ordered.mapInArrow(_coalesced(carried), SPAN_DDL)


def _cover(rows: DataFrame) -> DataFrame:
    """Periods and gaps (SPAN_DDL) of rows k, lo, hi (bigint, both ends inside, not null)."""
    rows = rows.withColumn("b0", F.shiftright("lo", BITS)).withColumn("b1", F.shiftright("hi", BITS))
    piece = lambda b, lo, hi: F.struct(b.alias("bin"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    low, high = F.col("lo").bitwiseAND(F.lit(MASK)), F.col("hi").bitwiseAND(F.lit(MASK))
    ends = F.when(F.col("b0") == F.col("b1"), F.array(piece(F.col("b0"), low, high))).otherwise(F.array(piece(F.col("b0"), low, F.lit(MASK)), piece(F.col("b1"), F.lit(0), high)))
    pieces = rows.select("k", F.inline(ends)).mapInArrow(_combine, PIECE_DDL)
    spans = kept(pieces.repartition("k", "bin").sortWithinPartitions("k", "bin").mapInArrow(_spans, SPAN_DDL))
    final, edges = spans.where(F.col("what") <= GAP), spans.where(F.col("what") >= FIRST)

    # Wholly covered bins: intervals of bin numbers, solved one stratum higher.
    wide = cut(rows.where("b1 - b0 >= 2").select("k", (F.col("b0") + 1).alias("lo"), (F.col("b1") - 1).alias("hi")))
    if wide.isEmpty():
        return final.unionByName(_coalesce(edges))
    runs = _cover(wide).where(F.col("what") == PERIOD)
    runs = runs.select("k", F.lit(WHOLE).cast("byte").alias("what"), F.shiftleft("lo", BITS).alias("lo"), F.shiftleft("hi", BITS).bitwiseOR(F.lit(MASK)).alias("hi"))
    made = cut(_coalesce(edges.unionByName(runs)))
    # What a whole run covers has no inner periods or gaps.
    inside = made.where(F.col("what") == INSIDE).select("k", F.col("lo").alias("bin"))
    final = final.withColumn("bin", F.shiftright("lo", BITS)).join(inside, ["k", "bin"], "left_anti").select("k", "what", "lo", "hi")
    return final.unionByName(made.where(F.col("what") <= GAP))


def periods_and_gaps(df: DataFrame, key: Column | str, start: Column | str, end: Column | str, names: tuple[str, str, str, str] = ("key", "span_kind", "span_start", "span_end")) -> DataFrame:
    """Continuous periods of each key's integer intervals, and the gaps between them.

    Both ends are inside; intervals that touch (next start = end + 1) join. Rows with a
    null key, start or end are left out; ends written high to low are exchanged;
    repeated rows count once; an empty string is a key like any other; an empty table
    gives an empty result. Coordinates are 64-bit integers, such as positions or times in
    microseconds. Other columns of df, of whatever name, play no part.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    k, s, e = as_col(key), as_col(start).cast("bigint"), as_col(end).cast("bigint")
    rows = df.select(k.alias("k"), F.least(s, e).alias("lo"), F.greatest(s, e).alias("hi")).where(k.isNotNull() & s.isNotNull() & e.isNotNull())
    return _cover(rows).select("k", F.when(F.col("what") == GAP, "gap").otherwise("period"), "lo", "hi").toDF(*names)
