"""Per-key results without imbalance: exact offset chunking.

Rows are put into one global order of key and value, in ranges of about equal size, so
a key with a third of all rows simply lies in many partitions. A first pass counts:
each partition reports its first and last key with their rows. Prefix sums over these
reports (one small row a partition) give the offset at which a partition's first key
continues; every other key of a partition starts there at 0. A second pass numbers the
rows of each key exactly, cuts them into chunks of equal size and reduces each chunk
to a state with its first and last value. A partition merges its states of one key in
order, so that one state a key and partition is left to merge; where two neighbours
share the value at their boundary it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_partitions

CHUNK_ROWS = 100_000


def _runs(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first is new, nulls are equal."""
    n = len(column)
    new = np.ones(n, bool)
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        both = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        new[1:] = ~(same | both)
    return new


def _count_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    first_rows = last_rows = keys = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("k")
        heads = np.flatnonzero(_runs(k))
        sizes = np.diff(np.append(heads, len(k)))
        if keys and k[0].as_py() == last:
            last_rows += int(sizes[0])
        else:
            keys, last, last_rows = keys + 1, k[0].as_py(), int(sizes[0])
        if keys == 1:
            first, first_rows = last, last_rows
        if len(heads) > 1:
            keys, last, last_rows = keys + len(heads) - 1, k[len(k) - 1].as_py(), int(sizes[-1])
    if keys:
        yield pa.RecordBatch.from_pydict({"pid": [TaskContext.get().partitionId()], "first_key": [first], "first_rows": [first_rows], "last_key": [last], "last_rows": [last_rows]}, schema=EDGES)


EDGES = pa.schema([("pid", pa.int32()), ("first_key", pa.string()), ("first_rows", pa.int64()), ("last_key", pa.string()), ("last_rows", pa.int64())])
STATES = pa.schema([("k", pa.string()), ("at", pa.int64()), ("n_rows", pa.int64()), ("n_values", pa.int64()), ("first", pa.string()), ("last", pa.string())])


def offsets(edges: list) -> dict[int, int]:
    """Rows that each partition's first key has in the partitions before, from one report a partition."""
    at, open_key, rows = {}, None, 0
    for e in sorted(edges, key=lambda e: e["pid"]):
        before = rows if e["first_key"] == open_key else 0
        at[e["pid"]] = before
        open_key, rows = e["last_key"], e["last_rows"] + (before if e["first_key"] == e["last_key"] else 0)
    return at


def _pieces(batch: pa.RecordBatch, number: int, goes_on: bool, size: int) -> tuple[pa.RecordBatch, int]:
    """A state for each part of a chunk in the batch, in order, and the number of the last row within its key.

    number is that of the first row if its key goes on from the batch before.
    """
    n = batch.num_rows
    k, v = batch.column("k"), batch.column("v")
    new_key = _runs(k)
    heads = np.flatnonzero(new_key)
    # Row numbers within the key: from the head of its run, or on from where the key stood.
    numbers = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    if goes_on:
        numbers[: heads[1] if len(heads) > 1 else n] += number
    chunk = numbers // size
    cut_ = new_key.copy()
    cut_[1:] |= chunk[1:] != chunk[:-1]
    piece = np.flatnonzero(cut_)
    ends = np.append(piece[1:], n)
    # A value is new in its piece if it is not null and differs from the one before or begins the piece.
    fresh = (_runs(v) | cut_) & ~pc.is_null(v).to_numpy(zero_copy_only=False)
    values = np.add.reduceat(fresh.astype(np.int64), piece)
    take = lambda c, i: c.take(pa.array(i))
    made = pa.RecordBatch.from_arrays([take(k, piece), pa.array(numbers[piece]), pa.array(ends - piece), pa.array(values), take(v, piece), take(v, ends - 1)], schema=STATES)
    return made, int(numbers[-1])


def _merged(states: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring states of one key merged in order; a value at both sides of a boundary counts once."""
    k, first, last = (states.column(c) for c in ("k", "first", "last"))
    new = _runs(k)
    again = np.zeros(len(new), np.int64)
    again[1:] = pc.fill_null(pc.equal(first.slice(1), last.slice(0, len(new) - 1)), False).to_numpy(zero_copy_only=False)
    again[new] = 0
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(new)) - 1
    total = lambda c: np.add.reduceat(np.asarray(c), heads)
    take = lambda c, i: c.take(pa.array(i))
    return pa.RecordBatch.from_arrays([take(k, heads), take(states.column("at"), heads), pa.array(total(states.column("n_rows"))), pa.array(total(states.column("n_values")) - total(again)), take(first, heads), take(last, tails)], schema=STATES)


def _chunk_states(at: dict[int, int], size: int):
    """The merged state of each key of a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = at.get(TaskContext.get().partitionId(), 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            states, last = _pieces(batch, number, open_ is None or batch.column("k")[0] == open_.column("k")[0], size)
            if open_ is not None:
                states = pa.Table.from_batches([open_, states]).combine_chunks().to_batches()[0]
            states = _merged(states)
            # The last key may go on in the next batch.
            if states.num_rows > 1:
                yield states.slice(0, states.num_rows - 1)
            open_, number = states.slice(states.num_rows - 1), last + 1
        if open_ is not None:
            yield open_

    return work


def distinct_per_key(df: DataFrame, key: Column, value: Column, chunk_rows: int = CHUNK_ROWS, partitions: int | None = None) -> DataFrame:
    """(key, n_rows, n_values, n_chunks): rows and distinct non-null values of every key.

    A null key is left out, an empty one counts; a key with null values only has n_values
    0; repeated rows count in n_rows only. An empty table gives an empty result.
    """
    rows = df.select(key.alias("k"), value.alias("v")).where(F.col("k").isNotNull())
    # Equal rows may be many: their position keeps them divisible, the boundary states put them together again.
    n = partitions or shuffle_partitions(df.sparkSession)
    ordered = cut(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, "k", "v", "tie").sortWithinPartitions("k", "v").select("k", "v"))
    edges = ordered.mapInArrow(_count_edges, "pid int, first_key string, first_rows bigint, last_key string, last_rows bigint").collect()  # one row a partition
    states = ordered.mapInArrow(_chunk_states(offsets(edges), chunk_rows), "k string, at bigint, n_rows bigint, n_values bigint, first string, last string")
    # At most one state a partition of a key, merged in order.
    w = Window.partitionBy("k").orderBy("at")
    states = states.withColumn("again", F.when(F.col("first") == F.lag("last").over(w), 1).otherwise(0))
    return states.groupBy(F.col("k").alias("key")).agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_values") - F.col("again")).alias("n_values"), F.ceil(F.sum("n_rows") / chunk_rows).alias("n_chunks"))
