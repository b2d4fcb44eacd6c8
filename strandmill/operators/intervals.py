"""Joins and reductions of intervals: overlap, containment, coverage, greedy suppression."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut
from .periods import periods_and_gaps


def _binned(df: DataFrame, lo: str, hi: str, bin_size: int) -> DataFrame:
    floor = lambda c: F.floor(F.col(c) / bin_size)
    return df.withColumn("__bin", F.explode(F.sequence(floor(lo), floor(hi))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int = 10_000) -> DataFrame:
    """Pairs of rows of equal key whose closed intervals share a position.

    Both sides are dealt to bins of the line, so that the join is on (key, bin) and one
    long contig is spread over many tasks; a pair is kept in the one bin where its
    common part begins. Rows with null key or ends, or lo > hi, join nothing. Column
    names of the two sides must differ except for the key.
    """
    (a, b), (c, d) = left_span, right_span
    x = _binned(left.where(F.col(key).isNotNull() & (F.col(a) <= F.col(b))), a, b, bin_size)
    y = _binned(right.where(F.col(key).isNotNull() & (F.col(c) <= F.col(d))), c, d, bin_size)
    first = F.floor(F.greatest(F.col(a), F.col(c)) / bin_size)
    return x.join(y, [key, "__bin"]).where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__bin") == first)).drop("__bin")


def beside(rows: DataFrame, anchors: DataFrame, key: str, lo: str, hi: str, flank: int = 10_000, bin_size: int = 20_000) -> DataFrame:
    """Rows within flank positions of an anchor of the same key, each once; anchors in rows are among them.

    The anchors' widened intervals are merged to periods first, so a row meets at most
    the periods of its bin however many anchors lie there.
    """
    wide = anchors.select(F.col(key).alias("key"), (F.col(lo) - flank).alias("lo"), (F.col(hi) + flank).alias("hi"))
    spans = periods_and_gaps(wide, "key", "lo", "hi", (key, "kind", "span_lo", "span_hi")).where("kind = 'period'").drop("kind")
    keep = [c for c in rows.columns]
    numbered = rows.where(F.col(lo) <= F.col(hi))
    hit = overlap_join(numbered, spans, key, (lo, hi), ("span_lo", "span_hi"), bin_size)
    # Two periods are never adjacent, but one long row may reach several: it is kept at the first.
    w = F.struct(*[F.col(c) for c in keep])
    return hit.groupBy(w.alias("row")).agg(F.count("*").alias("n")).select("row.*")


def covered_length(df: DataFrame, key: Column | str, lo: Column | str, hi: Column | str) -> DataFrame:
    """(key, n_periods, covered): positions that at least one closed interval of the key covers."""
    spans = periods_and_gaps(df, key, lo, hi)
    return spans.where("span_kind = 'period'").groupBy("key").agg(F.count("*").alias("n_periods"), F.sum(F.col("span_end") - F.col("span_start") + 1).alias("covered"))


def union_length_windowed(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Union length per key by one running maximum; for keys with few intervals, such as the domains of one hit."""
    w = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(hi).over(w)
    new = F.greatest(F.lit(0), F.col(hi) - F.greatest(F.col(lo) - 1, F.coalesce(seen, F.col(lo) - 1)))
    return df.where(F.col(lo) <= F.col(hi)).withColumn("__new", new).groupBy(*keys).agg(F.sum("__new").alias("covered"))


def contained_pairs(outer: DataFrame, inner: DataFrame, key: str, outer_span: tuple[str, str], inner_span: tuple[str, str], bin_size: int = 10_000) -> DataFrame:
    """Pairs where the inner interval lies wholly inside the outer one of the same key."""
    (a, b), (c, d) = outer_span, inner_span
    x = _binned(outer.where(F.col(key).isNotNull() & (F.col(a) <= F.col(b))), a, b, bin_size)
    y = inner.where(F.col(key).isNotNull() & (F.col(c) <= F.col(d))).withColumn("__bin", F.floor(F.col(c) / bin_size))
    return x.join(y, [key, "__bin"]).where((F.col(a) <= F.col(c)) & (F.col(d) <= F.col(b))).drop("__bin")


FREE, OPEN, GONE = 0, 1, 2


def _meets(starts: list, ends: list, a, b) -> bool:
    """Whether [a, b) overlaps one of the disjoint intervals."""
    at = bisect_right(ends, a)
    return at < len(starts) and starts[at] < b


def _add(starts: list, ends: list, a, b) -> None:
    """Adds [a, b) to disjoint intervals, joined with those that it overlaps or touches."""
    i, j = bisect_left(ends, a), bisect_right(starts, b)
    if i < j:
        a, b = min(a, starts[i]), max(b, ends[j - 1])
    starts[i:j], ends[i:j] = [a], [b]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bin after another, best rows first: GONE overlaps a row that is surely taken, OPEN a better one that may be, FREE neither.

    Taken and doubtful stretches of the open bin are all that is kept. A row that other
    bins hold too is doubtful for the rest, as they may reject it.
    """
    where, taken, doubt = None, ([], []), ([], [])
    for batch in batches:
        verdicts = []
        columns = [batch.column(c).to_pylist() for c in ("key", "bin", "lo", "hi", "across", "given")]
        for key, bin_, a, b, across, given in zip(*columns):
            if (key, bin_) != where:
                where, taken, doubt = (key, bin_), ([], []), ([], [])
            if given:
                verdict = FREE
            elif _meets(*taken, a, b):
                verdict = GONE
            else:
                verdict = OPEN if _meets(*doubt, a, b) else FREE
            if given or (verdict == FREE and not across):
                _add(*taken, a, b)
            elif verdict != GONE:
                _add(*doubt, a, b)
            verdicts.append(verdict)
        yield batch.append_column("verdict", pa.array(verdicts, pa.int32()))


def greedy_non_overlapping(df: DataFrame, key: str, lo: str, hi: str, score: str, row_id: str) -> DataFrame:
    """Rows kept by going through each key's half-open intervals by score (high first, then id and ends), taking those that overlap none taken.

    What is taken depends on all better rows that a row touches, directly or through
    others. So the line is cut into bins, which lie in many tasks, and each bin is gone
    through by itself; rows about which bins do not yet agree go on to the next round,
    whose bins are four times as wide and cut elsewhere, together with the rows taken
    across bins, which reject what they overlap. The best row left is decided in every
    round, and soon all are. Adjacent intervals do not overlap. Of rows with the same key
    and ends only the best can be taken, so one of each is looked at. Ends are integers;
    rows with null key or ends, or lo >= hi, are left out; null scores come last.
    """
    rows = df.where(F.col(key).isNotNull() & (F.col(lo) < F.col(hi))).select(F.struct("*").alias("row"))
    todo = rows.select(*[F.col("row")[c].alias(n) for c, n in ((key, "key"), (lo, "lo"), (hi, "hi"), (score, "score"), (row_id, "id"))], "row", F.lit(False).alias("given"))
    best = Window.partitionBy("key", "lo", "hi").orderBy(F.desc("score"), "id")
    todo = cut(todo.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn"))
    mean = int(todo.agg(F.avg(F.col("hi") - F.col("lo"))).first()[0] or 0)
    # Bins at least twice as wide as the mean row: all copies together are at most twice the rows and a half.
    first = max(16, (2 * mean).bit_length())
    parts, turn = [], 0
    while True:
        wide = min(first + 2 * turn, 60)
        shift = (1 << wide - 2) + (1 << first - 2) if turn % 2 else 0
        # Halves are shifted, so that no sum leaves 64 bits.
        at = lambda c: F.shiftright(F.shiftright(c.cast("bigint"), 1) + F.lit(shift).cast("bigint"), wide - 1)
        low, high = at(F.col("lo")), at(F.col("hi") - 1)
        binned = todo.withColumn("across", low < high).withColumn("bin", F.explode(F.sequence(low, high)))
        binned = binned.repartition("key", "bin").sortWithinPartitions("key", "bin", F.desc("given"), F.desc("score"), "id", "lo", "hi")
        schema = StructType([*binned.schema.fields, StructField("verdict", IntegerType())])
        judged = cut(binned.mapInArrow(_judged, schema).where(f"not given and (across or verdict <> {GONE})"))
        whole = judged.where("not across")
        names = ["key", "lo", "hi"]
        agreed = judged.where("across").groupBy(*names).agg(F.max("verdict").alias("verdict"), F.first(F.struct("score", "id", "row")).alias("r"))
        agreed = cut(agreed.where(f"verdict <> {GONE}").select(*names, "r.*", "verdict"))
        parts += [whole.where(f"verdict = {FREE}").select("row.*"), agreed.where(f"verdict = {FREE}").select("row.*")]
        slim = [*names, "score", "id", "row"]
        left = whole.where(f"verdict = {OPEN}").select(*slim).unionByName(agreed.where(f"verdict = {OPEN}").select(*slim))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        todo = left.withColumn("given", F.lit(False)).unionByName(agreed.where(f"verdict = {FREE}").select(*slim).withColumn("given", F.lit(True)))
        turn += 1


def islands(df: DataFrame, keys: list[str], at: str, breaks: Column) -> DataFrame:
    """df with island, the number (from 1) of the run that a row belongs to; breaks is true where a new run begins.

    breaks may use prev, the previous position of the key in order (null at the first).
    """
    w = Window.partitionBy(*keys).orderBy(at)
    marked = df.withColumn("prev", F.lag(at).over(w))
    marked = marked.withColumn("__new", F.when(F.col("prev").isNull() | breaks, 1).otherwise(0))
    return marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
