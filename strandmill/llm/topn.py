"""The N best items of every group by secondary sort.

First the best score of every (group, item) is taken, with map-side combining. The
partitions of that aggregation hold a hot group's items in all of them, so each one
is sorted by group, score and item and streamed, emitting N rows a group; only those
few rows are then partitioned by group, sorted and streamed once more. No group is
ever buffered: the stream keeps the open group's name and a counter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = pa.schema([("g", pa.string()), ("rank", pa.int32()), ("item", pa.string()), ("score", pa.float64())])


def _first_rows(n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            g = batch.column("g")
            head = np.ones(rows, bool)
            if rows > 1:
                head[1:] = pc.not_equal(g.slice(1), g.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(head)
            sizes = np.diff(np.append(starts, rows))
            rank = np.arange(rows) - np.repeat(starts, sizes) + 1
            if g[0].as_py() == open_group:
                rank[: sizes[0]] += seen
            open_group, seen = g[rows - 1].as_py(), int(rank[-1])
            keep = np.flatnonzero(rank <= n)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([g.take(at), pa.array(rank[keep].astype(np.int32)), batch.column("item").take(at), batch.column("score").take(at)], schema=SCHEMA)

    return work


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """(group, rank, item, score): the n best distinct items of each group.

    Of one group and item the highest score counts. Order: score descending, then item
    ascending by bytes. Rows with a null group or item, or a null or NaN score, are left
    out; infinite scores are scores; repeated rows count once; empty strings are names;
    an empty table gives an empty result.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where("g is not null and item is not null and score is not null and not isnan(score)")
    best = rows.groupBy("g", "item").agg(F.max("score").alias("score"))
    order = [F.col("g"), F.col("score").desc(), F.col("item")]
    schema = "g string, rank int, item string, score double"
    local = best.sortWithinPartitions(*order).mapInArrow(_first_rows(n), schema).drop("rank")
    final = local.repartition("g").sortWithinPartitions(*order).mapInArrow(_first_rows(n), schema)
    return final.select(F.col("g").alias("group"), "rank", "item", "score")
