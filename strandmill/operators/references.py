"""References to rows that do not exist, are retired or came later.

Work on keys comes before work on rows: the distinct non-null foreign keys, each with
its earliest time, are set against one row a parent key (a left anti join for the
missing ones), and only the few keys that can be orphans go back to the child rows.
Hot keys are one row by then.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Orphan keys up to this many are broadcast to the child rows (their count is checked); more are joined by shuffle.
BROADCAST_KEYS = 20_000


@dataclass(frozen=True)
class Reference:
    """A column of the child table and the table that it refers to."""

    name: str
    foreign_key: Column
    parent: DataFrame
    parent_key: Column
    loaded_at: str = "loaded_at"
    retired_at: str = "retired_at"


def all_orphan_references(child: DataFrame, row_id: str, loaded_at: str, references: list[Reference], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(ref_name, row_id, loaded_at, state), one row for each failing reference of each child row.

    state is `missing` if no parent row has the key, else `retired` if all rows of the
    key have a retirement time, else `late` if the key's first load is after the child
    row's load. A null foreign key refers to nothing; an empty one is a key. A child
    without a load time, or a parent key without any, is never late. Repeated child rows
    stay repeated here. Empty tables are allowed on either side. The child table is read
    twice, for its keys and on the way back, however many references it has.
    """
    refs = F.array(*[F.struct(F.lit(r.name).alias("ref_name"), r.foreign_key.alias("key")) for r in references])
    rows = child.select(F.col(row_id).alias("row_id"), F.col(loaded_at).alias("at"), F.inline(refs)).where(F.col("key").isNotNull())
    keys = cut(rows.groupBy("ref_name", "key").agg(F.min("at").alias("first_use")))
    there = [r.parent.select(F.lit(r.name).alias("ref_name"), r.parent_key.alias("key"), F.col(r.loaded_at).alias("loaded"), F.col(r.retired_at).isNotNull().alias("gone")) for r in references]
    there = reduce(DataFrame.unionByName, there).where(F.col("key").isNotNull()).groupBy("ref_name", "key").agg(F.min("loaded").alias("first_load"), F.bool_and("gone").alias("gone"))
    on = ["ref_name", "key"]
    missing = keys.join(there, on, "left_anti").select(*on, F.lit("missing").alias("state"), F.lit(None).cast("timestamp").alias("first_load"))
    found = keys.join(there, on).where(F.col("gone") | (F.col("first_load") > F.col("first_use")))
    found = found.select(*on, F.when(F.col("gone"), "retired").otherwise("late").alias("state"), F.col("first_load").cast("timestamp"))
    orphans = cut(missing.unionByName(found))
    small = orphans.limit(broadcast_keys + 1).count() <= broadcast_keys
    back = rows.join(F.broadcast(orphans) if small else orphans, on)
    back = back.where((F.col("state") != "late") | (F.col("first_load") > F.col("at")))
    return back.select("ref_name", "row_id", F.col("at").alias("loaded_at"), "state")


def orphan_references(child: DataFrame, parent: DataFrame, ref_name: str, row_id: str, foreign_key: Column, loaded_at: str, parent_key: Column, parent_loaded_at: str = "loaded_at", parent_retired_at: str = "retired_at", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """all_orphan_references of a single reference."""
    return all_orphan_references(child, row_id, loaded_at, [Reference(ref_name, foreign_key, parent, parent_key, parent_loaded_at, parent_retired_at)], broadcast_keys)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per reference, month of loaded_at (null where that is unknown) and state."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    return orphans.groupBy("ref_name", month, "state").agg(F.count("*").alias("n_refs"), F.count_distinct("row_id").alias("n_rows"))
