"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a tree (say domain, language, source) have tokens to give: what they hold,
times the repeats allowed. Weights go down the tree; a node without weights of its own
shares its parent's in proportion to its tokens. Budgets are filled top down with each
node's capacity as the limit, so a leaf that falls short is made up for by its siblings
as long as they can, and only then by the relatives of its ancestors. A leaf's budget
is spent in epochs, each a seeded order of its documents: whole epochs first, then a
prefix of the next by tokens.

Nodes are rows, of any number; each level is one step over all of them. The prefix is
found through sums over 4,096 hash ranges of the order; rows are put in order only
within the one range of a leaf where its budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

RANGES = 12
#: Leaves up to this many are broadcast to their documents (their number is checked); more are joined by shuffle.
BROADCAST_LEAVES = 20_000


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children with got: their parent's budget split by weight, none above its capacity; what a full child can't take goes to its siblings.

    children: parent columns, name, weight, capacity, budget (of the parent). In order of
    capacity per weight the full children come first; the first one that isn't full tells
    what a unit of weight gets.
    """
    open_ = (F.col("weight") > 0) & (F.col("capacity") > 0)
    c = children.where(open_).withColumn("ratio", F.col("capacity") / F.col("weight"))
    group = Window.partitionBy(*parent)
    before = group.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    rest = group.orderBy("ratio", name).rowsBetween(0, Window.unboundedFollowing)
    c = c.withColumn("left", F.least(F.col("budget"), F.sum("capacity").over(group).cast("double")) - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    c = c.withColumn("unit", F.col("left") / F.sum("weight").over(rest)).withColumn("full", F.col("unit") * F.col("weight") >= F.col("capacity"))
    c = c.withColumn("unit", F.min(F.when(~F.col("full"), F.struct("ratio", name, "unit"))).over(group)["unit"])
    c = c.withColumn("got", F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.greatest(F.lit(0.0), F.col("unit")) * F.col("weight")))
    return c.drop("ratio", "left", "unit", "full").unionByName(children.where(~F.coalesce(open_, F.lit(False))).withColumn("got", F.lit(0.0)))


def plan_budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(levels, tokens, max_repeats, budget) of every leaf.

    leaves: the levels (not null), tokens, max_repeats, one row a leaf. weights: the
    levels, null below the node that the row weighs, and weight; among children of a node
    of which some have weights, one without has none. Without total_tokens the total is
    the largest at which every weighted node at the top that has tokens meets its weight.
    """
    leaves = leaves.withColumn("capacity", F.greatest(F.lit(0), F.col("tokens") * F.col("max_repeats")))
    held = cut(leaves.where("capacity > 0"))
    budgets = None
    for depth, level in enumerate(levels):
        above, here = levels[:depth], levels[: depth + 1]
        given = weights.where(" and ".join([f"`{c}` is not null" for c in here] + [f"`{c}` is null" for c in levels[depth + 1 :]]))
        given = given.groupBy(*here).agg(F.max(F.greatest(F.lit(0.0), F.col("weight").cast("double"))).alias("given"))
        nodes = held.groupBy(*here).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).join(given, here, "left")
        nodes = nodes.withColumn("weight", F.when(F.count("given").over(Window.partitionBy(*above)) > 0, F.coalesce("given", F.lit(0.0))).otherwise(F.col("tokens").cast("double")))
        if depth == 0:
            if total_tokens is None:
                top = cut(nodes.where("weight > 0"))
                whole = top.agg(F.sum("weight")).first()[0] or 0.0
                total_tokens = int(top.agg(F.min(F.col("capacity") * whole / F.col("weight"))).first()[0] or 0)
            nodes = nodes.withColumn("budget", F.lit(float(total_tokens)))
        else:
            nodes = nodes.join(budgets, above)
        budgets = cut(water_fill(nodes, above, level).select(*here, F.col("got").alias("budget")))
    whole_tokens = F.least(F.col("capacity"), F.floor(F.col("budget") + 1e-6))
    return leaves.join(budgets, levels, "left").select(*levels, "tokens", "max_repeats", F.coalesce(whole_tokens, F.lit(0)).cast("bigint").alias("budget"))


def source_key(c: Column | str) -> Column:
    """A source's name: blanks cut off, lower case, "-" as "_"."""
    return F.replace(F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n"))), F.lit("-"), F.lit("_"))


def language_key(c: Column | str) -> Column:
    """The main part of a language tag in lower case; null, empty and blank become `und`."""
    main = F.split(F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n"))), "[-_]")[0]
    return F.coalesce(F.when(main != "", main), F.lit("und"))


def _with_leaves(rows: DataFrame, leaves: DataFrame, levels: list[str]) -> DataFrame:
    """rows joined with one row a leaf; few leaves are broadcast."""
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, levels)


def take_budgets(docs: DataFrame, levels: list[str], plan: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, levels, n_tokens and uses (at least 1) of the documents that the leaves' budgets take.

    docs has doc_id (unique), the levels (not null) and n_tokens; documents without
    tokens are never taken. plan: levels, tokens, budget. The document at which a leaf's
    budget ends is taken if at least half of it still fits, so a leaf misses its budget by
    half a document at most.
    """
    planned = cut(plan.where("budget > 0 and tokens > 0").select(*levels, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")))
    rows = _with_leaves(docs.where("n_tokens > 0").select("doc_id", *levels, "n_tokens"), planned, levels)
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))
    rows = rows.withColumn("order", order).withColumn("range", F.shiftrightunsigned("order", 64 - RANGES))
    by_leaf = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*levels, "rest", "range").agg(F.sum("n_tokens").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(by_leaf), F.lit(0)))
    ends = cut(sums.where("before <= rest and before + here > rest").select(*levels, F.col("range").alias("end_range"), "before"))
    rows = _with_leaves(rows, ends, levels)
    inside = Window.partitionBy(*levels).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("range = end_range").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    last = last.withColumn("uses", F.col("whole") + F.when(2 * F.col("upto") - F.col("n_tokens") <= 2 * F.col("rest"), 1).otherwise(0)).drop("upto")
    others = rows.where("range <> end_range").withColumn("uses", F.col("whole") + F.when(F.col("range") < F.col("end_range"), 1).otherwise(0))
    return others.unionByName(last).where("uses > 0").select("doc_id", *levels, "n_tokens", F.col("uses").cast("int").alias("uses"))


def read_targets(targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats), one row a source that asks for anything."""
    rows = targets.select(source_key("source").alias("source"), "weight", "max_repeats").where("source is not null and weight > 0 and not isnan(weight)")
    return rows.groupBy("source").agg(F.max("weight").cast("double").alias("weight"), F.greatest(F.lit(0), F.coalesce(F.max("max_repeats"), F.lit(1))).cast("int").alias("max_repeats"))


def mix_sources(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their uses, and the shares reached by every target source.

    tokens: doc_id, source (key form), lang (key form), n_tokens. targets: source, weight,
    max_repeats; rows of the same source count once with their greatest values, a null
    weight or one not above 0 asks for nothing, null max_repeats is 1. Sources without a
    target are left out. A source's languages share its budget by their tokens. Without
    total_tokens no source that has documents falls short.
    """
    levels = ["source", "lang"]
    goal = read_targets(targets)
    docs = tokens.join(goal.select("source"), "source", "left_semi")
    totals = docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan = cut(plan_budgets(totals.join(goal.select("source", "max_repeats"), "source"), levels, goal.select("source", F.lit(None).cast("string").alias("lang"), "weight"), total_tokens))
    chosen = take_budgets(docs, levels, plan, seed)
    every = Window.partitionBy()
    held = plan.groupBy("source").agg(F.sum("tokens").alias("tokens_held"), F.sum("budget").alias("budget"))
    wanted = goal.select("source", (F.col("weight") / F.sum("weight").over(every)).alias("target_share"), "max_repeats").join(held, "source", "left").fillna(0, ["tokens_held", "budget"])
    used = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    shares = wanted.join(used, "source", "left").fillna(0, ["n_docs", "n_uses", "most_uses", "tokens"])
    return chosen, shares.withColumn("share", F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(every)))
