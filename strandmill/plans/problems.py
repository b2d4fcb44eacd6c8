"""Queries of the general data problems: periods, hierarchies, hot keys, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_form
from ..operators.chunks import distinct_per_key
from ..operators.hierarchy import ancestor_pairs, cycles, hierarchy, latest_links
from ..operators.periods import periods_and_gaps
from ..operators.references import Reference, all_orphan_references, orphan_counts
from .tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "proteins"), key_form("contig_id"), "start_pos", "end_pos", ("contig_id", "span_kind", "span_start", "span_end"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = cycles(latest_links(table(spark, d, "task_records")))
    return found.select(F.col("node").alias("task_id"), "cycle_id", F.col("steps").cast("int").alias("steps"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(latest_links(table(spark, d, "task_records")))
    return tree.select(F.col("node").alias("task_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("path"), "dangling", "n_descendants")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every task, with its distance."""
    pairs = ancestor_pairs(hierarchy(latest_links(table(spark, d, "task_records"))))
    return pairs.select(F.col("ancestor").alias("task_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct members of every representative, beside the size its cluster states."""
    counts = distinct_per_key(table(spark, d, "clu_cluster"), key_form("c0"), key_form("c1"))
    by = F.struct("loaded_at", "size")
    latest = table(spark, d, "clusters").withColumn("key", key_form("representative_protein_id")).where("key is not null").groupBy("key").agg(F.max(by).alias("last"))
    return counts.join(latest, "key", "left").select(F.col("key").alias("c0"), F.col("n_values").alias("n_members"), F.col("last.size").alias("size"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_members(spark, d).where(F.col("n_members") != F.col("size")).select("c0")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    proteins, contigs = table(spark, d, "proteins"), table(spark, d, "contigs")
    clusters, biosamples = table(spark, d, "clusters"), table(spark, d, "biosamples")
    of_proteins = [Reference("proteins.cluster_id", key_form("cluster_id"), clusters, key_form("cluster_id")), Reference("proteins.contig_id", key_form("contig_id"), contigs, key_form("contig_id"))]
    of_contigs = [Reference("contigs.biosample_id", key_form("biosample_id"), biosamples, key_form("biosample_id"))]
    return all_orphan_references(proteins, "protein_id", "loaded_at", of_proteins).unionByName(all_orphan_references(contigs, "contig_id", "loaded_at", of_contigs))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_name", "row_id", "state").distinct()


def p6_monthly(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants, "p4_found": p4_found, "p4_members": p4_members, "p6_found": p6_found, "p6_monthly": p6_monthly}

_KEY = "upper(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"


def _k(c: str) -> str:
    return _KEY.format(c)


_LINKS = """last_rows as (
  select lower(trim(task_id, ' ' || chr(9) || chr(10) || chr(13))) node, lower(trim(parent, ' ' || chr(9) || chr(10) || chr(13))) parent,
         row_number() over (partition by lower(trim(task_id, ' ' || chr(9) || chr(10) || chr(13))) order by updated_at desc nulls last, parent desc nulls last) rn
  from task_records),
links as (select node, case when parent in ('', '-') then null else parent end parent from last_rows where rn = 1 and node <> ''),
edges as (select l.node, l.parent from links l where l.parent is not null and l.parent in (select node from links))"""

_ORPHANS = f"""
refs as (
  select 'proteins.cluster_id' ref_name, protein_id row_id, {_k('cluster_id')} k, loaded_at from proteins where cluster_id is not null
  union all select 'proteins.contig_id', protein_id, {_k('contig_id')}, loaded_at from proteins where contig_id is not null
  union all select 'contigs.biosample_id', contig_id, {_k('biosample_id')}, loaded_at from contigs where biosample_id is not null),
parents as (
  select ref_name, k, min(loaded_at) first_load, bool_and(retired_at is not null) gone from (
    select 'proteins.cluster_id' ref_name, {_k('cluster_id')} k, loaded_at, retired_at from clusters
    union all select 'proteins.contig_id', {_k('contig_id')}, loaded_at, retired_at from contigs
    union all select 'contigs.biosample_id', {_k('biosample_id')}, loaded_at, retired_at from biosamples) group by 1, 2),
orphans as (
  select r.ref_name, r.row_id, r.loaded_at,
         case when p.k is null then 'missing' when p.gone then 'retired' when p.first_load > r.loaded_at then 'late' end state
  from refs r left join parents p on r.ref_name = p.ref_name and r.k = p.k)"""

ORACLES = {
    "p1_found": f"""
with r as (
  select distinct {_k('contig_id')} k, least(start_pos, end_pos)::bigint lo, greatest(start_pos, end_pos)::bigint hi from proteins
  where contig_id is not null and start_pos is not null and end_pos is not null),
p as (select *, max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) pm from r),
i as (select *, sum(case when pm is null or lo > pm + 1 then 1 else 0 end) over (partition by k order by lo, hi rows unbounded preceding) g from p),
s as (select k, min(lo) lo, max(hi) hi from i group by k, g),
l as (select *, lag(hi) over (partition by k order by lo) ph from s)
select k contig_id, 'period' span_kind, lo span_start, hi span_end from s
union all select k, 'gap', ph + 1, lo - 1 from l where ph is not null""",
    "p3_found": f"""
with recursive {_LINKS},
reach as (select node, parent up from edges union select r.node, e.parent from reach r join edges e on e.node = r.up),
on_cycle as (select node from reach where node = up),
named as (select r.node, min(r.up) cycle_id from reach r where r.node in (select node from on_cycle) group by 1),
steps as (
  select r.node, min(n.cycle_id) cycle_id,
         case when r.node in (select node from on_cycle) then 0 else count(*) filter (where r.up not in (select node from on_cycle)) + 1 end steps
  from reach r left join named n on n.node = r.up group by r.node)
select node task_id, cycle_id, steps::int steps from steps where cycle_id is not null""",
    "p3_hierarchy": f"""
with recursive {_LINKS},
down as (
  select node, node root, 0 depth, node path from links where parent is null or parent not in (select node from links)
  union all select e.node, d.root, d.depth + 1, d.path || '/' || e.node from down d join edges e on e.parent = d.node),
below as (select up, count(*) n from (select node, unnest(str_split(path, '/')) up from down) where up <> node group by 1)
select l.node task_id, d.root root_id, d.depth::int depth, d.path, l.parent is not null and l.parent not in (select node from links) dangling,
       case when d.root is not null then coalesce(b.n, 0) end::bigint n_descendants
from links l left join down d on d.node = l.node left join below b on b.up = l.node""",
    "p3_descendants": f"""
with recursive {_LINKS},
down as (
  select node, [node] path from links where parent is null or parent not in (select node from links)
  union all select e.node, list_append(d.path, e.node) from down d join edges e on e.parent = d.node)
select path[i] task_id, node descendant_id, (len(path) - i)::int distance from (select node, path, unnest(range(1, len(path))) i from down)""",
    "p4_members": f"""
with m as (select {_k('c0')} c0, count(distinct {_k('c1')}) n_members from clu_cluster where c0 is not null group by 1),
s as (select {_k('representative_protein_id')} c0, size, row_number() over (partition by {_k('representative_protein_id')} order by loaded_at desc nulls last, size desc nulls last) rn from clusters)
select m.c0, m.n_members::bigint n_members, s.size from m left join s on s.c0 = m.c0 and s.rn = 1""",
    "p6_found": f"with {_ORPHANS} select distinct ref_name, row_id, state from orphans where state is not null",
    "p6_monthly": f"with {_ORPHANS} select ref_name, strftime(loaded_at, '%Y-%m') as month, state, count(*)::bigint n_refs, count(distinct row_id)::bigint n_rows from orphans where state is not null group by 1, 2, 3",
}
ORACLES["p4_found"] = f"select c0 from ({ORACLES['p4_members']}) where n_members <> size"
