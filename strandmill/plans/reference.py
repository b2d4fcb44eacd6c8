"""Queries of the sequence-mining and log operators, over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_form, task_key
from ..functions.sequences import distinct_letters, gc_fraction, kmers, reverse_complement
from ..operators import abundance, arrays, best, census, graph, intervals, logs, partners, ranking, runs, sampling, textscan, tiers, words
from ..session import cut, ensure_checkpoint_dir, spread
from ..streaming import ledger
from .tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_B = "' ' || chr(9) || chr(10) || chr(13)"
_GENES = f"""genes as (
  select distinct protein_id, upper(trim(contig_id, {_B})) contig, upper(trim(cluster_id, {_B})) cluster_id, least(start_pos, end_pos)::bigint lo, greatest(start_pos, end_pos)::bigint hi, length
  from proteins where contig_id is not null and start_pos is not null and end_pos is not null)"""


def _genes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct located genes: protein_id, contig, cluster_id, lo, hi, length."""
    p = table(spark, d, "proteins").where("contig_id is not null and start_pos is not null and end_pos is not null")
    return p.select("protein_id", key_form("contig_id").alias("contig"), key_form("cluster_id").alias("cluster_id"), F.least("start_pos", "end_pos").cast("bigint").alias("lo"), F.greatest("start_pos", "end_pos").cast("bigint").alias("hi"), "length").distinct()


# Best hits, tiers, representatives


@query("""select target_id, label, bitscore, coverage, seq_identity from (
  select *, row_number() over (partition by target_id order by bitscore desc, label, coverage desc, seq_identity desc) rn
  from tier2_hits where target_id is not null and bitscore is not null and not isnan(bitscore)) where rn = 1""")
def best_hit_per_target(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "tier2_hits").where("target_id is not null and bitscore is not null and not isnan(bitscore)")
    return best.best_per_key(hits, ["target_id"], [F.desc("bitscore"), F.col("label"), F.desc("coverage"), F.desc("seq_identity")])


@query("""with b as (
  select target_id, bitscore, coverage from (select *, row_number() over (partition by target_id order by bitscore desc, label, coverage desc, seq_identity desc) rn
  from tier2_hits where target_id is not null and bitscore is not null and not isnan(bitscore)) where rn = 1),
l as (select protein_id, max(length) length, bool_or(regexp_matches(sequence, 'Y.DD')) motif from proteins group by 1)
select target_id, case when bitscore < 25 and coverage < 0.35 and motif is not distinct from false then 'weak' when not coalesce(coverage >= 0.75, false) then 'fragment' when not coalesce(length >= 225, false) then 'short' else 'kept' end verdict
from b left join l on l.protein_id = b.target_id""")
def census_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").groupBy(F.col("protein_id").alias("target_id")).agg(F.max("length").alias("length"), F.bool_or(F.col("sequence").rlike("Y.DD")).alias("motif"))
    hits = best_hit_per_target(spark, d).join(p, "target_id", "left")
    return hits.select("target_id", census.verdict(F.col("bitscore"), F.col("coverage"), F.col("length"), F.col("motif")).alias("verdict"))


_T1 = """t1 as (
  select target, max(case when rn = 1 then rt_class end) rt_class from (
    select target_id target, rt_class, max(bitscore) s, row_number() over (partition by target_id order by max(bitscore) desc, rt_class) rn
    from tier1_hits where target_id is not null and rt_class is not null and bitscore is not null and not isnan(bitscore) group by target_id, rt_class)
  group by target having max(case when rn = 2 then s end) is null or max(case when rn = 1 then s end) - max(case when rn = 2 then s end) >= 10)"""
_T2 = """t2 as (
  select target_id target, label from (
    select *, row_number() over (partition by target_id order by bitscore desc, label, coverage desc, seq_identity desc) rn
    from tier2_hits where target_id is not null and bitscore is not null and not isnan(bitscore))
  where rn = 1 and bitscore >= 150 and coverage >= 0.5 and seq_identity >= 0.30)"""


@query(f"with {_T1} select target, rt_class from t1")
def tier1_margin(spark: SparkSession, d: str) -> DataFrame:
    return tiers.tier1_margin(table(spark, d, "tier1_hits"))


_FLOORED = """floors(rt_class, floor) as (values ('retron', 100), ('UG', 100), ('group II intron', 100), ('DGR', 100), ('CRISPR-assoc', 100), ('group II-like', 100), ('Abi', 100), ('novel', 100)),
top as (select target_id target, max(bitscore) s from tier1_hits where target_id is not null and rt_class is not null and bitscore is not null and not isnan(bitscore) group by 1),
won as (select distinct target, rt_class, s from top join tier1_hits h on h.target_id = top.target and h.bitscore = top.s where rt_class is not null),
t1 as (select target, w.rt_class from won w left join floors f on f.rt_class = w.rt_class where s >= coalesce(floor, 100)
  and not exists (select 1 from tier1_hits h where h.target_id = w.target and h.rt_class <> w.rt_class and not isnan(h.bitscore) and w.s - h.bitscore < 10))"""


@query(f"with {_FLOORED} select target, rt_class from t1")
def tier1_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The whole rule of tier 1: floor of the class and margin."""
    return tiers.tier1_assign(table(spark, d, "tier1_hits"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    t1, t2 = table(spark, d, "tier1_hits"), table(spark, d, "tier2_hits")
    targets = t1.select(F.col("target_id").alias("target")).unionByName(t2.select(F.col("target_id").alias("target"))).where("target is not null")
    return tiers.classify(tiers.tier1_assign(t1), tiers.tier2_best(t2), None, targets)


_ASSIGNED = f"""with {_FLOORED}, {_T2}, targets as (select target_id target from tier1_hits where target_id is not null union select target_id from tier2_hits where target_id is not null),
placed as (select t.target, case when t1.rt_class is not null then 'tier1' when t2.label is not null then 'tier2' else 'none' end tier, coalesce(t1.rt_class, t2.label, 'unplaced') label
  from targets t left join t1 on t1.target = t.target left join t2 on t2.target = t.target)"""


@query(f"{_ASSIGNED} select * from placed")
def assigned_classes(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


@query(f"{_ASSIGNED} select tier, count(*)::bigint n from placed group by 1")
def assigned_counts(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


def _three_tiers(spark: SparkSession, d: str) -> DataFrame:
    """All tiers. The neighbours of a target are the five genes nearest to its own on the contig, at most 10,000 letters off, with the class that tiers 1 and 2 give them."""
    two = cut(_assigned(spark, d))
    genes = cut(_genes(spark, d).select("protein_id", "contig", "lo").distinct())
    open_ = two.where("tier = 'none'").select(F.col("target").alias("protein_id")).join(genes, "protein_id").select(F.col("protein_id").alias("target"), "contig", F.col("lo").alias("at"), (F.col("lo") - 10_000).alias("a"), (F.col("lo") + 10_000).alias("b"))
    there = genes.join(two.where("tier <> 'none'").select(F.col("target").alias("protein_id"), "label"), "protein_id", "left").select("protein_id", "contig", "lo", F.col("lo").alias("hi"), F.coalesce("label", F.lit("unplaced")).alias("label"))
    near = intervals.overlap_join(open_, there, "contig", ("a", "b"), ("lo", "hi"), 20_000).where("target <> protein_id")
    near = near.groupBy("target", "protein_id", "label").agg(F.min(F.abs(F.col("lo") - F.col("at"))).alias("off"))
    tier3 = tiers.tier3_assign(near.select("target", "label", F.struct("off", "protein_id").alias("rank")))
    return tiers.classify(two.where("tier = 'tier1'").select("target", F.col("label").alias("rt_class")), two.where("tier = 'tier2'").select("target", "label"), tier3, two)


_THREE = f"""{_ASSIGNED}, {_GENES},
pos as (select distinct protein_id, contig, lo from genes),
near as (select o.target, g.protein_id, coalesce(case when q.tier <> 'none' then q.label end, 'unplaced') label, min(abs(g.lo - p.lo)) off
  from placed o join pos p on p.protein_id = o.target join pos g on g.contig = p.contig and g.lo between p.lo - 10000 and p.lo + 10000 and g.protein_id <> o.target
  left join placed q on q.target = g.protein_id where o.tier = 'none' group by 1, 2, 3),
five as (select target, label, row_number() over (partition by target order by off, protein_id) rn from near),
votes as (select target, count(*) n, count(*) filter (where label in ('unplaced', '-', '')) blank, count(distinct label) kinds, min(label) one from five where rn <= 5 group by 1),
t3 as (select target, case when blank * 2 > n then 'novel' else one end label from votes where blank * 2 > n or (n = 5 and kinds = 1)),
final as (select p.target, case when p.tier = 'none' and t3.label is not null then 'tier3' else p.tier end tier, case when p.tier = 'none' then coalesce(t3.label, 'unplaced') else p.label end label
  from placed p left join t3 on t3.target = p.target)"""


@query(f"{_THREE} select * from final")
def tiered_classes(spark: SparkSession, d: str) -> DataFrame:
    return _three_tiers(spark, d)


@query(f"{_THREE} select tier, count(*)::bigint n from final group by 1")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return _three_tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query("""with g as (select distinct gene_id, locus_id, case when family like 'PF%' then substring(family, 1, 3) else 'unplaced' end label, abs(distance_to_adjacent_bp) rank from neighbor_genes where distance_to_adjacent_bp is not null and locus_id is not null),
k as (select *, row_number() over (partition by locus_id order by rank, label) rn from g),
a as (select locus_id target, count(*) n, count(distinct label) kinds, min(label) one, count(*) filter (where label in ('unplaced', '-', '')) nothing from k where rn <= 5 group by 1)
select target, case when nothing * 2 > 5 then 'novel' else one end label from a where n = 5 and (nothing * 2 > 5 or kinds = 1)""")
def tier3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "neighbor_genes").where("distance_to_adjacent_bp is not null and locus_id is not null")
    g = g.select("gene_id", F.col("locus_id").alias("target"), F.when(F.col("family").startswith("PF"), F.substring("family", 1, 3)).otherwise("unplaced").alias("label"), F.abs("distance_to_adjacent_bp").alias("rank")).distinct()
    return tiers.tier3_neighbours(g)


@query(f"""with g as (select distinct gene_id, locus_id target, upper(trim(family, {_B})) f, abs(distance_to_adjacent_bp) rank from neighbor_genes where distance_to_adjacent_bp is not null and locus_id is not null),
k as (select target, label, label = 'unplaced' nothing, row_number() over (partition by target order by rank, label) rn from (select target, rank, case when f like 'PF%' then f else 'unplaced' end label from g)),
a as (select target, list(label order by rn) labels, count(*) n, count(*) filter (where nothing) nothing from k where rn <= 5 group by 1)
select target, case when nothing * 2 > n then 'novel' else labels[1] end label from a where nothing * 2 > n or (n = 5 and len(list_distinct(labels)) = 1)""")
def tier3_families(spark: SparkSession, d: str) -> DataFrame:
    """Tier 3 of every locus by the whole families of its nearest genes."""
    g = table(spark, d, "neighbor_genes").where("distance_to_adjacent_bp is not null and locus_id is not null")
    g = g.select("gene_id", F.col("locus_id").alias("target"), key_form("family").alias("f"), F.abs("distance_to_adjacent_bp").alias("rank")).distinct()
    return tiers.tier3_assign(g.select("target", F.when(F.col("f").startswith("PF"), F.col("f")).otherwise("unplaced").alias("label"), "rank"))


@query(f"""with p as (select distinct protein_id, upper(trim(cluster_id, {_B})) k, coalesce(length, 0) v from proteins where cluster_id is not null),
t as (select k, list_sort(list(v))[(floor(0.8 * (count(*) - 1)))::int + 1] target from p group by 1),
r as (select p.k, protein_id, row_number() over (partition by p.k order by abs(v - target), protein_id) rn from p join t on t.k = p.k)
select k cluster_id, protein_id from r where rn = 1""")
def representative_near_p80(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").select("protein_id", key_form("cluster_id").alias("k"), F.coalesce("length", F.lit(0)).alias("v")).where("k is not null").distinct()
    return best.nearest_to_quantile(p, "k", "protein_id", "v", 0.8).select(F.col("key").alias("cluster_id"), F.col("row_id").alias("protein_id"))


@query(f"""with m as (select distinct upper(trim(c0, {_B})) c0, upper(trim(c1, {_B})) c1 from clu_cluster where c0 is not null and c1 is not null),
l as (select upper(trim(protein_id, {_B})) c1, max(length) len from proteins group by 1),
r as (select m.c0, m.c1, len, row_number() over (partition by m.c0 order by len desc nulls last, m.c1) rn from m join l on l.c1 = m.c1)
select c0, c1 representative, len length from r where rn = 1""")
def longest_representative(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "clu_cluster").select(key_form("c0").alias("c0"), key_form("c1").alias("c1")).where("c0 is not null and c1 is not null").distinct()
    lengths = table(spark, d, "proteins").groupBy(key_form("protein_id").alias("c1")).agg(F.max("length").alias("length"))
    return best.best_per_key(m.join(lengths, "c1"), ["c0"], [F.desc_nulls_last("length"), F.col("c1")]).select("c0", F.col("c1").alias("representative"), "length")


@query(f"select distinct upper(trim(c1, {_B})) as key from clu_cluster where c1 is not null and upper(trim(c1, {_B})) not in (select upper(trim(target_id, {_B})) from tier1_hits where target_id is not null)")
def members_without_hit(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "clu_cluster").select(key_form("c1").alias("c1"))
    return best.missing_references(members, "c1", table(spark, d, "tier1_hits").select(key_form("target_id").alias("p")), "p")


@query(f"select distinct upper(trim(c1, {_B})) as member from clu_cluster where c1 is not null and upper(trim(c0, {_B})) in (select target_id from tier1_hits where rt_class = 'retron' and target_id is not null)")
def members_of_hit_clusters(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "tier1_hits").where("rt_class = 'retron' and target_id is not null").select(F.col("target_id").alias("c0")).distinct()
    m = table(spark, d, "clu_cluster").select(key_form("c0").alias("c0"), key_form("c1").alias("member")).where("member is not null")
    return m.join(hit, "c0", "left_semi").select("member").distinct()


@query("select min(doc_id) doc_id, count(*)::bigint copies from documents where text is not null group by text")
def first_of_equal_texts(spark: SparkSession, d: str) -> DataFrame:
    # A digest of 256 bits stands for the text, so the shuffle carries no texts.
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    return best.first_by_content(docs, "content", "doc_id").select("doc_id", "copies")


@query(f"""select contig_id, source_db, biosample_id, length, loaded_at, retired_at from (
  select upper(trim(contig_id, {_B})) contig_id, source_db, biosample_id, length, loaded_at, retired_at,
         row_number() over (partition by upper(trim(contig_id, {_B})) order by loaded_at >= timestamp '2025-11-01' desc, loaded_at desc, source_db, biosample_id nulls last, length nulls last, retired_at nulls last) rn
  from contigs where contig_id is not null) where rn = 1""")
def contigs_upserted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contigs").where("contig_id is not null").withColumn("contig_id", key_form("contig_id"))
    is_new = F.col("loaded_at") >= F.lit("2025-11-01").cast("timestamp")
    order = [F.desc("loaded_at"), F.col("source_db"), F.asc_nulls_last("biosample_id"), F.asc_nulls_last("length"), F.asc_nulls_last("retired_at")]
    return best.upsert(c.where(~is_new), c.where(is_new), ["contig_id"], order)


@query(f"""with a as (select distinct upper(trim(cluster_id, {_B})) as key from proteins where cluster_id is not null), b as (select distinct upper(trim(cluster_id, {_B})) as key from clusters where cluster_id is not null)
select key, 'left' side from a where key not in (select key from b) union all select key, 'right' from b where key not in (select key from a)""")
def cluster_key_differences(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").select(key_form("cluster_id").alias("k"))
    return best.set_difference_report(p, table(spark, d, "clusters").select(key_form("cluster_id").alias("k")), "k")


# Intervals


@query(f"""with {_GENES},
p as (select *, max(hi) over (partition by contig order by lo, hi rows between unbounded preceding and 1 preceding) pm from (select distinct contig, lo, hi from genes)),
i as (select *, sum(case when pm is null or lo > pm + 1 then 1 else 0 end) over (partition by contig order by lo, hi rows unbounded preceding) g from p),
s as (select contig, min(lo) lo, max(hi) hi from i group by contig, g)
select contig, count(*)::bigint n_periods, sum(hi - lo + 1)::bigint covered from s group by 1""")
def covered_length(spark: SparkSession, d: str) -> DataFrame:
    return intervals.covered_length(_genes(spark, d), "contig", "lo", "hi").withColumnRenamed("key", "contig")


@query(f"""with {_GENES}
select distinct a.protein_id left_id, b.protein_id right_id, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 shared
from genes a join genes b on a.contig = b.contig and a.lo <= b.hi and b.lo <= a.hi and a.protein_id < b.protein_id""")
def overlapping_genes(spark: SparkSession, d: str) -> DataFrame:
    g = _genes(spark, d)
    left = g.select("contig", F.col("protein_id").alias("left_id"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    right = g.select("contig", F.col("protein_id").alias("right_id"), F.col("lo").alias("c"), F.col("hi").alias("e"))
    # One side of each pair is enough: Catalyst moves the condition into the join.
    pairs = intervals.overlap_join(left, right, "contig", ("a", "b"), ("c", "e")).where("left_id < right_id")
    return pairs.select("left_id", "right_id", (F.least("b", "e") - F.greatest("a", "c") + 1).alias("shared")).distinct()


@query(f"""with {_GENES}
select distinct a.protein_id outer_id, b.protein_id inner_id from genes a join genes b on a.contig = b.contig and a.lo <= b.lo and b.hi <= a.hi and a.protein_id <> b.protein_id""")
def contained_genes(spark: SparkSession, d: str) -> DataFrame:
    g = _genes(spark, d)
    outer = g.select("contig", F.col("protein_id").alias("outer_id"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    inner = g.select("contig", F.col("protein_id").alias("inner_id"), F.col("lo").alias("c"), F.col("hi").alias("e"))
    return intervals.contained_pairs(outer, inner, "contig", ("a", "b"), ("c", "e")).where("outer_id <> inner_id").select("outer_id", "inner_id").distinct()


@query(f"""with {_GENES}, anchors as (select contig, lo, hi from genes where protein_id in (select target_id from tier1_hits where rt_class = 'retron' and target_id is not null))
select distinct protein_id, contig, lo, hi from genes g where exists (select 1 from anchors a where a.contig = g.contig and g.lo <= a.hi + 10000 and g.hi >= a.lo - 10000)""")
def genes_beside_hits(spark: SparkSession, d: str) -> DataFrame:
    g = _genes(spark, d).select("protein_id", "contig", "lo", "hi").distinct()
    hit = table(spark, d, "tier1_hits").where("rt_class = 'retron' and target_id is not null").select(F.col("target_id").alias("protein_id")).distinct()
    return intervals.beside(g, g.join(hit, "protein_id", "left_semi"), "contig", "lo", "hi", 10_000)


_BETTER = "b.contig = a.contig and b.lo <= a.hi and b.hi >= a.lo and (-b.length, b.protein_id, b.lo, b.hi) < (-a.length, a.protein_id, a.lo, a.hi)"


@query(f"""with recursive {_GENES}, g as (select contig, lo, hi, max(length) length, min(protein_id) protein_id from genes where length > 0 group by 1, 2, 3),
r as (
  select 0 turn, contig, protein_id, lo, hi, length, false taken from g
  union all
  select turn + 1, contig, protein_id, lo, hi, length, taken from (
    with u as materialized (select * from r where not taken),
    t as materialized (select * from u a where not exists (select 1 from u b where {_BETTER}))
    select turn, contig, protein_id, lo, hi, length, true taken from t
    union all select turn, contig, protein_id, lo, hi, length, false from u a where not exists (select 1 from t b where b.contig = a.contig and b.lo <= a.hi and b.hi >= a.lo)))
select contig, protein_id, lo, hi from r where taken""")
def longest_non_overlapping_genes(spark: SparkSession, d: str) -> DataFrame:
    g = _genes(spark, d).where("length > 0").groupBy("contig", "lo", "hi").agg(F.max("length").alias("length"), F.min("protein_id").alias("protein_id"))
    half_open = g.select("contig", "protein_id", "lo", (F.col("hi") + 1).alias("stop"), "length")
    return intervals.greedy_non_overlapping(half_open, "contig", "lo", "stop", "length", "protein_id").select("contig", "protein_id", "lo", F.col("stop") - 1).toDF("contig", "protein_id", "lo", "hi")


# Runs


def _starts(spark: SparkSession, d: str, max_gap: int) -> DataFrame:
    """Distinct gene starts with the stretch of their contig in which no gap exceeds max_gap."""
    return runs.stretches(_genes(spark, d).select("contig", "lo").distinct(), "contig", "lo", max_gap)


@query(f"""with {_GENES}, pts as (select distinct contig, lo from genes), g as (select *, lo - lag(lo) over (partition by contig order by lo) gap from pts),
i as (select *, sum(case when gap is null or gap > 99 then 1 else 0 end) over (partition by contig order by lo rows unbounded preceding) island from g)
select contig, min(lo) first, max(lo) as last, count(*)::bigint n from i group by contig, island having count(*) >= 2""")
def dense_gene_starts(spark: SparkSession, d: str) -> DataFrame:
    return runs.dense_runs(_starts(spark, d, 99), ["contig", "stretch"], "lo").drop("island", "stretch")


@query(f"""with {_GENES}, pts as (select distinct contig, lo from genes), g as (select *, lo - lag(lo) over (partition by contig order by lo) gap from pts),
i as (select *, sum(case when gap is null or gap < 100 or gap > 450 then 1 else 0 end) over (partition by contig order by lo rows unbounded preceding) island from g)
select contig, min(lo) first, max(lo) as last, count(*)::bigint n from i group by contig, island having count(*) >= 3""")
def gap_runs_of_gene_starts(spark: SparkSession, d: str) -> DataFrame:
    r = runs.gap_islands(_starts(spark, d, 450), ["contig", "stretch"], "lo", 100, 450).where(F.size("positions") >= 3)
    return r.select("contig", F.col("positions")[0].alias("first"), F.element_at("positions", -1).alias("last"), F.size("positions").cast("bigint").alias("n"))


@query(f"""with {_GENES}, pts as (select distinct contig, lo from genes), g as (select *, lo - lag(lo) over (partition by contig order by lo) gap from pts),
i as (select *, sum(case when gap is null or gap < 100 or gap > 450 then 1 else 0 end) over (partition by contig order by lo rows unbounded preceding) island from g),
r as (select contig, island, list(lo order by lo) xs from i group by 1, 2 having count(*) >= 3),
w as (select contig, island, xs, a, unnest(range(a + 2, len(xs) + 1)) b from (select *, unnest(range(1, len(xs) - 1)) a from r)),
c as (select *, list_transform(range(a, b), lambda k: xs[k + 1] - xs[k]) gaps from w),
m as (select *, list_aggregate(gaps, 'median') mid from c),
ok as (select *, row_number() over (partition by contig, island order by b - a desc, a) rn from m where list_max(gaps) - mid <= 0.3 * mid and mid - list_min(gaps) <= 0.3 * mid)
select contig, xs[a:b] positions from ok where rn = 1""")
def regular_gene_starts(spark: SparkSession, d: str) -> DataFrame:
    return runs.regular_runs(_starts(spark, d, 450), ["contig", "stretch"], "lo").select("contig", "positions")


@query(f"""with recursive {_GENES}, pts as (select distinct contig, lo from genes),
nxt as (select contig, lo, min(lo) over (partition by contig order by lo range between 1000 following and unbounded following) next_lo from pts),
r as (select contig, min(lo) lo from pts group by 1 union all select r.contig, n.next_lo from r join nxt n on n.contig = r.contig and n.lo = r.lo where n.next_lo is not null)
select contig, lo from r""")
def spaced_gene_starts(spark: SparkSession, d: str) -> DataFrame:
    return runs.spaced_greedily(_starts(spark, d, 1000), ["contig", "stretch"], "lo", 1000).select("contig", "lo")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("line_no", "line"))


_LINES = "lines as (select doc_id, unnest(range(len(parts)))::int line_no, unnest(parts) line from (select doc_id, str_split(replace(text, chr(13), ''), chr(10)) parts from documents where text is not null))"


@query(f"""with {_LINES}, p as (select *, instr(line, '[') remark, instr(line, '-->') signal from lines),
w as (select *, coalesce(max(case when signal > 0 then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) before from p)
select doc_id, count(*) filter (where remark > 0 and (before = 1 or (signal > 0 and signal < remark)))::bigint n_after, count(*) filter (where remark > 0)::bigint n_remarks from w group by 1""")
def remarks_after_first_cue(spark: SparkSession, d: str) -> DataFrame:
    marked = _lines(spark, d).withColumn("signal", F.instr("line", "-->")).withColumn("remark", F.instr("line", "["))
    marked = runs.signal_then_remark(marked, ["doc_id"], "line_no", "signal", "remark")
    return marked.groupBy("doc_id").agg(F.count_if("after_signal").alias("n_after"), F.count_if(F.col("remark") > 0).alias("n_remarks"))


@query(f"""with {_LINES}, t as (select *, line = '' blank, case when lag(line = '') over w is not distinct from (line = '') and row_number() over w > 1 then 0 else 1 end fresh from lines window w as (partition by doc_id order by line_no)),
r as (select *, sum(fresh) over (partition by doc_id order by line_no rows unbounded preceding) run from t)
select doc_id, min(line_no) first, max(line_no) as last, count(*)::bigint n, string_agg(line, '' order by line_no) text from r where not blank group by doc_id, run""")
def merged_line_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = runs.merge_consecutive(_lines(spark, d).withColumn("blank", F.col("line") == ""), ["doc_id"], "line_no", "blank", "line")
    return blocks.where("not blank").drop("blank")


# Words of sequences


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proteins").where("sequence is not null and sequence <> ''").groupBy("protein_id").agg(F.max("sequence").alias("seq"))


_SEQ = "s as (select protein_id, max(sequence) seq from proteins where sequence is not null and sequence <> '' group by 1), w as (select protein_id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substring(seq, i, 3))) word from s where length(seq) >= 3)"


@query(f"with {_SEQ} select word, count(*)::bigint n, count(distinct protein_id)::bigint n_proteins from w group by 1")
def three_letter_words(spark: SparkSession, d: str) -> DataFrame:
    counts = words.word_counts(_sequences(spark, d), "protein_id", "seq", 3)
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_proteins"))


@query(f"""with {_SEQ}, c as (select protein_id, word, count(*) n from w where len(list_distinct(str_split(word, ''))) >= 3 group by 1, 2)
select protein_id, rank::int rank, word, n::bigint n from (select *, row_number() over (partition by protein_id order by n desc, word) rank from c) where rank <= 5""")
def top_words_of_proteins(spark: SparkSession, d: str) -> DataFrame:
    return words.top_words(_sequences(spark, d), "protein_id", "seq", 3, 5)


@query(f"""with {_SEQ}, c as (select protein_id, count(distinct word) n from w group by 1)
select s.protein_id, length(seq)::int len, coalesce(c.n, 0)::int n_words, regexp_matches(seq, 'Y.DD') motif, len(list_distinct(str_split(seq, '')))::int letters,
       reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) reversed, length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) gc
from s left join c on c.protein_id = s.protein_id where coalesce(c.n, 0) >= 4 and length(seq) <= 8000 and not regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWY]')""")
def sequence_features(spark: SparkSession, d: str) -> DataFrame:
    s = _sequences(spark, d).where(~F.col("seq").rlike("[^ACDEFGHIKLMNPQRSTVWY]") & (F.length("seq") <= 8000)).where(~words.low_complexity(None, "seq"))
    return s.select("protein_id", F.length("seq").alias("len"), F.size(F.array_distinct(kmers("seq", 3))).alias("n_words"), F.col("seq").rlike("Y.DD").alias("motif"), distinct_letters("seq").alias("letters"), reverse_complement("seq").alias("reversed"), gc_fraction("seq").alias("gc"))


@query("""with z as (select doc_id, unnest(range(0, length(text) - 11)) i, text from documents where length(text) >= 12),
p as (select doc_id, substr(text, i::int + 1, 12) word, i from z),
g as (select *, i - lag(i) over (partition by doc_id, word order by i) gap from (select * from p qualify count(*) over (partition by doc_id, word) >= 3)),
r as (select *, sum(case when gap is null or gap < 100 or gap > 450 then 1 else 0 end) over (partition by doc_id, word order by i rows unbounded preceding) island from g),
x as (select doc_id, word, island, list(i order by i) xs from r group by 1, 2, 3 having count(*) >= 3),
w as (select *, unnest(range(a + 2, len(xs) + 1)) b from (select *, unnest(range(1, len(xs) - 1)) a from x)),
m as (select *, list_transform(range(a, b), lambda k: xs[k + 1] - xs[k]) gaps from w),
ok as (select *, list_aggregate(gaps, 'median') mid from m),
best as (select *, row_number() over (partition by doc_id order by b - a desc, xs[a], word) rn from ok where list_max(gaps) - mid <= 0.3 * mid and mid - list_min(gaps) <= 0.3 * mid)
select doc_id, word, (b - a + 1)::int copies, xs[a:b] positions from best where rn = 1""")
def exact_word_arrays(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    return words.exact_word_arrays(docs, "doc_id", "text", 12)


@query()
def scanned_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Repeat arrays in the sequences of proteins, read as the letters that they are."""
    return arrays.scan_arrays(_sequences(spark, d), "protein_id", "seq", word=4, seeds=20, mismatches=1, shuffles=100)


@query()
def scanned_or_worded(spark: SparkSession, d: str) -> DataFrame:
    """The same scan, and exact words where it finds none."""
    return arrays.scan_with_words(_sequences(spark, d), "protein_id", "seq", exact_word=3, word=4, seeds=20, mismatches=1, shuffles=100)


def _dna(spark: SparkSession, d: str, size: int) -> DataFrame:
    """DNA-like windows of the whole text of every document."""
    return cut(arrays.all_windows(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", size))


@query()
def dna_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Scanned arrays with the words, mismatches and shuffles of upstream windows."""
    return arrays.scan_arrays(_dna(spark, d, arrays.SCAN_WINDOW), "locus", "seq")


@query()
def delimited_arrays(spark: SparkSession, d: str) -> DataFrame:
    return arrays.delimit_arrays(_dna(spark, d, arrays.CHAIN_WINDOW), "locus", "seq")


@query()
def extended_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Delimited arrays with the copies that the weight matrix of their repeat adds."""
    windows = _dna(spark, d, arrays.CHAIN_WINDOW)
    found = cut(arrays.delimit_arrays(windows, "locus", "seq"))
    return arrays.extend_arrays(windows, arrays.repeat_blocks(windows, found))


# Sampling, partners, abundance, games


_LOCI = "loci as (select locus_id, min(rt_class) rt_class, min(rt_clade) rt_clade from neighbor_genes where locus_id is not null group by 1)"


def _loci(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "neighbor_genes").where("locus_id is not null").groupBy("locus_id").agg(F.min("rt_class").alias("rt_class"), F.min("rt_clade").alias("rt_clade"))


_QUOTAS = f"""with {_LOCI}, s as (select rt_class, rt_clade, count(*) size from loci group by 1, 2),
a as (select *, size < 30 small, sum(case when size < 30 then size else 0 end) over (partition by rt_class) small_sum from s),
b as (select *, case when small_sum > 200 then small else not small end pool, case when small_sum > 200 then 200 else 200 - small_sum end room from a),
c as (select *, sum(case when pool then size end) over (partition by rt_class) pool_sum from b),
e as (select *, case when pool then size * room // pool_sum end fl, case when pool then size * room % pool_sum end rest from c),
f as (select *, room - sum(fl) over (partition by rt_class) lft, row_number() over (partition by rt_class, pool order by rest desc nulls last, rt_clade) rk from e)
select rt_class, rt_clade, size::bigint size, (case when pool then least(size, fl + case when rk <= lft then 1 else 0 end) when small and small_sum <= 200 then size else 0 end)::bigint quota from f"""


def _quotas(spark: SparkSession, d: str) -> DataFrame:
    sizes = _loci(spark, d).groupBy("rt_class", "rt_clade").agg(F.count("*").alias("size"))
    return sampling.proportional_quotas(sizes, ["rt_class"], "rt_clade", "size", 200)


@query(_QUOTAS)
def clade_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _quotas(spark, d)


@query(f"""with q as ({_QUOTAS}), {_LOCI}, r as (select *, row_number() over (partition by rt_class, rt_clade order by md5('1:' || locus_id), locus_id) rn from loci)
select r.locus_id, r.rt_class, r.rt_clade from r join q on q.rt_class = r.rt_class and q.rt_clade = r.rt_clade where rn <= quota""")
def loci_by_quota(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by_quota(_loci(spark, d), _quotas(spark, d), ["rt_class", "rt_clade"], "locus_id", most=200)


@query(f"with {_LOCI} select locus_id, rt_class, rt_clade from (select *, row_number() over (partition by rt_clade order by md5('1:' || locus_id), locus_id) rn from loci) where rn <= 60")
def loci_per_clade(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_per_group(_loci(spark, d), ["rt_clade"], "locus_id", 60)


@query(f"""with {_LOCI}, g as (select rt_class, rt_clade, count(*) size from loci where rt_clade is not null group by 1, 2),
k as (select *, row_number() over (partition by rt_class order by size desc, rt_clade) rank from g),
m as (select *, row_number() over (partition by rt_class, rt_clade order by md5('1:' || locus_id), locus_id) rn from loci)
select k.rt_class, k.rt_clade, rank::int rank, size::bigint size, m.locus_id from k join m on m.rt_class = k.rt_class and m.rt_clade = k.rt_clade and rn = 1 where rank <= 3""")
def largest_clades(spark: SparkSession, d: str) -> DataFrame:
    return sampling.largest_groups(_loci(spark, d), ["rt_class"], "rt_clade", "locus_id", 3)


@query(f"""with g as (
  select distinct gene_id, locus_id, case when length(upper(trim(family, {_B}))) > 0 then upper(trim(family, {_B})) else 'CLUSTER:' || cluster_id_90 end fam, rt_clade, rt_class, cluster_id_90, biosample,
         coalesce(rt_adjacent = 1 and (same_strand_as_rt = 1 or coalesce(distance_to_adjacent_bp <= 100, false)), false)::int near
  from neighbor_genes where locus_id is not null),
gg as (select * from g where fam is not null),
cl as (select rt_clade, count(distinct locus_id) total from gg group by 1),
pc as (select fam, rt_clade, count(distinct locus_id) n from gg group by 1, 2),
co as (select fam, bool_or(n >= 3 or n >= 0.1 * coalesce(total, 0)) conserved, sum(n) n_loci from pc left join cl on cl.rt_clade = pc.rt_clade group by 1),
ct as (select fam, count(*) n_genes, sum(near) n_near, count(distinct cluster_id_90) n_clusters, count(distinct biosample) n_biosamples, count(distinct rt_class) n_classes from gg group by 1),
lo as (select locus_id, count(*) c, sum(near) k from gg group by 1),
po as (select fam, sum(c) pool, sum(k) pool_near from (select distinct fam, locus_id from gg) f join lo on lo.locus_id = f.locus_id group by 1),
al as (select ct.*, conserved, n_loci, pool, pool_near, n_clusters >= 3 and n_biosamples >= 3 and n_classes >= 2 independent from ct join co on co.fam = ct.fam join po on po.fam = ct.fam),
pv as (select *, case when not (conserved and independent) or n_near <= 0 then 1.0 else
  list_sum(list_transform(range(greatest(n_near, n_genes + pool_near - pool)::bigint, least(n_genes, pool_near)::bigint + 1), lambda i:
    exp(lgamma(pool_near + 1) - lgamma(i + 1) - lgamma(pool_near - i + 1) + lgamma(pool - pool_near + 1) - lgamma(n_genes - i + 1) - lgamma(pool - pool_near - n_genes + i + 1) - lgamma(pool + 1) + lgamma(n_genes + 1) + lgamma(pool - n_genes + 1)))) end p from al)
select fam family, n_genes::bigint n_genes, n_near::bigint n_near, n_clusters::bigint n_clusters, n_biosamples::bigint n_biosamples, n_classes::bigint n_classes, n_loci::bigint n_loci, conserved, independent, round(least(1.0, p), 6) p, least(1.0, p) <= 0.05 promoted from pv""")
def partner_families(spark: SparkSession, d: str) -> DataFrame:
    s = partners.score_partners(table(spark, d, "neighbor_genes"))
    return s.select("family", "n_genes", "n_near", "n_clusters", "n_biosamples", "n_classes", "n_loci", "conserved", "independent", F.round("p", 6).alias("p"), "promoted")


_COUNTS = """len as (select protein_id, max(length) length from proteins where length > 0 group by 1),
cnt as (select rt_class library, target_id feature, count(*) fragments from tier1_hits where target_id is not null group by 1, 2),
j as (select library, feature, fragments, length, fragments / length rate from cnt join len on len.protein_id = cnt.feature),
tot as (select library, sum(rate) total from j group by 1)"""


def _abundance(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "proteins").where("length > 0").groupBy(F.col("protein_id").alias("feature")).agg(F.max("length").alias("length"))
    counts = table(spark, d, "tier1_hits").where("target_id is not null").groupBy(F.col("rt_class").alias("library"), F.col("target_id").alias("feature")).agg(F.count("*").alias("fragments"))
    return abundance.tpm(counts.join(lengths, "feature"), "library", "length", "fragments")


@query(f"with {_COUNTS} select j.library, feature, fragments::bigint fragments, length, round(case when total > 0 then rate / total * 1e6 else 0 end, 4) tpm from j join tot on tot.library = j.library")
def tpm_of_hits(spark: SparkSession, d: str) -> DataFrame:
    return _abundance(spark, d).select("library", "feature", "fragments", "length", F.round("tpm", 4).alias("tpm"))


@query(f"with {_COUNTS} select j.library, round(sum(case when length >= 400 then rate / total * 1e6 else 0 end) / sum(rate / total * 1e6), 6) as share from j join tot on tot.library = j.library group by 1")
def tpm_share_of_long(spark: SparkSession, d: str) -> DataFrame:
    s = abundance.share_of_total(_abundance(spark, d).withColumn("long", F.col("length") >= 400), "library", "tpm", "long")
    return s.select(F.col("library"), F.round("share", 6).alias("share"))


@query("""with s as (select target_id, rt_class, max(bitscore) v from tier1_hits where target_id is not null and rt_class is not null and bitscore is not null and not isnan(bitscore) group by 1, 2)
select a.rt_class a, b.rt_class b, count(*) filter (where a.v > b.v)::bigint wins_a, count(*) filter (where a.v < b.v)::bigint wins_b
from s a join s b on a.target_id = b.target_id and a.rt_class < b.rt_class where a.v <> b.v group by 1, 2""")
def class_duels(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pair_wins(_class_scores(spark, d), "target_id", "rt_class", "v")


def _class_scores(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "tier1_hits").where("target_id is not null and rt_class is not null and bitscore is not null and not isnan(bitscore)")
    return hits.groupBy("target_id", "rt_class").agg(F.max("bitscore").alias("v"))


@query("""with recursive s as (select target_id, rt_class, max(bitscore) v from tier1_hits where target_id is not null and rt_class is not null and bitscore is not null and not isnan(bitscore) group by 1, 2),
w as (select a.rt_class a, b.rt_class b, count(*) filter (where a.v > b.v) wins_a, count(*) filter (where a.v < b.v) wins_b
  from s a join s b on a.target_id = b.target_id and a.rt_class < b.rt_class where a.v <> b.v group by 1, 2),
m as (select a name, b other, wins_a wins, wins_a + wins_b games from w union all select b, a, wins_b, wins_a + wins_b from w),
r as (
  select 0 turn, name, 1.0::double p from (select distinct name from m)
  union all
  select turn + 1, name, greatest(1e-6, p / sum(p) over () * count(*) over ()) from (
    select x.turn, m.name, sum(m.wins) / sum(m.games / (x.p + y.p)) p
    from m join r x on x.name = m.name join r y on y.name = m.other where x.turn < 200 group by 1, 2))
select r.name, t.wins, round(r.p, 5) strength from r join (select name, sum(wins)::bigint wins from m group by 1) t using (name) where r.turn = 200""")
def class_strengths(spark: SparkSession, d: str) -> DataFrame:
    fit = ranking.bradley_terry(ranking.pair_wins(_class_scores(spark, d), "target_id", "rt_class", "v"))
    return fit.withColumn("strength", F.round("strength", 5))


# Graphs


def _family_edges(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "tier2_hits").where("target_id is not null and label is not null and bitscore is not null and not isnan(bitscore)")
    return hits.where("bitscore >= 140").select(F.col("target_id").alias("src"), F.col("label").alias("dst")).distinct()


_FAMILY = "e as (select distinct target_id src, label dst from tier2_hits where target_id is not null and label is not null and bitscore >= 140 and not isnan(bitscore)), u as (select src, dst from e union select dst, src from e)"


@query(f"with recursive {_FAMILY}, seen as (select min(dst) node from e union select u.dst from seen join u on u.src = seen.node) select node from seen")
def family_component_of_seed(spark: SparkSession, d: str) -> DataFrame:
    edges = _family_edges(spark, d)
    return graph.reachable(graph.symmetric(edges), edges.agg(F.min("dst").alias("node"))).select("node")


_LABELS = f"with recursive {_FAMILY}, reach as (select src node, src up from u union select r.node, u.dst from reach r join u on u.src = r.up) select node, min(up) component from reach group by 1"


@query(_LABELS)
def family_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of all edges that qualify for a family."""
    return graph.components(_family_edges(spark, d))


# The same edges by their older names.
for _old, _name in (("component_of_seed", "family_component_of_seed"), ("hit_components", "family_components")):
    QUERIES[_old], ORACLES[_old] = QUERIES[_name], ORACLES[_name]


# Texts


@query("""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))) word from documents where text is not null)
select lower(c.word) word, count(*)::bigint n_docs from w join (select distinct lower(word) word from common_words) c on c.word = w.word group by 1""")
def documents_mentioning(spark: SparkSession, d: str) -> DataFrame:
    found = textscan.mentions(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"), "word")
    return found.groupBy("word").agg(F.count("*").alias("n_docs"))


@query("""with q as (select lang, word, count(*) over (partition by lang) terms from (select distinct lang, lower(word) word from common_words where regexp_full_match(lower(word), '[a-z0-9_]{3,}'))),
w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{3,})', 1))) word from documents where text is not null),
s as (select lang, doc_id, terms, count(*) shared from w join q on q.word = w.word group by 1, 2, 3),
r as (select *, row_number() over (partition by lang order by shared desc, doc_id) rank from s)
select lang, doc_id, rank::int rank, shared::bigint shared, shared / terms score from r where rank <= 5""")
def most_relevant_documents(spark: SparkSession, d: str) -> DataFrame:
    """A top-5 report: for the common words of each language, the documents that use most of them."""
    q = table(spark, d, "common_words").select("lang", F.lower("word").alias("w")).where(F.col("w").rlike("^[a-z0-9_]{3,}$")).distinct().groupBy("lang").agg(F.collect_list("w").alias("terms"))
    return textscan.relevant(q, "lang", "terms", table(spark, d, "documents"), "doc_id", "text")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9''-]+'))"


@query(f"""select doc_id from documents
where lower(trim(coalesce(text, ''), ' ')) in ('.invalid', 'fin', 'the end') or contains(lower(text), '.invalid') or contains(lower(text), 'what if')
  or list_has_any({_WORDS.format("coalesce(text, '')")}, ['map', 'lamp', 'subtitles'])""")
def screened_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name one of a few things."""
    hit = textscan.screened(F.col("text"), F.col("text"), [".invalid"], ["what if", "map", "lamp", "subtitles"], ["fin", "the end"])
    return table(spark, d, "documents").where(hit).select("doc_id")


#: Words that do not tell a claim from others.
_STOP = ["the", "a", "an", "of", "in", "is", "and", "or", "to", "for", "that", "this", "with", "not"]


@query(f"""with f as (select doc_id, lower(trim(text, ' ')) name, text from documents where text is not null),
c as (select lang claim, string_agg(lower(word), ' ' order by word) wording from common_words where lang is not null group by 1),
names as (select name, min(claim) claim from (select wording name, claim from c union all select lower(claim), claim from c) where name is not null group by 1),
fw as (select doc_id, unnest(list_filter({_WORDS.format("text")}, lambda x: not list_contains({_STOP}, x))) word from f where name not in (select name from names)),
cw as (select claim, unnest(list_filter({_WORDS.format("wording")}, lambda x: not list_contains({_STOP}, x))) word from c),
s as (select doc_id, claim, count(*)::bigint overlap from fw join cw using (word) group by 1, 2 having count(*) >= 2),
r as (select *, row_number() over (partition by doc_id order by overlap desc, claim) rn from s)
select doc_id, claim, null::bigint overlap from f join names using (name) union all select doc_id, claim, overlap from r where rn = 1""")
def claimed_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language that each document speaks for: its common words are the wording of the claim."""
    words = table(spark, d, "common_words").where("lang is not null and word is not null")
    claims = words.groupBy(F.col("lang").alias("claim")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("word")), F.lower), " ").alias("wording"))
    return textscan.match_claims(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", claims, "claim", "wording", stop=_STOP)


# Logs


@query("select event_type, count(*)::bigint n, round(sum(value), 2) total, count(distinct user_id)::bigint n_users from events group by 1")
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s = logs.summary_by(e, "event_type", {"total": F.col("value")})
    users = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    return s.join(users, "event_type").select("event_type", "n", F.round("total", 2).alias("total"), "n_users")


_LAST = f"""last as (select * from (select lower(trim(task_id, {_B})) task, stage, status, extra, updated_at,
  row_number() over (partition by lower(trim(task_id, {_B})) order by updated_at desc nulls last, stage desc nulls last, status desc nulls last, extra desc nulls last) rn from task_records where task_id is not null) where rn = 1)"""


@query(f"with {_LAST} select task task_id, stage, status, updated_at from last")
def latest_task_states(spark: SparkSession, d: str) -> DataFrame:
    s = logs.latest_state(table(spark, d, "task_records"), task_key("task_id"), "updated_at", ["stage", "status", "extra"])
    return s.select(F.col("key").alias("task_id"), "stage", "status", "updated_at")


@query(f"with {_LAST} select coalesce(case when extra <> '' then json_extract_string(extra, '$.kind') end, case when stage = 'reports' then 'report_writing' else 'analysis' end) kind, count(*)::bigint n from last group by 1")
def task_mix(spark: SparkSession, d: str) -> DataFrame:
    s = logs.latest_state(table(spark, d, "task_records"), task_key("task_id"), "updated_at", ["stage", "status", "extra"])
    return s.groupBy(logs.task_kind(F.col("extra"), F.col("stage")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""with {_LOCI.replace("min(rt_clade) rt_clade", "min(biosample) biosample")},
p as (select distinct rt_class, biosample, unnest(range(1, 6)) slot from loci),
f as (select rt_class, biosample, row_number() over (partition by rt_class, biosample order by locus_id) slot from loci)
select p.rt_class, p.biosample, p.slot::int slot from p left join f on f.rt_class is not distinct from p.rt_class and f.biosample is not distinct from p.biosample and f.slot = p.slot where f.slot is null""")
def pending_slots(spark: SparkSession, d: str) -> DataFrame:
    """Five loci are planned for each class and biosample that occur together; the slots still without one."""
    loci = table(spark, d, "neighbor_genes").where("locus_id is not null").groupBy("locus_id").agg(F.min("rt_class").alias("rt_class"), F.min("biosample").alias("biosample"))
    # Only five rows a pair matter, so the ranking is pruned before its shuffle.
    done = sampling.first_per_group(loci, ["rt_class", "biosample"], [F.col("locus_id")], 5, "slot")
    planned = loci.select("rt_class", "biosample").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return logs.pending(planned, done, ["rt_class", "biosample", "slot"])


@query("""with w as (select time_bucket(interval '1 day', ts) window_start, event_type, count(*)::bigint n, round(sum(value), 2) total from events group by 1, 2)
select * from w where window_start + interval '1 day' <= (select max(ts) from events) - interval '10 minutes'""")
def streamed_daily_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file stream: days that the watermark has closed."""
    out = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    events = table(spark, d, "events")
    stream = ledger.stream_table(spark, d, events.schema, "events.parquet")
    ledger.run_to_end(ledger.windowed_summary(stream, "ts", "event_type", "value", "1 day"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
