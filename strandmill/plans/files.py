"""Round trips: tables written in the file formats of the sources and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_form
from ..operators import anchors, words
from ..session import ensure_checkpoint_dir
from ..sources import delimited, logs, sequences
from .tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _text(df: DataFrame, path: str) -> str:
    df.select("value").write.text(path)
    return path


@query("select protein_id id, max(sequence) seq from proteins where sequence is not null and sequence <> '' group by 1")
def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written as FASTA and read back, the last record of each id."""
    path = _place(spark)
    rows = table(spark, d, "proteins").where("sequence is not null and sequence <> ''").groupBy("protein_id").agg(F.max("sequence").alias("seq"))
    sequences.write_fasta(rows, "protein_id", "seq", path)
    return sequences.last_of_each(sequences.read_fasta(spark, path)).select("id", "seq")


@query("select target_id, label, bitscore, coverage, seq_identity, count(*)::bigint n from tier2_hits where target_id is not null and label is not null and bitscore is not null and not isnan(bitscore) group by 1, 2, 3, 4, 5")
def hit_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    delimited.write_table(table(spark, d, "tier2_hits").select(*delimited.TIER2), path, header=False)
    rows = delimited.positional_table(spark, path, delimited.TIER2).where("target_id <> '-' and label <> '-' and bitscore is not null and not isnan(bitscore)")
    return rows.groupBy(*delimited.TIER2).agg(F.count("*").alias("n"))


@query("select gene_id, locus_id, rt_class, rt_adjacent, distance_to_adjacent_bp, count(*)::bigint n from neighbor_genes group by 1, 2, 3, 4, 5")
def neighbour_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    delimited.write_table(table(spark, d, "neighbor_genes").select(*delimited.NEIGHBOUR_GENES), path, header=False)
    rows = delimited.positional_table(spark, path, delimited.NEIGHBOUR_GENES)
    return rows.groupBy("gene_id", "locus_id", "rt_class", "rt_adjacent", "distance_to_adjacent_bp").agg(F.count("*").alias("n"))


@query("select cluster_id, coalesce(size::varchar, '-') size, count(*)::bigint n from clusters group by 1, 2")
def header_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    delimited.write_table(table(spark, d, "clusters").select("cluster_id", "size"), path)
    return delimited.header_table(spark, path, ["cluster_id", "size"]).groupBy("cluster_id", "size").agg(F.count("*").alias("n"))


@query("select distinct target_id id from tier1_hits where regexp_full_match(target_id, 'PRT[0-9]+')")
def identifier_list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "tier1_hits").where("target_id is not null").select(F.concat(F.lit(" "), "target_id").alias("value"))
    return delimited.identifiers(spark, _text(ids, _place(spark)), "PRT[0-9]+")


@query("select rt_clade, count(*)::bigint loci_total from (select locus_id, min(rt_clade) rt_clade from neighbor_genes where locus_id is not null group by 1) where rt_clade is not null group by 1")
def clade_totals_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Totals written with an older row of each clade before, of which the last counts."""
    loci = table(spark, d, "neighbor_genes").where("locus_id is not null").groupBy("locus_id").agg(F.min("rt_clade").alias("rt_clade")).where("rt_clade is not null")
    totals = loci.groupBy("rt_clade").agg(F.count("*").alias("n"))
    old = totals.select(F.lit(0).alias("age"), "rt_clade", (F.col("n") + 7).alias("n"))
    lines = old.unionByName(totals.select(F.lit(1).alias("age"), "rt_clade", "n")).coalesce(1).sortWithinPartitions("age")  # one row a clade: one small file
    return delimited.clade_totals(spark, _text(lines.select(F.concat_ws("\t", "rt_clade", "n").alias("value")), _place(spark)))


@query("select target_id target, label query, 100 + length(label)::int qlen, bitscore score, count(*)::bigint n from tier2_hits where target_id is not null and label is not null and bitscore is not null and not isnan(bitscore) group by 1, 2, 3, 4")
def domain_hits_round_trip(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "tier2_hits").where("target_id is not null and label is not null and bitscore is not null and not isnan(bitscore)")
    fields = [F.lit("-")] * 23
    fields[0], fields[2], fields[3], fields[5] = F.col("target_id"), F.lit("300"), F.col("label"), (100 + F.length("label")).cast("string")
    fields[13], fields[15], fields[16] = F.col("bitscore").cast("string"), F.lit("1"), F.lit("90")
    lines = hits.select(F.concat_ws("  ", *fields).alias("value"))
    rows = sequences.read_domain_hits(spark, _text(lines.unionByName(lines.limit(1).select(F.lit("# comment").alias("value"))), _place(spark)))
    return rows.where("tlen = 300 and hmm_from = 1 and hmm_to = 90").groupBy("target", "query", "qlen", "score").agg(F.count("*").alias("n"))


@query("select task_id, stage, status, nullif(parent, '') parent, revisions, count(*)::bigint n from task_records group by 1, 2, 3, 4, 5")
def task_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    logs.append_json_log(table(spark, d, "task_records").select("task_id", "stage", "status", F.nullif("parent", F.lit("")).alias("parent"), "revisions"), path)
    rows = logs.read_json_log(spark, path, logs.TASK)
    return rows.groupBy("task_id", "stage", "status", "parent", "revisions").agg(F.count("*").alias("n"))


_LOCATED = "located as (select distinct protein_id, least(start_pos, end_pos) lo, greatest(start_pos, end_pos) hi, strand from proteins where protein_id is not null and start_pos is not null and end_pos is not null and strand in ('+', '-'))"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A GenBank record for each distinct gene, written and parsed."""
    p = table(spark, d, "proteins").where("protein_id is not null and start_pos is not null and end_pos is not null and strand in ('+', '-')")
    p = p.select("protein_id", F.least("start_pos", "end_pos").alias("lo"), F.greatest("start_pos", "end_pos").alias("hi"), "strand").distinct()
    place = F.concat("lo", F.lit(".."), "hi")
    place = F.when(F.col("strand") == "-", F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    lines = F.concat_ws("\n", F.concat(F.lit("LOCUS       "), "protein_id"), F.concat(F.lit("VERSION     "), "protein_id"), F.lit("FEATURES             Location/Qualifiers"), F.concat(F.lit("     CDS             "), place), F.concat(F.lit('                     /protein_id="'), "protein_id", F.lit('"')), F.lit("ORIGIN\n        1 acgtacgt\n//"))
    return sequences.parse_genbank(sequences.read_genbank_records(spark, _text(p.select(lines.alias("value")), _place(spark))))


@query(f"with {_LOCATED} select protein_id version, protein_id id, lo::int low, hi::int high, strand, 'ACGTACGT' seq from located")
def genbank_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("version", F.inline("cds"), "seq")


@query(f"""with {_LOCATED}, single as (select protein_id, min(lo) lo, min(hi) hi, min(strand) strand from located group by 1 having count(*) = 1)
select protein_id || chr(9) || 'genbank' || chr(9) || 'CDS' || chr(9) || lo || chr(9) || hi || chr(9) || '.' || chr(9) || strand || chr(9) || '0' || chr(9) || 'gene_id "' || protein_id || '"; transcript_id "' || protein_id || '";' as value from single""")
def gtf_of_genes(spark: SparkSession, d: str) -> DataFrame:
    """GTF lines of genes with one place; the writer refuses an id with several."""
    records = _records(spark, d)
    once = records.groupBy("version").agg(F.count("*").alias("n")).where("n = 1").select("version")
    return sequences.gtf_lines(records.join(once, "version", "left_semi"))


@query("""with c as (select target_id feature, count(*) filter (where rt_class = 'retron') a, count(*) filter (where rt_class = 'DGR') b from tier1_hits where target_id is not null group by 1)
select feature, 300 length, 0 library_no, a::bigint fragments from c union all select feature, 300, 1, b from c""")
def feature_counts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "tier1_hits").where("target_id is not null").groupBy("target_id").agg(F.count_if(F.col("rt_class") == "retron").alias("a"), F.count_if(F.col("rt_class") == "DGR").alias("b"))
    lines = c.select(F.concat_ws("\t", "target_id", F.lit("chr"), F.lit("1"), F.lit("300"), F.lit("+"), F.lit("300"), F.col("a").cast("string"), F.col("b").cast("string")).alias("value"))
    head = spark.createDataFrame([("# program",), ("Geneid\tChr\tStart\tEnd\tStrand\tLength\tl1\tl2",)], "value string")
    return delimited.feature_counts(spark, _text(head.unionByName(lines), _place(spark)))


@query("select locus_id target, label, count(*)::bigint n from (select distinct locus_id, gene_id, coalesce(nullif(upper(trim(family, ' ' || chr(9) || chr(10) || chr(13))), ''), '-') as label from neighbor_genes where locus_id is not null) group by 1, 2")
def neighbour_lists_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "neighbor_genes").where("locus_id is not null").select("locus_id", "gene_id", F.coalesce(F.nullif(key_form("family"), F.lit("")), F.lit("-")).alias("label")).distinct()
    rows = delimited.neighbour_lists(spark, _text(g.select(F.concat_ws("\t", "locus_id", "label").alias("value")), _place(spark)))
    return rows.groupBy("target", "label").agg(F.count("*").alias("n"))


@query("select protein_id, length(seq)::int length_nt, length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) gc from (select protein_id, max(sequence) seq from proteins where sequence is not null and sequence <> '' group by 1)")
def sequence_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Length and share of G and C of every sequence."""
    s = table(spark, d, "proteins").where("sequence is not null and sequence <> ''").groupBy("protein_id").agg(F.max("sequence").alias("seq"))
    return words.inventory(s, "protein_id", "seq")


_ANCHORS = """a as (select locus_id rt_id, case when min(rt_class) = 'unknown' then 'unplaced' else min(rt_class) end rt_class, min(rt_clade) clade,
  case when count(distinct gene_id) = 1 then 'singleton' else 'member' end kind from neighbor_genes where locus_id is not null group by 1),
m as (select *, row_number() over (partition by rt_class order by rt_id) first_rn, row_number() over (partition by rt_class order by md5('1:' || rt_id), rt_id) rn from a where kind <> 'singleton'),
s as (select *, row_number() over (partition by rt_class order by md5('1:' || rt_id), rt_id) rn from a where kind = 'singleton'),
c as (select *, row_number() over (partition by rt_class, clade order by md5('1:' || rt_id), rt_id) rn, count(*) over (partition by rt_class, clade) size from a where clade <> ''),
z as (select clade, max(size) size from c where rt_class = 'UG' group by 1),
z2 as (select *, size < 30 small, sum(case when size < 30 then size else 0 end) over () small_sum from z),
z3 as (select *, case when small_sum > 700 then small else not small end pool, case when small_sum > 700 then 700 else 700 - small_sum end room from z2),
z4 as (select *, sum(case when pool then size end) over () pool_sum from z3),
z5 as (select *, case when pool then size * room // pool_sum end fl, case when pool then size * room % pool_sum end rest from z4),
z6 as (select *, room - sum(fl) over () lft, row_number() over (partition by pool order by rest desc nulls last, clade) rk from z5),
q as (select clade, case when pool then least(size, fl + case when rk <= lft then 1 else 0 end) when small and small_sum <= 700 then size else 0 end quota from z6),
l as (select clade, row_number() over (order by size desc, clade) lr from (select clade, max(size) size from c where rt_class = 'unplaced' group by 1))"""


@query(f"""with {_ANCHORS}
select rt_id, rt_class, clade, 'first' part, false control from m where (rt_class = 'Abi' and first_rn <= 680) or (rt_class = 'group II-like' and first_rn <= 827)
union all select rt_id, rt_class, clade, 'random', false from m where (rt_class in ('DGR', 'CRISPR-assoc', 'retron') and rn <= 1000) or (rt_class = 'group II intron' and rn <= 500)
union all select rt_id, rt_class, c.clade, 'proportional', false from c join q on q.clade = c.clade where rt_class = 'UG' and rn <= quota
union all select rt_id, rt_class, clade, 'clade', false from c where rt_class = 'novel' and rn <= 60
union all select rt_id, rt_class, c.clade, 'lineage', false from c join l on l.clade = c.clade where rt_class = 'unplaced' and rn = 1 and lr <= 440
union all select rt_id, rt_class, clade, 'singleton', false from s where rt_class = 'unplaced' and rn <= 200""")
def anchor_plan(spark: SparkSession, d: str) -> DataFrame:
    """The loci as anchors: class unknown is unplaced, a locus with one gene is a singleton."""
    g = table(spark, d, "neighbor_genes").where("locus_id is not null")
    genes = g.select("locus_id", "gene_id").distinct().groupBy("locus_id").agg(F.count("gene_id").alias("n"))
    a = g.groupBy("locus_id").agg(F.min("rt_class").alias("rt_class"), F.min("rt_clade").alias("clade")).join(genes, "locus_id")
    a = a.select(F.col("locus_id").alias("rt_id"), F.when(F.col("rt_class") == "unknown", "unplaced").otherwise(F.col("rt_class")).alias("rt_class"), "clade", F.when(F.col("n") == 1, "singleton").otherwise("member").alias("kind"))
    return anchors.plan_anchors(a)
