"""Queries of the corpus problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_form
from ..plans.tables import table
from ..session import cut, kept
from .bpe import count_tokens, encode_documents
from .cooccurrence import cooccurrence
from .digests import certify, digest, digest_quantiles, far_from_median
from .mixing import language_key, mix_sources, read_targets, source_key
from .quality import STATS, text_quality
from .topn import top_n


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # At 8 loci and a lift of 4 the ratio is at least 2 * 8 * (ln 4 - 3/4) = 10.2, so asking for 6.63 (p = 0.01) drops no case.
    pairs = cooccurrence(table(spark, d, "neighbor_genes"), F.col("rt_class"), F.col("locus_id"), key_form("family"), min_count=8, min_lift=4.0, min_llr=6.63)
    return pairs.select(F.col("scope").alias("rt_class"), F.col("item_a").alias("family_a"), F.col("item_b").alias("family_b"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """Each protein once: of rows of one protein_id the latest loaded counts, of equal times the greatest cluster and length."""
    rows = table(spark, d, "proteins").select("protein_id", key_form("cluster_id").alias("cluster_id"), "length", "loaded_at").where("protein_id is not null and cluster_id is not null and length > 0")
    return rows.groupBy("protein_id").agg(F.max(F.struct("loaded_at", "cluster_id", "length")).alias("r")).select("protein_id", "r.cluster_id", "r.length")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return far_from_median(_lengths(spark, d), "protein_id", "cluster_id", "length").select(F.col("id").alias("protein_id"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Estimated percentiles of every cluster's lengths with their certified rank errors."""
    rows = kept(_lengths(spark, d).select("cluster_id", "length"))
    estimates = cut(digest_quantiles(digest(rows, "cluster_id", "length"), [0.1, 0.25, 0.5, 0.75, 0.9]))
    return certify(rows, "cluster_id", "length", estimates).select(F.col("g").alias("cluster_id"), "n", "q", "estimate", "rank_error")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    tiers = [top_n(table(spark, d, t), "target_id", name, "bitscore", 5).select(F.lit(i).cast("int").alias("tier_no"), F.col("group").alias("target_id"), F.col("rank").alias("hit_rank"), F.col("item").alias("hit_name")) for i, t, name in ((1, "tier1_hits", "profile"), (2, "tier2_hits", "label"))]
    return tiers[0].unionByName(tiers[1])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, lang and n_tokens of the documents of target sources."""
    docs = table(spark, d, "documents").withColumn("source", source_key("source")).join(read_targets(table(spark, d, "mix_targets")).select("source"), "source", "left_semi")
    return kept(count_tokens(docs, {"doc_id": F.col("doc_id"), "source": F.col("source"), "lang": language_key("lang")}, F.col("text")))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mixed(spark, d)[1]


def p9_short(spark: SparkSession, d: str) -> DataFrame:
    """The shares where the mix is to be as large as all target sources together, so that small ones fall short and others make up for them."""
    tokens = _sizes(spark, d)
    return mix_sources(tokens, table(spark, d, "mix_targets"), tokens.agg(F.sum("n_tokens")).first()[0] or 0)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    _, far = text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    return far.where("kind is not null").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The figures of every document, its squared distance from its language's prose, and each figure's part in it."""
    stats, far = text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    far = far.select("doc_id", "language", "distance", "kind", *[F.col("contributions")[s].alias(f"part_{s}") for s in STATS])
    return stats.join(far, ["doc_id", "language"])


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_percentiles": p5_percentiles, "p7_found": p7_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_short": p9_short, "p10_found": p10_found, "p10_statistics": p10_statistics}

_B = "' ' || chr(9) || chr(10) || chr(13)"

_BEST = """
select {no}::int tier_no, target_id, hit_rank::int hit_rank, hit_name from (
  select target_id, {name} hit_name, row_number() over (partition by target_id order by max(bitscore) desc, {name}) hit_rank
  from {table} where target_id is not null and {name} is not null and bitscore is not null and not isnan(bitscore) group by target_id, {name})
where hit_rank <= 5"""

ORACLES = {
    "p2_found": f"""
with items as (select distinct rt_class, locus_id, upper(trim(family, {_B})) family from neighbor_genes where rt_class is not null and locus_id is not null and trim(family, {_B}) <> ''),
totals as (select rt_class, count(distinct locus_id) n from items group by 1),
single as (select rt_class, family, count(*) c from items group by 1, 2),
pairs as (select a.rt_class, a.family fa, b.family fb, count(*) c from items a join items b on a.rt_class = b.rt_class and a.locus_id = b.locus_id and a.family < b.family group by 1, 2, 3 having count(*) >= 8)
select p.rt_class, fa family_a, fb family_b from pairs p
join totals t on t.rt_class = p.rt_class join single x on x.rt_class = p.rt_class and x.family = fa join single y on y.rt_class = p.rt_class and y.family = fb
where p.c * t.n >= 4 * x.c * y.c""",
    "p5_found": f"""
with one as (
  select protein_id, cluster_id, length from (
    select protein_id, upper(trim(cluster_id, {_B})) cluster_id, length,
           row_number() over (partition by protein_id order by loaded_at desc nulls last, upper(trim(cluster_id, {_B})) desc, length desc) rn
    from proteins where protein_id is not null and cluster_id is not null and length > 0) where rn = 1),
m as (select cluster_id, median(length) med from one group by 1 having count(*) >= 20)
select protein_id from one join m using (cluster_id) where length > 2 * med or length < med / 2""",
    "p7_found": _BEST.format(no=1, name="profile", table="tier1_hits") + " union all " + _BEST.format(no=2, name="label", table="tier2_hits"),
}
