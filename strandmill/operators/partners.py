"""Families of neighbouring genes: conservation, independence and an exact proximity test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gamma import hypergeometric_tail
from ..functions.keys import key_form

# The thresholds of conservation, independence, proximity and significance.
MIN_LOCI, MIN_SHARE, MIN_CLUSTERS, MIN_BIOSAMPLES, MIN_CLASSES, NEAR_BP, ALPHA = 3, 0.1, 3, 3, 2, 100, 0.05


def family_name(family: Column, cluster: Column) -> Column:
    """The family in key form if it isn't null or empty, else `CLUSTER:` and the cluster."""
    f = key_form(family)
    return F.when(F.length(f) > 0, f).otherwise(F.concat(F.lit("CLUSTER:"), cluster))


def near(adjacent: Column, same_strand: Column, distance: Column) -> Column:
    """Adjacent, and on the same strand or at most NEAR_BP away; an unknown distance is not near."""
    return F.coalesce((adjacent == 1) & ((same_strand == 1) | F.coalesce(distance <= NEAR_BP, F.lit(False))), F.lit(False))


def score_partners(genes: DataFrame) -> DataFrame:
    """One row a family: its counts, whether it is conserved and independent, its p-value, and promoted.

    genes: gene_id, locus_id, family, rt_clade, rt_class, cluster_id_90, biosample,
    rt_adjacent, same_strand_as_rt, distance_to_adjacent_bp; repeated rows count once.
    The null hypothesis draws as many genes as the family has from all genes of its
    loci; the number of near ones is then hypergeometric, so the test is exact. p is 1
    where conservation or independence fails.
    """
    g = genes.select("gene_id", "locus_id", family_name(F.col("family"), F.col("cluster_id_90")).alias("fam"), "rt_clade", "rt_class", "cluster_id_90", "biosample", near(F.col("rt_adjacent"), F.col("same_strand_as_rt"), F.col("distance_to_adjacent_bp")).cast("int").alias("near"))
    g = g.where("locus_id is not null and fam is not null").distinct()
    clades = g.select("rt_clade", "locus_id").distinct().groupBy("rt_clade").agg(F.count("*").alias("total"))
    per_clade = g.select("fam", "rt_clade", "locus_id").distinct().groupBy("fam", "rt_clade").agg(F.count("*").alias("n"))
    conserved = per_clade.join(clades, "rt_clade", "left").groupBy("fam").agg(F.bool_or((F.col("n") >= MIN_LOCI) | (F.col("n") >= MIN_SHARE * F.coalesce("total", F.lit(0)))).alias("conserved"), F.sum("n").alias("n_loci"))
    counts = g.groupBy("fam").agg(F.count("*").alias("n_genes"), F.sum("near").alias("n_near"), F.count_distinct("cluster_id_90").alias("n_clusters"), F.count_distinct("biosample").alias("n_biosamples"), F.count_distinct("rt_class").alias("n_classes"))
    loci = g.groupBy("locus_id").agg(F.count("*").alias("genes_here"), F.sum("near").alias("near_here"))
    pool = g.select("fam", "locus_id").distinct().join(loci, "locus_id").groupBy("fam").agg(F.sum("genes_here").alias("pool"), F.sum("near_here").alias("pool_near"))
    out = counts.join(conserved, "fam").join(pool, "fam")
    out = out.withColumn("independent", (F.col("n_clusters") >= MIN_CLUSTERS) & (F.col("n_biosamples") >= MIN_BIOSAMPLES) & (F.col("n_classes") >= MIN_CLASSES))
    p = hypergeometric_tail(F.col("n_near"), F.col("pool"), F.col("pool_near"), F.col("n_genes"))
    out = out.withColumn("p", F.when(F.col("conserved") & F.col("independent"), p).otherwise(1.0))
    return out.withColumn("promoted", F.col("p") <= ALPHA).withColumnRenamed("fam", "family")
