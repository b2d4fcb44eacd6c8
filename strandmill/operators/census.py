"""From domain hits to retained proteins, families and expression: compositions of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import kmers, reverse_complement
from ..session import cut
from .abundance import proper_alignments, tpm
from .best import best_per_key
from .graph import components, reachable, symmetric
from .intervals import overlap_join, union_length_windowed

# Thresholds of the census, and the words in a profile's name that tell its class, most specific first.
WEAK_SCORE, WEAK_COVERAGE, CORE_COVERAGE, MIN_LENGTH = 25.0, 0.35, 0.75, 225
CLASS_WORDS = (
    ("group_ii_like", "group II-like"), ("group-ii-like", "group II-like"), ("group_ii", "group II intron"), ("group-ii", "group II intron"),
    ("intron", "group II intron"), ("crispr", "CRISPR-assoc"), ("retron", "retron"), ("dgr", "DGR"), ("abi", "Abi"), ("ug", "UG"), ("novel", "novel"),
)
#: Quality control of predicted proteins.
MAX_PROTEIN, MIN_TRIMERS, MAX_MASKED = 8000, 4, 0.5
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def class_of_profile(name: Column | str) -> Column:
    """The class whose word is first found in the lower-cased profile name; `unknown` if none is."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(word)), kind) for word, kind in CLASS_WORDS], F.lit("unknown"))


def best_profiles(domains: DataFrame) -> DataFrame:
    """One row a target: its best profile by best domain score (ties: the first in the file), with the profile's joint coverage.

    domains: target, tlen, query, qlen, score, hmm_from, hmm_to, ordinal. Coverage is the
    union of all domain lines of the winning profile in model coordinates.
    """
    lines = domains.where("target is not null and query is not null and score is not null")
    best = best_per_key(lines, ["target"], [F.desc("score"), F.col("ordinal")]).select("target", "tlen", "query", "qlen", "score")
    own = lines.join(best.select("target", "query"), ["target", "query"], "left_semi")
    covered = union_length_windowed(own, ["target", "query"], "hmm_from", "hmm_to")
    joined = best.join(covered, ["target", "query"], "left")
    return joined.select("target", "tlen", "query", "qlen", F.col("score").alias("bitscore"), (F.coalesce("covered", F.lit(0)) / F.col("qlen")).alias("coverage"), class_of_profile("query").alias("rt_class"))


def verdict(bitscore: Column, coverage: Column, length: Column, has_motif: Column, least_length: Column | int = MIN_LENGTH) -> Column:
    """`weak`, `fragment`, `short` or `kept`. An unknown motif is not an absent one; an unknown length is short."""
    least = F.lit(least_length) if isinstance(least_length, int) else least_length
    weak = (bitscore < WEAK_SCORE) & (coverage < WEAK_COVERAGE) & has_motif.eqNullSafe(F.lit(False))
    return F.when(weak, "weak").when(~F.coalesce(coverage >= CORE_COVERAGE, F.lit(False)), "fragment").when(~F.coalesce(length >= least, F.lit(False)), "short").otherwise("kept")


def protein_quality(proteins: DataFrame, header: str | None, seq: str, mask: DataFrame | None = None, row_id: str = "id") -> DataFrame:
    """Proteins that pass quality control, of equal sequences the one with the smallest ordinal.

    The header must say partial=00 where one is given; only the 20 amino acids, at most
    MAX_PROTEIN of them, at least MIN_TRIMERS different words of three; less than half
    masked (lower case or X in mask's seq) where mask knows the protein. Equal sequences
    are compared among survivors only. proteins has an ordinal.
    """
    s = F.col(seq)
    ok = proteins.where(s.isNotNull() & (s != "") & ~s.rlike(f"[^{AMINO_ACIDS}]") & (F.length(s) <= MAX_PROTEIN) & (F.size(F.array_distinct(kmers(s, 3))) >= MIN_TRIMERS))
    if header:
        ok = ok.where(F.contains(F.col(header), F.lit("partial=00")))
    if mask is not None:
        share = F.length(F.regexp_replace("seq", "[^a-zX]", "")) / F.length("seq")
        masked = mask.groupBy(row_id).agg(F.max(share).alias("__share"))
        ok = ok.join(masked, row_id, "left").where(F.coalesce("__share", F.lit(0.0)) < MAX_MASKED).drop("__share")
    # Equal contents meet by a 256-bit digest, so no sequence is a shuffle key.
    return best_per_key(ok.withColumn("__digest", F.sha2(s, 256)), ["__digest"], [F.col("ordinal")]).drop("__digest")


def family_of_seed(hits: DataFrame, seeds: DataFrame, clusters: DataFrame, lengths: DataFrame, least_score: float = 140.0, band: tuple[int, int] = (350, 900)) -> DataFrame:
    """Members of the clusters whose representative is connected with a seed by strong hits, within a length band.

    hits: query, subject, bitscore; seeds: node; clusters: representative, member; lengths: id, length.
    """
    edges = symmetric(hits.where(F.col("bitscore") >= least_score).select(F.col("query").alias("src"), F.col("subject").alias("dst")))
    family = cut(reachable(edges, seeds).select(F.col("node").alias("representative")))
    members = clusters.join(family, "representative", "left_semi").select(F.col("member").alias("id")).unionByName(family.select(F.col("representative").alias("id"))).distinct()
    return members.join(lengths, "id").where(F.col("length").between(*band))


def expression(alignments: DataFrame, features: DataFrame) -> DataFrame:
    """feature, library, length, fragments and tpm of properly paired alignments over features.

    alignments: library, ref, strand, lo, hi, fragment, mapq, flag, tlen; features:
    feature, ref, strand, lo, hi. A fragment that overlaps features of its strand counts
    once for the only one; one that overlaps several counts for none. A feature without
    fragments in a library has no row there (its tpm is 0).
    """
    a = proper_alignments(alignments).select("library", F.concat_ws(":", "ref", "strand").alias("place"), F.col("lo").alias("a"), F.col("hi").alias("b"), "fragment")
    f = features.select("feature", F.concat_ws(":", "ref", "strand").alias("place"), F.col("lo").alias("c"), F.col("hi").alias("d"))
    met = overlap_join(a, f, "place", ("a", "b"), ("c", "d")).select("library", "fragment", "feature").distinct()
    single = met.groupBy("library", "fragment").agg(F.count("*").alias("n"), F.min("feature").alias("feature")).where("n = 1")
    counts = single.groupBy("library", "feature").agg(F.count("*").alias("fragments"))
    lengths = features.select("feature", (F.col("hi") - F.col("lo") + 1).alias("length"))
    return tpm(counts.join(lengths, "feature"), "library", "length", "fragments")


def shared_repeat_groups(repeats: DataFrame, locus: str, repeat: str, k: int = 8) -> DataFrame:
    """(locus, group) of loci whose repeats share words of k letters on either strand, directly or through others.

    Every locus is linked to the first locus of each of its words, never all with all;
    the groups are the connected components, named by their first locus. A word counts
    as the smaller of itself and its reverse complement. Loci that share none are left out.
    """
    r = repeats.where(F.col(repeat).isNotNull() & F.col(locus).isNotNull()).select(F.col(locus).alias("locus"), F.explode(F.array_distinct(kmers(F.upper(F.col(repeat)), k))).alias("w"))
    r = r.select("locus", F.least("w", reverse_complement("w")).alias("word")).distinct()
    hubs = r.groupBy("word").agg(F.min("locus").alias("src"))
    edges = r.join(hubs, "word").where("locus <> src").select("src", F.col("locus").alias("dst"))
    return components(edges).select(F.col("node").alias("locus"), F.col("component").alias("group"))


def numbered(df: DataFrame, groups: list[str], order: list[Column], prefix: str = "L", width: int = 2) -> DataFrame:
    """df with name: prefix and the row's number in its group's order, padded with zeros to width."""
    n = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("string")
    return df.withColumn("name", F.concat(F.lit(prefix), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)))
