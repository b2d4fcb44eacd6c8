"""Screening and ranking of texts by words, terms and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(c: Column | str, pattern: str = "[a-z0-9_]{3,}") -> Column:
    """Distinct matches of a pattern in the lower-cased text; an empty array for null."""
    t = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)))


def slug(c: Column | str, most: int = 60) -> Column:
    """Lower case, runs of other characters as one `-`, none at the ends, cut to most characters, `entry` if nothing is left."""
    t = F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]+", "-")
    t = F.btrim(F.substring(F.btrim(t, F.lit("-")), 1, most), F.lit("-"))
    return F.coalesce(F.when(t != "", t), F.lit("entry"))


def last_match(c: Column | str, pattern: str) -> Column:
    """The first group of the pattern's last match; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(pattern), F.lit(1)), F.lit(-1))


def mentions(texts: DataFrame, row_id: str, text: str, identifiers: DataFrame, identifier: str, pattern: str = "[a-z0-9_]+") -> DataFrame:
    """(row_id, identifier) of texts that hold an identifier as a whole word, in any case.

    Both sides become words and meet in an equi-join; nothing is searched pair by pair.
    """
    words = texts.select(F.col(row_id), F.explode(terms(text, pattern)).alias("word"))
    names = identifiers.where(F.col(identifier).isNotNull()).select(F.lower(F.col(identifier)).alias("word")).distinct()
    return words.join(names, "word").select(row_id, F.col("word").alias(identifier))


def relevant(queries: DataFrame, query_id: str, query_terms: str, texts: DataFrame, row_id: str, text: str, n: int = 5, pattern: str = "[a-z0-9_]{3,}") -> DataFrame:
    """(query_id, row_id, rank, shared, score): for each query the n texts sharing the largest part of its terms, none without a shared term.

    Ties go to the smaller row id. Only pairs with a common term meet.
    """
    q = queries.select(F.col(query_id), F.size(query_terms).alias("terms"), F.explode(query_terms).alias("word"))
    words = texts.select(F.col(row_id), F.explode(terms(text, pattern)).alias("word"))
    shared = words.join(q, "word").groupBy(query_id, row_id, "terms").agg(F.count("*").alias("shared"))
    w = Window.partitionBy(query_id).orderBy(F.desc("shared"), row_id)
    ranked = shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select(query_id, row_id, "rank", "shared", (F.col("shared") / F.greatest(F.lit(1), F.col("terms"))).alias("score"))


def screened(text: Column, exact: Column, ids: list[str] = (), phrases: list[str] = (), wordings: list[str] = (), pattern: str = "[a-z0-9'-]+") -> Column:
    """Whether a text names one of a few given things, in any case; false for null.

    An id counts anywhere in the text, also inside a word; a phrase with a blank anywhere,
    one without as a whole word; ids and wordings also if exact, blanks at its ends cut
    off, equals one.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    lower = lambda names: [n.lower() for n in names]
    words = [p for p in lower(phrases) if " " not in p]
    hit = F.lower(F.trim(F.coalesce(exact, F.lit("")))).isin([*lower(ids), *lower(wordings)])
    for part in [*lower(ids), *[p for p in lower(phrases) if " " in p]]:
        hit = hit | low.contains(part)
    if words:
        hit = hit | F.arrays_overlap(terms(text, pattern), F.array(*map(F.lit, words)))
    return hit


def match_claims(findings: DataFrame, finding_id: str, text: str, claims: DataFrame, claim_id: str, wording: str, least: int = 2, evidence: str | None = None, stop: list[str] = ()) -> DataFrame:
    """(finding_id, claim_id, overlap): the claim of each finding.

    A finding whose text, blanks at its ends cut off, is a claim's id or wording in any case
    has that claim, with overlap null. Any other has the claim that shares most words
    with its text and evidence, stop words aside, at least least. Ties go to the smaller
    claim id; findings without a claim, null ids and null texts give no row. finding_id is
    unique; repeated claims count once.
    """
    pattern = "[a-z0-9'-]+"
    named = claims.where(F.col(claim_id).isNotNull()).select(F.col(claim_id), F.lower(wording).alias("__wording"))
    names = named.select(claim_id, F.explode(F.array(F.lower(F.col(claim_id)), "__wording")).alias("__name")).where("__name is not null")
    names = names.groupBy("__name").agg(F.min(claim_id).alias(claim_id))
    body = F.col(text) if evidence is None else F.concat_ws(" ", text, evidence)
    rows = findings.where(F.col(finding_id).isNotNull()).select(F.col(finding_id), F.lower(F.trim(text)).alias("__name"), body.alias("__body"))
    exact = rows.join(names, "__name").select(finding_id, claim_id, F.lit(None).cast("bigint").alias("overlap"))
    word = lambda c: F.explode(F.array_except(terms(c, pattern), F.array(*map(F.lit, stop)).cast("array<string>"))).alias("__word")
    # Only texts that no claim names go on to the comparison of words.
    rest = rows.join(names.select("__name"), "__name", "left_anti")
    c = named.select(claim_id, word("__wording")).distinct()
    pairs = rest.select(finding_id, word("__body")).join(c, "__word").groupBy(finding_id, claim_id).agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    best = pairs.groupBy(finding_id).agg(F.max("overlap").alias("overlap"), F.min_by(claim_id, F.struct(-F.col("overlap"), F.col(claim_id))).alias(claim_id))
    return exact.unionByName(best)
