"""Column functions on nucleotide and protein strings; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, by first, second and third base in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: Letters by which the blocks of kmers() are apart.
BLOCK = 64


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    """Reversed, with A-T and C-G exchanged in either case; other letters stay."""
    return F.reverse(F.translate(_c(c), "ACGTacgt", "TGCAtgca"))


def gc_fraction(c: Column | str) -> Column:
    """Share of G and C; null for an empty sequence."""
    s = _c(c)
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s))


def kmers(c: Column | str, k: int) -> Column:
    """Array of all overlapping words of k letters in order; empty if the string is shorter.

    The string is cut into overlapping blocks first: finding the i-th letter of a string
    takes i steps, so words are taken from short strings.
    """
    s = _c(c)
    blocks = F.transform(F.sequence(F.lit(0), F.length(s) - k, F.lit(BLOCK)), lambda b: F.substring(s, b + 1, F.lit(BLOCK + k - 1)))
    words = F.flatten(F.transform(blocks, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.substring(x, i, F.lit(k)))))
    return F.when(F.length(s) >= k, words).when(s.isNotNull(), F.array().cast("array<string>"))


def distinct_letters(c: Column | str) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(_c(c), ""), lambda x: x != "")))


def usable_seed(c: Column | str) -> Column:
    """At least three different letters, and none six times in a row."""
    s = _c(c)
    return (distinct_letters(s) >= 3) & ~s.rlike(r"(.)\1{5}")


def mismatches(a: Column | str, b: Column | str) -> Column:
    """Differing places of two strings up to the shorter one's end."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    pairs = F.zip_with(x, y, lambda p, q: F.when(p.isNull() | q.isNull() | (p == q), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda n, d: n + d)


def translate_codons(c: Column | str) -> Column:
    """Amino acids of the codons from the first letter on: `*` stops, X for an unknown codon, a rest of one or two letters dropped."""
    code = F.create_map(*[F.lit(v) for i, x in enumerate(BASES) for j, y in enumerate(BASES) for k, z in enumerate(BASES) for v in (x + y + z, AMINO_ACIDS[16 * i + 4 * j + k])])
    s = F.upper(_c(c))
    n = F.floor(F.length(s) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(code, F.substring(s, i * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(n > 0, F.array_join(codons, "")).when(s.isNotNull(), F.lit(""))


def upstream_window(seq: Column | str, start: Column, end: Column, strand: Column, length: int = 6000) -> Column:
    """The length letters before a gene (1-based, both ends inside), read towards it: reversed and complemented for `-`."""
    s = _c(seq)
    left = F.greatest(start - length, F.lit(1))
    plus = F.substring(s, left, start - left)
    return F.when(strand == "-", reverse_complement(F.substring(s, end + 1, F.lit(length)))).otherwise(plus)


def clamped_window(lo: Column, hi: Column, flank: int, least: int = 0) -> tuple[Column, Column]:
    """An interval widened by flank on both sides, its lower end not below least."""
    return F.greatest(F.lit(least), lo - flank), hi + flank
