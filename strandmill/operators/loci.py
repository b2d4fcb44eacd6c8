"""Scans of whole records: the windows upstream of wanted genes, and genomes from end to end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from ..session import cut, dealt, kept
from . import arrays
from .intervals import greedy_non_overlapping
from .runs import regular_runs, spaced_greedily
from .words import top_words

# Least count and number of a genome's seed words, and the letters kept on both sides of a run.
LEAST_COUNT, GENOME_SEEDS, FLANK = 2, 200, 3000
#: Letters of a genome that one row holds.
PIECE = 50_000


def upstream_windows(parsed: DataFrame, wanted: DataFrame, row_id: str, length: int = arrays.CHAIN_WINDOW) -> DataFrame:
    """(locus, rt, record, organism, strand, rt_lo, rt_hi, seq, genes) of every wanted gene of parsed records.

    seq is the window before the gene, read towards it; genes are the other genes that
    reach into it, as (a, b), half-open in the window's coordinates. wanted: ids, cut at
    `|`. A gene that a record names twice is two loci.
    """
    ids = wanted.select(F.trim(F.substring_index(row_id, "|", 1)).alias("rt")).distinct()
    g = parsed.select(F.col("version").alias("record"), "organism", "cds", F.col("seq").alias("whole"), F.posexplode("cds").alias("i", "c")).withColumn("rt", F.col("c.id")).join(ids, "rt", "left_semi")
    plus = F.col("c.strand") != "-"
    g = g.withColumn("a", F.when(plus, F.greatest(F.lit(0), F.col("c.low") - 1 - length)).otherwise(F.col("c.high"))).withColumn("b", F.when(plus, F.col("c.low") - 1).otherwise(F.least(F.length("whole"), F.col("c.high") + length)))
    letters = F.substring("whole", F.col("a") + 1, F.greatest(F.lit(0), F.col("b") - F.col("a")))
    others = F.filter("cds", lambda x, j: (j != F.col("i")) & (x["high"] > F.col("a")) & (x["low"] - 1 < F.col("b")))

    def placed(x):
        lo, hi = F.greatest(x["low"] - 1, F.col("a")), F.least(x["high"], F.col("b"))
        return F.struct(F.when(plus, lo - F.col("a")).otherwise(F.col("b") - hi).alias("a"), F.when(plus, hi - F.col("a")).otherwise(F.col("b") - lo).alias("b"))

    return g.select(F.concat_ws(":", "record", "rt", F.col("i").cast("string")).alias("locus"), "rt", "record", "organism", F.col("c.strand").alias("strand"), F.col("c.low").alias("rt_lo"), F.col("c.high").alias("rt_hi"), F.when(plus, letters).otherwise(reverse_complement(letters)).alias("seq"), F.transform(others, placed).alias("genes"))


def scan_loci(parsed: DataFrame, wanted: DataFrame, row_id: str, **kw) -> DataFrame:
    """One row a wanted gene: where it is, the call of its upstream window, and its delimited array with the flags.

    rt, record, organism, strand, rt_lo, rt_hi, upstream_nt, status, r, seed, delim_copies
    (0 without a delimited array), delim_repeat, coding_repeat, rt_adjacent. kw may hold
    shuffles and retest of the null models.
    """
    w = kept(upstream_windows(parsed, wanted, row_id))
    scan = arrays.scan_arrays(w, "locus", "seq", **({"shuffles": kw["shuffles"]} if "shuffles" in kw else {})).select("locus", "status", "r", "seed")
    found = cut(arrays.delimit_arrays(w, "locus", "seq", **kw))
    blocks = arrays.repeat_blocks(w, found).select("locus", F.col("repeat").alias("delim_repeat"))
    flags = arrays.delimitation_flags(found, w.select("locus", F.inline("genes")), w.select("locus", F.length("seq").alias("size")))
    flags = flags.select("locus", F.size("chain").alias("delim_copies"), "coding_repeat", "rt_adjacent")
    out = w.join(scan, "locus").join(flags, "locus", "left").join(blocks, "locus", "left")
    return out.select("rt", "record", "organism", "strand", "rt_lo", "rt_hi", F.length("seq").alias("upstream_nt"), "status", "r", "seed", F.coalesce("delim_copies", F.lit(0)).alias("delim_copies"), "delim_repeat", "coding_repeat", "rt_adjacent")


def _pieces(genomes: DataFrame, name: str, seq: str, k: int) -> DataFrame:
    """(name, at, piece): overlapping pieces, in which every word of k letters lies once as a start within the first PIECE letters."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, s in zip(pdf.name, pdf.seq):
                starts = range(0, max(1, len(s) - k + 1), PIECE)
                yield pd.DataFrame({"name": n, "at": list(starts), "piece": [s[i : i + PIECE + k - 1] for i in starts]})

    g = genomes.where(F.col(name).isNotNull() & F.col(seq).isNotNull()).select(F.col(name).cast("string").alias("name"), F.upper(F.col(seq)).alias("seq"))
    return g.mapInPandas(work, "name string, at bigint, piece string")


def scan_genomes(genomes: DataFrame, name: str, seq: str, seeds: int = GENOME_SEEDS, least: int = LEAST_COUNT, shuffles: int = arrays.SCAN_SHUFFLES, seed: int = 1) -> DataFrame:
    """(name, start, end, r, seed) of the arrays of whole genomes, none overlapping another: longer ones first, then by place.

    The most frequent words of a genome are sought in its pieces; the window around each
    regularly spaced run of copies is tested like an upstream window.
    """
    k, wrong = arrays.SCAN_WORD, arrays.SCAN_MISMATCHES
    pieces = kept(dealt(_pieces(genomes, name, seq, k)))
    # Words of a piece are counted as if it were a row of its own, then added up for the genome.
    words = cut(top_words(pieces, "name", "piece", k, seeds, least=least).select("name", F.col("rank").alias("word_no"), "word"))
    listed = words.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("word_no", "word"))).alias("w"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, at, piece, ws in zip(pdf.name, pdf["at"], pdf.piece, pdf.w):
                letters = arrays._bytes(piece)
                for x in ws:
                    places = arrays.near_places(letters, arrays._bytes(x["word"]), wrong)
                    yield pd.DataFrame({"name": n, "word_no": x["word_no"], "at": places + at})

    at = dealt(pieces.join(listed, "name")).mapInPandas(near, "name string, word_no int, at bigint")
    runs = cut(regular_runs(spaced_greedily(at, ["name", "word_no"], "at", k), ["name", "word_no"], "at"))
    lengths = genomes.select(F.col(name).cast("string").alias("name"), F.upper(F.col(seq)).alias("whole"))
    spans = runs.join(words, ["name", "word_no"]).join(lengths, "name").select("name", "word", "whole", F.greatest(F.lit(0), F.element_at("positions", 1) - FLANK).alias("lo"), F.least(F.length("whole"), F.element_at("positions", -1) + k + FLANK).alias("hi"))
    windows = spans.select("name", "word", "lo", F.substring("whole", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("seq")).distinct()

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, word, lo, s in zip(pdf.name, pdf.word, pdf.lo, pdf.seq):
                if (found := arrays.scan_window(f"{n}:{word}:{lo}", arrays._bytes(s), [word], wrong, shuffles, seed)) is not None:
                    rows.append((n, int(lo + found[1][0]), int(lo + found[1][-1] + k), len(found[1]), word))
            yield pd.DataFrame(rows, columns=["name", "start", "end", "r", "seed"])

    hits = cut(dealt(windows).mapInPandas(test, "name string, start bigint, end bigint, r int, seed string").distinct())
    return greedy_non_overlapping(hits.withColumn("id", F.concat_ws(":", F.lpad(F.col("start").cast("string"), 12, "0"), "seed")), "name", "start", "end", "r", "id").drop("id")
