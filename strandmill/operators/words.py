"""Words of fixed length in sequences and texts: counts, most frequent words, exact-word arrays, open reading frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import gc_fraction, kmers, reverse_complement, translate_codons, usable_seed
from ..session import cut
from .runs import MAX_GAP, MIN_GAP, TOLERANCE, array_runs, longest_tolerant, tolerant_window

# Fixed value: the catalytic motif.
RT_MOTIF = "[YF][ADV]DD"
#: Ids of several rows that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 20_000


def word_positions(df: DataFrame, row_id: str, text: str, k: int) -> DataFrame:
    """(row_id, at, word): every overlapping word of k letters with its place from 0."""
    return df.select(F.col(row_id), F.posexplode(kmers(text, k)).alias("at", "word"))


def word_counts(df: DataFrame, row_id: str, text: str, k: int) -> DataFrame:
    return word_positions(df, row_id, text, k).groupBy(row_id, "word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, row_id: str, text: str, k: int, n: int = 20, seeds_only: bool = True, least: int = 1) -> DataFrame:
    """(row_id, rank, word, n): the n most frequent words of each row, ties by word; seeds_only filters before the cut."""
    counts = word_counts(df, row_id, text, k).where(F.col("n") >= least)
    if seeds_only:
        counts = counts.where(usable_seed("word"))
    w = Window.partitionBy(row_id).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(row_id, "rank", "word", "n")


def _word_keys(codes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """A number for each place's word of k letters, equal where the words are equal; letters are numbers of so many bits."""
    n = len(codes) - k + 1
    if bits * k <= 63:
        out = np.zeros(n, np.int64)
        for i in range(k):
            out <<= bits
            out |= codes[i : i + n]
        return out
    half = (k + 1) // 2
    _, part = np.unique(_word_keys(codes, half, bits), return_inverse=True)
    return part[:n] * len(codes) + part[k - half : k - half + n]


def longest_exact(text: str, k: int, min_copies: int) -> tuple[str, np.ndarray] | None:
    """(word, positions) of the longest, then first, regularly spaced run of exact copies of a word of k letters in one text."""
    if len(text) < k:
        return None
    _, codes = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    keys = _word_keys(codes.astype(np.int64), k, max(1, int(codes.max()).bit_length()))
    order = np.argsort(keys, kind="stable")
    gaps = np.diff(order)
    near = (keys[order[1:]] == keys[order[:-1]]) & (gaps >= MIN_GAP) & (gaps <= MAX_GAP)
    # Maximal runs of near neighbours, from the longest down: a run gives no more copies than it has.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
    starts, sizes = edges[::2], edges[1::2] - edges[::2] + 1
    best: tuple[int, int] | None = None
    found = None
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] < min_copies or best is not None and sizes[i] < -best[0]:
            break
        run = longest_tolerant(order[starts[i] : starts[i] + sizes[i]], min_copies, TOLERANCE)
        if run is not None and (best is None or (-len(run), int(run[0])) < best):
            best, found = (-len(run), int(run[0])), run
    return None if found is None else (text[found[0] : found[0] + k], found)


def exact_word_arrays(df: DataFrame, row_id: str, text: str, k: int = 12, min_copies: int = 3) -> DataFrame:
    """(row_id, word, copies, positions): of each row the word with the longest regularly spaced run of exact copies.

    Ties go to the word whose run begins first, then by word. A text's words are sought
    in the task that reads it; only the texts of ids that several rows have go through a shuffle.
    """
    rows = df.where(F.col(text).isNotNull()).select(row_id, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest_exact(t, k, min_copies) for t in batch.column(1).to_pylist()]
            there = [i for i, f in enumerate(found) if f is not None]
            own = [found[i] for i in there]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there, pa.int64())), pa.array([f[0] for f in own], pa.string()), pa.array([len(f[1]) for f in own], pa.int32()), pa.array([f[1] for f in own], pa.list_(pa.int64()))], names=[row_id, "word", "copies", "positions"])

    kind = T.StructType([T.StructField(row_id, rows.schema[row_id].dataType), *T._parse_datatype_string("word string, copies int, positions array<bigint>").fields])
    best = rows.mapInArrow(work, kind)
    several = cut(rows.groupBy(row_id).agg(F.count("*").alias("n")).where("n > 1").select(F.col(row_id).alias("__several")))
    n = several.count()
    if not n:
        return best
    if n <= BROADCAST_IDS:
        several = F.broadcast(several)
    same = F.col(row_id).eqNullSafe(F.col("__several"))
    return best.join(several, same, "left_anti").unionByName(_arrays_by_word(rows.join(several, same, "left_semi"), row_id, text, k, min_copies))


def _arrays_by_word(df: DataFrame, row_id: str, text: str, k: int, min_copies: int) -> DataFrame:
    """exact_word_arrays over the positions of all rows of an id together; words with too few copies leave before any run is built."""
    at = word_positions(df, row_id, text, k).groupBy(row_id, "word").agg(F.sort_array(F.collect_list(F.col("at").cast("bigint"))).alias("all"))
    spread = at.where((F.size("all") >= min_copies) & (F.element_at("all", -1) - F.element_at("all", 1) >= MIN_GAP * (min_copies - 1)))
    # A word's places in one text are an array as long as the text at most.
    runs = spread.select(row_id, "word", F.explode(array_runs(F.col("all"), MIN_GAP, MAX_GAP, min_copies)).alias("positions"))
    runs = tolerant_window(runs, "positions", min_copies).withColumn("copies", F.size("positions"))
    w = Window.partitionBy(row_id).orderBy(F.desc("copies"), F.col("positions")[0], "word")
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(row_id, "word", "copies", "positions")


def low_complexity(df: DataFrame, text: str, k: int = 3, least: int = 4) -> Column:
    """Whether a row's text has fewer than least different words of k letters."""
    return F.size(F.array_distinct(kmers(text, k))) < least


def open_reading_frames(df: DataFrame, row_id: str, seq: str, min_aa: int = 100) -> DataFrame:
    """(row_id, strand, frame, start, end, protein) of stretches from the first M to the next stop on six frames.

    start and end are 0-based and half-open on the given strand's coordinates mapped back
    to the sequence; end includes the stop. A last stretch without a stop counts, its end
    cut at the sequence's end.
    """
    strands = df.select(F.col(row_id), F.length(seq).alias("len"), F.inline(F.array(F.struct(F.lit("+").alias("strand"), F.upper(F.col(seq)).alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.upper(F.col(seq))).alias("s")))))
    frames = strands.select(row_id, "len", "strand", "s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("frame"))
    proteins = frames.select(row_id, "len", "strand", "frame", F.split(translate_codons(F.expr("substring(s, frame + 1)")), r"\*").alias("chunks"))
    # Where a chunk begins, in amino acids: the lengths and stops of those before it.
    starts = F.expr("aggregate(chunks, array(0), (a, c) -> concat(a, array(element_at(a, -1) + length(c) + 1)))")
    chunks = proteins.withColumn("starts", starts).select(row_id, "len", "strand", "frame", F.posexplode("chunks").alias("i", "chunk"), "starts")
    chunks = chunks.withColumn("m", F.instr("chunk", "M")).where(F.col("m") > 0).withColumn("protein", F.expr("substring(chunk, m)")).where(F.length("protein") >= min_aa)
    first = F.col("frame") + 3 * (F.expr("starts[i]") + F.col("m") - 1)
    chunks = chunks.withColumn("a", first).withColumn("b", F.least(F.col("len"), first + 3 * (F.length("protein") + 1)))
    back = F.col("strand") == "-"
    return chunks.select(row_id, "strand", "frame", F.when(back, F.col("len") - F.col("b")).otherwise(F.col("a")).alias("start"), F.when(back, F.col("len") - F.col("a")).otherwise(F.col("b")).alias("end"), "protein")


def motif_frames(df: DataFrame, row_id: str, seq: str, motif: str = RT_MOTIF, min_aa: int = 100) -> DataFrame:
    """open_reading_frames whose protein holds the motif (a regular expression), with its first match as motif."""
    frames = open_reading_frames(df, row_id, seq, min_aa).withColumn("motif", F.regexp_extract("protein", f"({motif})", 1))
    return frames.where("motif <> ''")


def inventory(df: DataFrame, row_id: str, seq: str) -> DataFrame:
    """(row_id, length_nt, gc) of each sequence, gc null where it is empty."""
    return df.where(F.col(seq).isNotNull()).select(F.col(row_id), F.length(seq).alias("length_nt"), gc_fraction(seq).alias("gc"))
