"""Per-document text statistics and robust outlier distances that tell dialogue from lists, tables and junk.

Every document gets figures on its spoken lines (cue numbers, times and tags aside).
For each language the centre and covariance of prose are fitted robustly over all
documents: from the medians outward, by concentration steps that keep the documents
nearest to the present fit. A document's squared Mahalanobis distance splits exactly
into one contribution a statistic, which says what makes it an outlier and of what kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

STATS = ("words_per_line", "word_length", "symbol_ratio", "digit_ratio", "end_punctuation", "common_words", "common_lines", "odd_letters", "odd_words", "delimited_lines")

#: Least standard deviation of each statistic in a fit, so that figures which are all but constant in prose keep a scale.
FLOORS = np.array([0.15, 0.25, 0.02, 0.02, 0.10, 0.03, 0.08, 0.03, 0.03, 0.05])
#: 0.975 and 1 - 1e-7 quantiles of chi-square with len(STATS) degrees of freedom.
NEAR, FAR = 20.48, 52.31
#: Languages with fewer documents near their centre use the fit of all languages together (a parameter of text_quality).
LEAST_DOCS = 40
#: Words of the list of common words that are sent to every task at once; a longer list is looked up in blocks of about so many.
WORD_BLOCK = 100_000
POOLED = "*"

_TIME = r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?"
_PREFIX = re.compile(rf"(?:\d+\s+)?[\[(]{_TIME}\s*-+>?\s*{_TIME}[\])]\s?|\{{\d+\}}\{{\d+\}}")
_CUE = re.compile(rf"\s*\d*\s*|\s*{_TIME}\s*-+>\s*{_TIME}.*|WEBVTT.*|NOTE\b.*")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>|\{\\[^{}]{0,40}\}")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ODD_LETTER = re.compile(r"[^\W\d_a-zàáâäæçèéêëìíîïñòóôöøœùúûüýÿß]")
_FIRM_END = frozenset(".!?…\"”»)]♪*")
_VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ")
_CELLS = re.compile(r"\t|;|\||\",\"|,(?=\S)|(?<=\S) {2,}(?=\S)")
_MIXED = re.compile(r"[a-z][A-Z]|[A-Za-z]\d|\d[A-Za-z]")
_EPISODE = re.compile(r"[A-Za-z]\d+[A-Za-z]\d+")


def spoken_lines(text: str) -> list[str]:
    """The text's lines without cue numbers, times, headers and tags; empty lines left out."""
    lines = []
    for line in text.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if (m := _PREFIX.match(line)) is not None:
            rest = line[m.end() :]
            parts = rest.split("|") if line[0] == "{" else rest.split(" / ")
        elif _CUE.fullmatch(line):
            continue
        else:
            parts = (line,)
        for part in parts:
            if "<" in part or "{" in part:
                part = _TAG.sub("", part)
            if part := part.strip():
                lines.append(part)
    return lines


def _odd_word(w: str) -> bool:
    """No word of a language with vowels: none of them, or a long run of other letters, or one letter again and again."""
    low = w.lower()
    n = len(low)
    if n < 4:
        return False
    vowels = sum(c in _VOWELS for c in low)
    return vowels * 6 < n or n > 24 or len(set(low)) <= max(1, n // 6)


@lru_cache(200_000)
def _odd_known(w: str) -> bool:
    return _odd_word(w)


def _cells(line: str) -> int:
    """Separators of cells in a line whose cells hold letters or digits; 0 if it is mostly signs."""
    found = len(_CELLS.findall(line))
    if found < 3:
        return 0
    solid = line.replace(" ", "")
    return found if sum(map(str.isalnum, solid)) * 5 >= 2 * len(solid) else 0


def line_words(text: str) -> tuple[list[str], list[list[str]]]:
    """The spoken lines, and the words of each in lower case."""
    lines = spoken_lines(text)
    return lines, list(map(_WORD.findall, "\n".join(lines).lower().split("\n")))


def common_hits(per_line: list[list[str]], common: dict[str, frozenset[str]]) -> dict[str, tuple[int, list[int]]]:
    """By language, how many of the words are on its list, and the numbers of the lines that hold one; languages without any left out."""
    every = frozenset().union(*common.values()) if len(common) != 1 else next(iter(common.values()))
    frequent = Counter(w for ws in per_line for w in ws if w in every)
    found = {lang: n for lang, known in common.items() if (n := sum(c for w, c in frequent.items() if w in known))}
    return {lang: (n, [i for i, ws in enumerate(per_line) if not common[lang].isdisjoint(ws)]) for lang, n in found.items()}


def told_language(hits: dict[str, tuple[int, list[int]]]) -> str | None:
    """The language with most hits, ties to the first by name."""
    return max(sorted(hits), key=lambda lang: hits[lang][0]) if hits else None


def text_statistics(text: str, common: dict[str, frozenset[str]]) -> tuple[str | None, int, int, list[float]]:
    """The language by its common words (or None), lines, words, and the figures named in STATS."""
    lines, per_line = line_words(text)
    body = "\n".join(lines)
    low = body.lower()
    words = [w for ws in per_line for w in ws]
    n_lines, n_words = max(len(lines), 1), max(len(words), 1)
    hits = common_hits(per_line, common)
    lang = told_language(hits)
    n_common, with_common = hits[lang] if lang else (0, [])
    letters = sum(map(len, words))
    digits = sum(map(len, re.findall(r"\d+", body)))
    tokens = body.split()
    solid = max(sum(map(len, tokens)), 1)
    strange = 0 if low.isascii() else len(_ODD_LETTER.findall(low))
    odd = sum(map(_odd_known, filter(lambda w: len(w) >= 4, words))) + sum(1 for t in tokens if len(t) >= 8 and len(_MIXED.findall(t)) * 5 >= len(t) and not _EPISODE.search(t))
    stats = [
        math.log1p(len(words) / n_lines),
        letters / n_words,
        max(solid - letters - digits, 0) / solid,
        digits / solid,
        sum(x[-1] in _FIRM_END for x in lines) / n_lines,
        n_common / n_words,
        len(with_common) / n_lines,
        strange / letters if letters else 0.0,
        min(1.0, odd / n_words),
        sum(map(bool, map(_cells, lines))) / n_lines if _CELLS.search(body) else 0.0,
    ]
    return lang, len(lines), len(words), stats


@dataclass(frozen=True)
class Fit:
    """Centre and inverse covariance of a language's prose."""

    mean: np.ndarray
    precision: np.ndarray

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Of each row's squared distance, the part of each statistic; a row's parts add up to it."""
        off = x - self.mean
        return off * (off @ self.precision)


def _fit(n: float, sums: np.ndarray, products: np.ndarray) -> Fit:
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    cov = (cov + cov.T) / 2
    return Fit(mean, np.linalg.inv(cov + np.diag(np.maximum(0.0, FLOORS**2 - np.diag(cov)))))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("language").to_numpy(zero_copy_only=False), np.column_stack([np.asarray(batch.column(s)) for s in STATS])


def _distances(fits: dict[str, Fit], lang: np.ndarray, x: np.ndarray) -> np.ndarray:
    parts = np.empty_like(x)
    for name in set(lang):
        at = lang == name
        parts[at] = fits.get(name, fits[POOLED]).contributions(x[at])
    return parts


def _moments(fits: dict[str, Fit]):
    """Of the documents near their fit: count, sums and products, a row for each number, by language and together."""
    p = len(STATS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, x = _rows(batch)
            if not len(x):
                continue
            near = _distances(fits, lang, x).sum(1) <= NEAR
            for name in {*lang[near], POOLED}:
                y = x[near] if name == POOLED else x[near & (lang == name)]
                totals[name] = totals.get(name, 0) + np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        for name, t in totals.items():
            yield pa.RecordBatch.from_pydict({"language": [name] * len(t), "at": list(range(len(t))), "value": t.tolist()}, schema=pa.schema([("language", pa.string()), ("at", pa.int32()), ("value", pa.float64())]))

    assert p == len(FLOORS)
    return work


def _from_moments(moments: DataFrame, least_docs: int) -> dict[str, Fit]:
    """At most one fit for each language of the list of common words, and the pooled one."""
    p, found = len(STATS), {}
    for r in moments.groupBy("language", "at").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["language"], np.zeros(1 + p + p * p))[r["at"]] = r["value"]
    return {name: _fit(t[0], t[1 : 1 + p], t[1 + p :].reshape(p, p)) for name, t in found.items() if t[0] >= (1 if name == POOLED else least_docs)}


def _by_language(words: DataFrame) -> dict[str, frozenset[str]]:
    """A bounded list (lang, word) by language."""
    common: dict[str, set[str]] = {}
    for r in words.collect():
        common.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in common.items()}


def _statistics(rows: DataFrame, common: dict[str, frozenset[str]], extra: str = "") -> DataFrame:
    """doc_id, told, lang, n_lines, n_words and the figures of rows (doc_id, lang, text), with the column extra passed on."""
    fields = [("doc_id", pa.int64()), ("told", pa.string()), ("lang", pa.string()), ("n_lines", pa.int64()), ("n_words", pa.int64()), *((s, pa.float64()) for s in STATS)]
    fields += [(extra, pa.string())] if extra else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            passed = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
            for doc, lang, text, more in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), passed):
                if not (t := text.as_py()).strip():
                    continue
                told, n_lines, n_words, stats = text_statistics(t, common)
                for column, v in zip(out, (doc, told, lang, n_lines, n_words, *stats, more)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(out, fields)], names=[n for n, _ in fields])

    ddl = "doc_id bigint, told string, lang string, n_lines bigint, n_words bigint, " + ", ".join(f"{s} double" for s in STATS)
    return spread(rows).mapInArrow(work, ddl + (f", {extra} string" if extra else ""))


def _block_hits(rows: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """(doc_id, digest, found, hits, lines) of rows (doc_id, digest, text) for each language with words of this block."""
    fields = [("doc_id", pa.int64()), ("digest", pa.string()), ("found", pa.string()), ("hits", pa.int64()), ("lines", pa.list_(pa.int64()))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, digest, lang, n, at) for doc, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text"))) for lang, (n, at) in common_hits(line_words(text)[1], common).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    return spread(rows).mapInArrow(work, "doc_id bigint, digest string, found string, hits bigint, lines array<bigint>").distinct()


def document_statistics(documents: DataFrame, common_words: DataFrame, word_block: int = WORD_BLOCK) -> DataFrame:
    """doc_id, language, n_lines, n_words and the figures named in STATS, of documents with text.

    Documents whose text is null, empty or blank have no figures and no row. language is
    the one whose common words the text uses most (ties: the first by name), else the
    main part of the lang column if the list knows it, else "*". Repeated rows stay. A
    list of more than word_block words is looked up in blocks, one pass over the texts
    each, and hits and lines of the blocks are put together.
    """
    words = common_words.where("lang is not null and word is not null").select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).distinct()
    n = words.count()
    main = F.split(F.lower(F.trim("lang")), "[-_]")[0]
    rows = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), main.alias("lang"), F.col("text").cast("string").alias("text"))
    columns = ["doc_id", "language", "n_lines", "n_words", *STATS]
    if n <= word_block:
        common = _by_language(words)
        language = F.coalesce("told", F.when(F.col("lang").isin(list(common)), F.col("lang")), F.lit(POOLED))
        return _statistics(rows, common).withColumn("language", language).select(*columns)
    words = cut(words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(-(-n // word_block)))))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    met = None
    for block in range(-(-n // word_block)):
        hits = _block_hits(rows.select("doc_id", "digest", "text"), _by_language(words.where(F.col("block") == block)))
        met = hits if met is None else met.unionByName(hits)
    met = met.groupBy("doc_id", "digest", "found").agg(F.sum("hits").alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("with"))
    best = met.groupBy("doc_id", "digest").agg(F.min(F.struct((-F.col("hits")).alias("less"), "found", "with")).alias("b")).select("doc_id", "digest", "b.found", (-F.col("b.less")).alias("hits"), "b.with")
    stats = _statistics(rows, {}, "digest").drop("told").join(best, ["doc_id", "digest"], "left").join(words.select("lang", F.lit(True).alias("listed")).distinct(), "lang", "left")
    stats = stats.withColumn("common_words", F.coalesce(F.col("hits") / F.greatest(F.lit(1), F.col("n_words")), F.lit(0.0))).withColumn("common_lines", F.coalesce(F.col("with") / F.greatest(F.lit(1), F.col("n_lines")), F.lit(0.0)))
    return stats.withColumn("language", F.coalesce("found", F.when(F.col("listed"), F.col("lang")), F.lit(POOLED))).select(*columns)


def fit_prose(stats: DataFrame, steps: int = 3, least_docs: int = LEAST_DOCS) -> dict[str, Fit]:
    """Robust centre and covariance of each language over all documents; languages with fewer than least_docs take that of all together.

    The first fit takes medians and median distances from them; each step then takes
    mean and covariance of the documents within the 0.975 quantile of the fit before.
    """
    per = []
    for by in (["language"], []):
        g = stats.groupBy(*by) if by else stats.groupBy()
        per.append(g.agg(F.count("*").alias("n"), *[F.percentile_approx(s, [0.25, 0.5, 0.75], 10_000).alias(s) for s in STATS]).withColumn("language", F.col("language") if by else F.lit(POOLED)))
    fits: dict[str, Fit] = {}
    for r in per[0].unionByName(per[1]).collect():
        if r["n"] and (r["language"] == POOLED or r["n"] >= least_docs):
            quart = np.array([r[s] for s in STATS])
            # A wider start than the spread of the middle half, so that the first step loses no kind of prose.
            sd = np.maximum(1.5 * (quart[:, 2] - quart[:, 0]) / 1.349, 1.5 * FLOORS)
            fits[r["language"]] = Fit(quart[:, 1], np.diag(1 / sd**2))
    for _ in range(steps if fits else 0):
        new = _from_moments(stats.select("language", *STATS).mapInArrow(_moments(fits), "language string, at int, value double"), least_docs)
        fits = new if POOLED in new else fits
    return fits


def kind_of(distance: float, x: dict[str, float]) -> str | None:
    """`table`, `junk` or `list` of an outlier, by the statistics that mark each of them; None of prose.

    Half of a table's lines are delimited; junk has a fifth of signs or strange letters
    or a twelfth of words that no language has; what else isn't prose is a list.
    """
    if not distance > FAR:
        return None
    if x["delimited_lines"] >= 0.5:
        return "table"
    if x["symbol_ratio"] > 0.2 or x["odd_letters"] > 0.2 or x["odd_words"] > 1 / 12:
        return "junk"
    return "list"


def outliers(stats: DataFrame, fits: dict[str, Fit]) -> DataFrame:
    """doc_id, language, distance (squared), kind (null for prose) and contributions, a map by statistic adding up to distance."""
    fields = [("doc_id", pa.int64()), ("language", pa.string()), ("distance", pa.float64()), ("kind", pa.string()), ("contributions", pa.map_(pa.string(), pa.float64()))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, x = _rows(batch)
            if not len(x):
                continue
            parts = _distances(fits, lang, x)
            distance = parts.sum(1)
            kinds = [kind_of(d, dict(zip(STATS, row))) if d > FAR else None for d, row in zip(distance, x)]
            at = pa.array(np.arange(len(x) + 1) * len(STATS), pa.int32())
            maps = pa.MapArray.from_arrays(at, pa.array(list(STATS) * len(x)), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), pa.array(distance), pa.array(kinds, pa.string()), maps], names=[n for n, _ in fields])

    return stats.select("doc_id", "language", *STATS).mapInArrow(work, "doc_id bigint, language string, distance double, kind string, contributions map<string, double>")


def text_quality(documents: DataFrame, common_words: DataFrame, least_docs: int = LEAST_DOCS, word_block: int = WORD_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Statistics of every document with text, and their outlier distances; texts are read once (once a block of a long list of words)."""
    stats = cut(document_statistics(documents, common_words, word_block))
    return stats, outliers(stats, fit_prose(stats, least_docs=least_docs))
