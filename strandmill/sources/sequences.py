"""FASTA, search-hit and GenBank files as DataFrames, and their writers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(id, header, seq, ordinal) of every record; repeated ids stay, blanks inside sequences go.

    Records are split by the line separator of the text source, so a large file is read
    in parallel. ordinal rises in the order of one file.
    """
    raw = spark.read.text(path, lineSep="\n>").withColumn("ordinal", F.monotonically_increasing_id())
    raw = raw.select("ordinal", F.regexp_replace("value", r"^>", "").alias("r")).where(F.trim("r") != "")
    header = F.btrim(F.substring_index("r", "\n", 1), F.lit(" \t\r"))
    seq = F.when(F.instr("r", "\n") > 0, F.regexp_replace(F.expr("substring(r, instr(r, '\n') + 1)"), r"\s+", "")).otherwise("")
    rows = raw.select(header.alias("header"), seq.alias("seq"), "ordinal")
    rows = rows.select(F.substring_index(F.regexp_replace("header", r"\s+", " "), " ", 1).alias("id"), "header", F.upper("seq").alias("seq") if upper else F.col("seq"), "ordinal")
    return rows.where("id <> ''")


def last_of_each(fasta: DataFrame) -> DataFrame:
    """The last record of each id."""
    return fasta.groupBy("id").agg(F.max_by(F.struct("header", "seq"), "ordinal").alias("r")).select("id", "r.header", "r.seq")


def write_fasta(df: DataFrame, row_id: str, seq: str, path: str, mode: str = "overwrite") -> None:
    df.where(F.col(row_id).isNotNull() & F.col(seq).isNotNull()).select(F.concat(F.lit(">"), F.col(row_id), F.lit("\n"), F.col(seq)).alias("value")).write.mode(mode).text(path)


def read_domain_hits(spark: SparkSession, path: str) -> DataFrame:
    """Per-domain hits of a profile search: target, tlen, query, qlen, score, hmm_from, hmm_to, ordinal.

    Fields are parted by blanks; comments, blank lines and lines under 22 fields are skipped.
    """
    rows = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = rows.select("ordinal", F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 22)
    at = lambda i, kind: F.col("f")[i].try_cast(kind)
    return f.select(F.col("f")[0].alias("target"), at(2, "int").alias("tlen"), F.col("f")[3].alias("query"), at(5, "int").alias("qlen"), at(13, "double").alias("score"), at(15, "int").alias("hmm_from"), at(16, "int").alias("hmm_to"), "ordinal")


def read_genbank_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of each record; a last one without its end mark counts if it isn't blank."""
    raw = spark.read.text(path, lineSep="\n//\n").select(F.regexp_replace("value", r"\n?//\s*$", "").alias("record"))
    return raw.where(F.trim(F.regexp_replace("record", r"\s+", " ")) != "")


_FEATURE = re.compile(r"^     (\S+)\s+(\S.*)$")
_QUALIFIER = re.compile(r'^\s+/(\w+)="?([^"]*)"?')


def _parse(record: str, strict: bool = False) -> tuple[str | None, str | None, list[tuple[str | None, int, int, str]], str]:
    """Version, organism, coding features (id, low, high, strand) and sequence of a record."""
    version = organism = None
    features: list[list] = []
    where, seq = "", []
    for line in record.split("\n"):
        if line[:1].strip():
            where = line.split(None, 1)[0]
            rest = line[len(where) :].strip()
            if where == "VERSION":
                version = rest.split()[0] if rest else None
            continue
        if where == "ORIGIN":
            seq.append("".join(filter(str.isalpha, line)))
        elif line.strip().startswith("ORGANISM"):
            organism = line.strip()[8:].strip()
        elif where == "FEATURES":
            if (m := _FEATURE.match(line)) is not None:
                features.append([m[1], m[2], {}])
            elif features and (q := _QUALIFIER.match(line)) is not None:
                features[-1][2].setdefault(q[1], q[2])
            elif features and not features[-1][2]:
                features[-1][1] += line.strip()
    coding = []
    if strict and version is None:
        raise ValueError("a record without VERSION")
    for kind, place, said in features:
        if strict and kind == "CDS" and re.search(r"join|order", place):
            raise ValueError(f"{version}: a joined location, {place}")
        ends = [int(x) for x in re.findall(r"\d+", place)]
        if kind == "CDS" and ends:
            coding.append((said.get("protein_id") or said.get("locus_tag"), min(ends), max(ends), "-" if place.startswith("complement") else "+"))
    return version, organism, coding, "".join(seq).upper()


GENBANK_DDL = "version string, organism string, cds array<struct<id: string, low: int, high: int, strand: string>>, seq string"


def parse_genbank(records: DataFrame, strict: bool = False) -> DataFrame:
    """version, organism, cds (1-based, both ends inside) and seq of each record.

    A coding feature spans all positions that its location names; it is on `-` if the
    location begins with complement. strict fails on joined locations and on records
    without a version.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, o, [dict(zip(("id", "low", "high", "strand"), c)) for c in cds], s) for v, o, cds, s in (_parse(r, strict) for r in pdf.record)]
            yield pd.DataFrame(rows, columns=["version", "organism", "cds", "seq"])

    return records.select("record").mapInPandas(work, GENBANK_DDL)


def wanted_records(records: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Records that name a wanted protein, found before anything is parsed; ids are cut at `|`."""
    wanted = ids.select(F.substring_index(row_id, "|", 1).alias("id")).distinct()
    keyed = records.withColumn("rid", F.xxhash64("record"))
    named = keyed.select("rid", F.explode(F.expr(r"""regexp_extract_all(record, '/protein_id="([^"]+)"', 1)""")).alias("id"))
    return keyed.join(named.join(wanted, "id", "left_semi").select("rid").distinct(), "rid", "left_semi").drop("rid")


def gtf_lines(parsed: DataFrame) -> DataFrame:
    """One GTF line (value) for each coding feature; ids must be unique within a record, else the job fails."""
    cds = parsed.select("version", F.posexplode("cds").alias("i", "c")).select("version", F.coalesce("c.id", F.concat(F.lit("cds"), F.col("i").cast("string"))).alias("id"), "c.low", "c.high", "c.strand")
    counted = cds.groupBy("version", "id").agg(F.count("*").alias("n"), F.first(F.struct("low", "high", "strand")).alias("c"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate feature "), F.col("id")))).otherwise(F.col("id"))
    line = F.format_string('%s\tgenbank\tCDS\t%d\t%d\t.\t%s\t0\tgene_id "%s"; transcript_id "%s";', F.col("version"), F.col("c.low"), F.col("c.high"), F.col("c.strand"), checked, F.col("id"))
    return counted.select(line.alias("value"))
