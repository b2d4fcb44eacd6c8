"""Tab-delimited tables: with a header and strict width, or positional with comments and short rows skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; a row of another width fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def positional_table(spark: SparkSession, path: str, columns: dict[str, str], least: int | None = None) -> DataFrame:
    """Columns by position, cast to the given types; `#` lines, blank lines and rows with fewer than least fields are skipped.

    `-` and empty fields are null in columns that aren't strings.
    """
    fields = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(fields.alias("f")).where(F.size("f") >= (least or len(columns)))

    def read(i: int, kind: str):
        raw = F.get("f", i)
        return raw if kind == "string" else F.when(~F.trim(raw).isin("", "-"), F.trim(raw)).try_cast(kind)

    return rows.select(*[read(i, kind).alias(name) for i, (name, kind) in enumerate(columns.items())])


TIER1 = {"target_id": "string", "profile": "string", "rt_class": "string", "bitscore": "double"}
TIER2 = {"target_id": "string", "label": "string", "bitscore": "double", "coverage": "double", "seq_identity": "double"}
ANCHORS = {"rt_id": "string", "rt_class": "string", "clade": "string", "kind": "string"}
NEIGHBOUR_GENES = {"gene_id": "string", "locus_id": "string", "family": "string", "rt_clade": "string", "rt_class": "string", "cluster_id_90": "string", "biosample": "string", "rt_adjacent": "int", "same_strand_as_rt": "int", "distance_to_adjacent_bp": "int"}
CLUSTERS = {"representative": "string", "member": "string"}
CONTIG_LENGTHS = {"protein_id": "string", "length": "int"}


def neighbour_lists(spark: SparkSession, path: str) -> DataFrame:
    """(target, rank, label) from rows `target, class[, class ...]`: repeated targets go on, nearest first.

    Ranks follow the line's place in one file and the label's place in the line.
    """
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("line", F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    flat = rows.select(F.get("f", 0).alias("target"), "line", F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("at", "label"))
    return flat.select("target", F.struct("line", "at").alias("rank"), "label")


def clade_totals(spark: SparkSession, path: str) -> DataFrame:
    """(rt_clade, loci_total): of repeated clades the last row of the file counts; rows whose total is no whole number fail the read."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    fields = rows.select("line", F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    last = fields.groupBy(F.get("f", 0).alias("rt_clade")).agg(F.max_by(F.get("f", 1), "line").alias("n"))
    return last.select("rt_clade", F.trim("n").cast("bigint").alias("loci_total"))


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """(feature, length, library_no, fragments) in long form from a featureCounts table: `#` lines and the header row skipped."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where((F.size("f") >= 7) & (F.get("f", 0) != "Geneid"))
    return rows.select(F.get("f", 0).alias("feature"), F.get("f", 5).try_cast("int").alias("length"), F.posexplode(F.slice("f", F.lit(7), F.size("f"))).alias("library_no", "n")).select("feature", "length", "library_no", F.col("n").try_cast("bigint").alias("fragments"))


def identifiers(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Distinct non-blank lines, trimmed; with a pattern only those that match it wholly."""
    rows = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()
    return rows.where(F.col("id").rlike(f"^(?:{pattern})$")) if pattern else rows


def write_table(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=header, nullValue="-", emptyValue="")
