"""JSON logs and folders of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "role string, task_id string, duration_s double, input_tokens_uncached bigint, output_tokens bigint, cache_write_tokens bigint, transcript_path string, over_budget boolean"
TASK = "task_id string, stage string, origin string, status string, parent string, revisions int, gate_failures int, label string, extra map<string, string>"
RESULTS = "recorded_at string, model string, level string, attempt int, status string, score int, asserted map<string, boolean>"


def read_json_log(spark: SparkSession, path: str, schema: str, malformed: str = "FAILFAST") -> DataFrame:
    """One row a JSON line; a path that matches nothing gives an empty table; malformed is FAILFAST or DROPMALFORMED."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], schema)
    return spark.read.json(path, schema=schema, mode=malformed)


def read_task_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each */meta.json under the folder, with its path."""
    return spark.read.json(f"{folder}/*/meta.json", schema=TASK, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all files under the folder, at any depth; undecodable bytes become the replacement character."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def append_json_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
