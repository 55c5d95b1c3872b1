"""Sinks: JSON lines, kept and rejected rows, manifests, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> int:
    """Replaces ``path`` when the job commits; the number of rows comes from the files that were written."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def split_rows(df: DataFrame, reason: Column, kept: str, rejected: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reason, written once at ``at`` and read back as two tables.

    The rows are evaluated a single time; ``kept`` and ``rejected`` name the folders.
    """
    df.withColumn("reason", reason).withColumn("_side", F.when(F.col("reason").isNull(), kept).otherwise(rejected)).write.mode("overwrite").partitionBy("_side").parquet(at)
    back = df.sparkSession.read.schema(df.withColumn("reason", reason).withColumn("_side", F.lit("")).schema).parquet(at)
    return back.where(F.col("_side") == kept).drop("_side", "reason"), back.where(F.col("_side") == rejected).drop("_side")


def report(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, and how many meet each condition."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in counters.items()])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, sha256)`` of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)
