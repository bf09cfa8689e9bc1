"""Run artefacts: partitioned sinks, raw answer files and the integrity manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw answer file layout.
ANSWER_PATH = r"raw/([^/]+)/(batch-\d+)(\.repair)?\.txt$"


def write_artefact(df: DataFrame, path: str, run: str) -> None:
    """Write one run's partition of an artefact; other runs in the folder are left alone."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_artefact(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run") == run).drop("run")


def read_answer_files(spark: SparkSession, root: str) -> DataFrame:
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return answer_files(text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def answer_files(raw: DataFrame) -> DataFrame:
    """``raw(path, body)`` to one row per model and batch with the original and the repair text."""
    # no path: no model, and so no file
    part = lambda i: F.coalesce(F.regexp_extract("path", ANSWER_PATH, i), F.lit(""))
    parts = raw.select(part(1).alias("model"), part(2).alias("batch_id"), (part(3) != "").alias("is_repair"), "body").filter(F.col("model") != "")
    # a batch has two files at most: nothing to combine before they meet, so they are sorted once and not twice
    parts = parts.repartition("model", "batch_id")
    return parts.groupBy("model", "batch_id").agg(
        F.max(F.when(~F.col("is_repair"), F.col("body"))).alias("original"), F.max(F.when(F.col("is_repair"), F.col("body"))).alias("repair")
    )


def complete_batches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Add expected batches without any file (both texts NULL)."""
    return expected.select("model", "batch_id").distinct().join(files, ["model", "batch_id"], "left")


def read_binary_files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.col("path").alias("name"), "content")


def build_manifest(files: DataFrame) -> DataFrame:
    """``files(name, content)`` -> (name, sha256)."""
    return files.select("name", F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Every name on either side with ``ok`` / ``hash_mismatch`` / ``missing`` / ``not_in_manifest``."""
    want = manifest.select("name", F.col("sha256").alias("expected"))
    got = current.select("name", F.col("sha256").alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), F.lit("missing"))
        .when(F.col("expected").isNull(), F.lit("not_in_manifest"))
        .when(F.col("expected") != F.col("actual"), F.lit("hash_mismatch"))
        .otherwise(F.lit("ok"))
    )
    return want.join(got, "name", "full_outer").select("name", "expected", "actual", status.alias("status"))
