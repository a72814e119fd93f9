"""Packages of samples: artifacts, checksums, reconciliation and validation, each as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def artifacts(files: DataFrame) -> DataFrame:
    """path, type, byte_size, sha256 and schema version of files (path, content as binary or text)."""
    content = F.col("content").cast("binary")
    return files.select("path", X.artifact_type(F.col("path")).alias("type"), F.octet_length(content).cast("long").alias("byte_size"), F.sha2(content, 256).alias("sha256"), X.schema_version(F.col("path")).alias("schema_version"))


def checksum_lines(files: DataFrame) -> DataFrame:
    return files.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("line"))


def parse_checksums(lines: DataFrame) -> DataFrame:
    """sha256 and path of each line; a line of another form, or a path given twice, has an error."""
    x = lines.where("trim(line) <> ''").select(F.regexp_extract("line", "^([a-f0-9]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract("line", "^([a-f0-9]{64})  (.+)$", 2).alias("path"), "line")
    from pyspark.sql import Window

    twice = F.count("*").over(Window.partitionBy("path")) > 1
    return x.select("sha256", "path", F.when(F.col("path") == "", F.concat(F.lit("malformed: "), "line")).when(twice, F.concat(F.lit("duplicate: "), "path")).alias("error"))


def reconcile(manifest: DataFrame, held: DataFrame) -> DataFrame:
    """(path, error): manifested files that are missing, held ones that no manifest names, and differences of size or digest."""
    m = manifest.select("path", F.col("byte_size").alias("m_size"), F.col("sha256").alias("m_sha"), F.lit(True).alias("m"))
    h = held.select("path", F.col("byte_size").alias("h_size"), F.col("sha256").alias("h_sha"), F.lit(True).alias("h"))
    x = m.join(h, "path", "full")
    error = F.when(F.col("h").isNull(), "missing file").when(F.col("m").isNull(), "unmanifested file").when(F.col("m_size") != F.col("h_size"), "size differs").when(F.col("m_sha") != F.col("h_sha"), "sha256 differs")
    return x.select("path", error.alias("error")).where("error is not null")


def unsafe_paths(files: DataFrame) -> DataFrame:
    return files.where(~X.safe_relative_path(F.col("path"))).select("path", F.lit("unsafe path").alias("error"))


def duplicate_paths(files: DataFrame) -> DataFrame:
    return files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("duplicate path").alias("error"))


def dangling(samples: DataFrame, column: str, targets: DataFrame, target: str, message: str) -> DataFrame:
    """References of ``samples`` that no target has."""
    refs = samples.select(F.col(column).alias("path")).where("path is not null").distinct()
    return refs.join(targets.select(F.col(target).alias("path")), "path", "left_anti").select("path", F.lit(message).alias("error"))


def validate(manifest: DataFrame, held: DataFrame, required: list[str]) -> DataFrame:
    """All errors of a package; a valid one has none."""
    spark = manifest.sparkSession
    needed = spark.createDataFrame([(p,) for p in required], "path string")
    missing = needed.join(held, "path", "left_anti").select("path", F.lit("required file missing").alias("error"))
    return reconcile(manifest, held).unionByName(unsafe_paths(held)).unionByName(duplicate_paths(held)).unionByName(missing).distinct()


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("line"))
