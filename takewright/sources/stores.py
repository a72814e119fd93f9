"""A store of named contents in versions: restores are all or nothing, and never change what a name stands for.

A store is a package (``sources.packages``): each version is complete before the pointer turns to it, so that a reader sees the one before or the one after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packages


def exists(spark: SparkSession, root: str) -> bool:
    try:
        spark.read.text(f"{root}/CURRENT").limit(1).collect()
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return False
        raise
    return True


def names(spark: SparkSession, root: str) -> DataFrame:
    """path, byte_size and sha256 of what the store holds; nothing where there is no store yet."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, byte_size long, sha256 string")
    return packages.manifest(spark, root).where("not missing").select("path", "byte_size", "sha256")


def conflicts(spark: SparkSession, root: str, incoming: DataFrame) -> DataFrame:
    """(path, held, given): names that the store has for another content, or that ``incoming`` (path, content) gives for two."""
    given = incoming.select("path", F.sha2("content", 256).alias("sha256")).groupBy("path").agg(F.min("sha256").alias("given"), F.max("sha256").alias("other"))
    x = given.join(names(spark, root).select("path", F.col("sha256").alias("held")), "path", "left")
    return x.where((F.col("held") != F.col("given")) | (F.col("given") != F.col("other"))).select("path", F.coalesce("held", "other").alias("held"), "given")


class Conflict(ValueError):
    """A name stands for something else already; nothing was restored."""


def restore(spark: SparkSession, root: str, incoming: DataFrame, layout: str = "archives") -> None:
    """Add ``incoming`` (path, content) to the store: all of it, or where a name is taken by another content, or the write fails, nothing.

    What is there already, alike, stays once.  Of two restores at a time each makes a whole version, and the one that ends last is the store.
    """
    clash = conflicts(spark, root, incoming).orderBy("path").limit(5).collect()
    if clash:
        raise Conflict("names are taken: " + ", ".join(r["path"] for r in clash))
    new = incoming.groupBy("path").agg(F.any_value("content").alias("content"))
    if exists(spark, root):
        new = new.join(names(spark, root).select("path"), "path", "left_anti").unionByName(packages.held(spark, root).select("path", "content"))
    packages.save(new, root, layout)


def first_of(name: DataFrame, *tiers: DataFrame, key: str = "path") -> DataFrame:
    """The content of each name from the first of ``tiers`` (``key``, content) that has it, with the tier's number (from 0), and whether it should be promoted to the first.

    Each tier is asked for those names alone that no tier before it has.
    """
    left, found = name.select(key).distinct(), None
    for i, tier in enumerate(tiers):
        here = left.join(tier.select(key, "content"), key).withColumn("tier", F.lit(i)).withColumn("promote", F.lit(i > 0))
        found = here if found is None else found.unionByName(here)
        left = left.join(tier.select(key), key, "left_anti")
    return found
