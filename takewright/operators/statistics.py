"""Grouped statistics with the library's own definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import amplitude_to_dbfs, finite, js_round


def percentile(df: DataFrame, key: str, value: str, part: float) -> DataFrame:
    """The value at place floor(n * part) of the sorted ones, to one place."""
    order = Window.partitionBy(key).orderBy(value)
    x = df.select(key, value, F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * part)) + 1
    return x.where(F.col("r") == at).select(key, js_round(value, 1).alias("value"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half of all."""
    w = Window.partitionBy(*keys)
    running = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    x = df.select(*keys, F.col(value).alias("v"), running.alias("run"), F.sum(weight).over(w).alias("all"))
    return x.where(F.col("run") >= F.col("all") / 2).groupBy(*keys).agg(F.min("v").alias("value"))


def longest_run(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The longest run of equal non-empty values."""
    by_key, by_value = Window.partitionBy(key).orderBy(order), Window.partitionBy(key, value).orderBy(order)
    x = df.withColumn("island", F.row_number().over(by_key) - F.row_number().over(by_value)).where(F.col(value) != "")
    return x.groupBy(key, value, "island").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def first_mode(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value; of equals the one seen first."""
    x = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return x.groupBy(key).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias("mode"))


def deviation(x: Column) -> Column:
    """Population standard deviation, 0 for fewer than two values."""
    return F.when(F.count(x) < 2, F.lit(0.0)).otherwise(F.stddev_pop(x))


def average_finite(x: Column) -> Column:
    return F.avg(finite(x))


def maximum_finite(x: Column) -> Column:
    return F.max(finite(x))


def ambient_profile(x: Column) -> list[Column]:
    """Level of the root mean square and of the highest of finite levels at or above 0, in dBFS; null of none."""
    good = F.when(finite(x) >= 0, x)
    return [amplitude_to_dbfs(F.sqrt(F.avg(good * good))).alias("rms_dbfs"), amplitude_to_dbfs(F.max(good)).alias("peak_dbfs")]


def duplicate_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Keys with more than one row: count and ordered members."""
    x = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    return x.where("n > 1")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return df.join(rows.select(key), key, "left_anti").unionByName(rows)


def divide(required: DataFrame, have: DataFrame, group: str, item: str) -> DataFrame:
    """Groups of ``required`` whose every item is among ``have``."""
    marked = required.join(have.select(item, F.lit(True).alias("_has")).distinct(), item, "left")
    return marked.groupBy(group).agg(F.bool_and(F.coalesce("_has", F.lit(False))).alias("_all")).where("_all").select(group)
