"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b of one orderable type); label: the component's smallest node.

    Each round links the larger neighbours of every node to its smallest one, then the smaller ones; stars remain when nothing
    changes.  Only aggregates and equi-joins on nodes: a node of any degree is split like any skewed key.
    """
    edges = common.stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        large = common.stash(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = common.stash(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("label")))
