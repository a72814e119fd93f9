"""The consensus of sources that time the same words against that of rows of sources."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from takewright.operators import alignment as A
from takewright.plans import catalog
from takewright.plans.base import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sources", [[("acoustic", 0.9, 0), ("local_acoustic", 0.8, 50), ("estimated", 0.7, -100)], [("acoustic", 0.5, 30)], [("estimated", 0.9, 700), ("acoustic", 0.3, -20), ("acoustic", 0.6, 400), ("local_acoustic", 1.0, 0)], [("estimated", 0.9, 0)]])
def test_late_sources_are_those_of_rows(spark, sources):
    texts = Tables(spark, SF).documents.where("doc_id < 12").select("doc_id", "text")
    texts = texts.union(spark.createDataFrame([(3, "given twice and longer than it was"), (5, "one"), (5, "two three")], "doc_id long, text string"))

    class Twice(Tables):
        documents = None

    t = Twice(spark, SF)
    t.documents = texts
    words = t.word_timings.withColumnRenamed("media_id", "take_id").drop("word").withColumn("word", F.lit("w"))
    rows = F.explode(F.array(*(F.struct(F.lit(str(i)).alias("source"), F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.lit(late).cast("long").alias("late")) for i, (k, c, late) in enumerate(sources))))
    x = words.select("take_id", "idx", "word", "start_ms", "end_ms", rows.alias("v")).select("take_id", "idx", "word", (F.col("start_ms") + F.col("v.late")).alias("start_ms"), (F.col("end_ms") + F.col("v.late")).alias("end_ms"), "v.source", "v.kind", "v.confidence")
    found, wanted = A.late_consensus(words, sources), A.timing_consensus(x)
    assert found.columns == wanted.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_words_are_dealt_once_and_not_once_for_each_source(spark):
    plan = catalog.QUERIES["k01_timing_consensus"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan
    assert plan.count("Generate") == 1  # the words of texts
