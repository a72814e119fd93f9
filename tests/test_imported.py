"""The consensus of imported alignments against that of rows of sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from takewright.operators import alignment as A
from takewright.operators import imports
from takewright.plans import catalog

SF = "/root/testdata/sf0.001"


def alignment(late: int, confidence: float, words: list[str]) -> dict:
    told = [{"word": w, "startMs": k * 500 + late * (k % 3), "endMs": k * 500 + 200 + late, "confidence": 0.9} for k, w in enumerate(words)]
    return {"durationMs": 99_000, "aligner": "tool", "language": "fr", "confidence": confidence, "words": told, "phonemes": [{"phoneme": "a", "startMs": 0, "endMs": 10, "confidence": 0.5, "wordIndex": 0}]}


def test_imported_sources_are_those_of_rows(spark):
    given = {1: [(0, 0.8)], 2: [(0, 0.8), (40, 0.6)], 3: [(30, 0.5), (0, 0.25), (90, 0.25)], 4: [(10, 0.3), (20, 0.3), (0, 0.3), (70, 1.0)]}
    payloads = [(k, json.dumps({"alignments": [alignment(late, c, ["Un", "deux", "trois", "été"]) for late, c in v]})) for k, v in given.items()]
    found, wrong = imports.import_alignments(spark.createDataFrame([*payloads, (5, "{}")], "k long, payload string"), "k")
    rows = [(k, str(n), "acoustic", c, i, w["word"], w["startMs"], w["endMs"]) for k, v in given.items() for n, (late, c) in enumerate(v) for i, w in enumerate(alignment(late, c, ["Un", "deux", "trois", "été"])["words"])]
    wanted = A.timing_consensus(spark.createDataFrame(rows, "take_id long, source string, kind string, confidence double, idx int, word string, start_ms long, end_ms long"))
    assert found.columns == wanted.columns and [r.k for r in wrong.collect()] == [5]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and found.count() == 16


def test_imported_words_are_neither_dealt_again_nor_grouped(spark):
    plan = catalog.QUERIES["f13_imported_consensus"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "keys=[take_id" not in plan
