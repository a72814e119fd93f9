"""Folds, merges and strict readers against plain Python on small tables with ties, nulls and defects."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from takewright.operators import imports, intervals, progress, review
from takewright.streaming import live


def test_overlap_of_overlapping_segments(spark):
    rng = random.Random(1)
    words = [(m, i, s, s + rng.randint(0, 90)) for m in range(4) for i, s in enumerate(sorted(rng.randint(0, 900) for _ in range(25)))]
    segments = [(m, s, s + rng.randint(1, 120)) for m in range(3) for s in (rng.randint(0, 900) for _ in range(15))]
    found = intervals.overlap_ms(spark.createDataFrame(words, "media_id long, idx long, start_ms long, end_ms long"), spark.createDataFrame(segments, "media_id long, start_ms long, end_ms long"))
    got = {(r.media_id, r.idx): r.overlap_ms for r in found.collect()}
    assert got == {(m, i): sum(max(0, min(e, b) - max(s, a)) for k, a, b in segments if k == m) for m, i, s, e in words}


def brute_hysteresis(p: list[float | None], frame=32, enter=0.5, stay=0.35, silence=300, least=200, pad=30) -> list[tuple[int, int]]:
    out, start, quiet = [], None, None
    for i, v in enumerate(p):
        v = -1 if v is None else v
        if start is None:
            start = i if v >= enter else None
        elif v >= stay:
            quiet = None
        else:
            quiet = i if quiet is None else quiet
            if (i - quiet + 1) * frame >= silence:
                out.append((start, quiet))
                start = quiet = None
    if start is not None:
        out.append((start, len(p)))
    return [(max(0, s * frame - pad), min(len(p) * frame, e * frame + pad)) for s, e in out if (e - s) * frame >= least]


def test_hysteresis_equals_brute_force(spark):
    rng = random.Random(2)
    media = {m: [rng.choice([0.1, 0.4, 0.6, 0.9, None]) if rng.random() < 0.3 else 0.9 * ((i // 15 + m) % 2) for i in range(rng.randint(1, 150))] for m in range(12)}
    frames = spark.createDataFrame([(m, i, p) for m, ps in media.items() for i, p in enumerate(ps)], "media_id long, idx long, p double").repartition(5)
    found: dict = {m: [] for m in media}
    for r in intervals.hysteresis(frames).orderBy("media_id", "start_ms").collect():
        found[r.media_id].append((r.start_ms, r.end_ms))
    assert found == {m: brute_hysteresis(p) for m, p in media.items()}
    assert intervals.hysteresis(frames.limit(0)).count() == 0


def test_accepted_chunks(spark):
    rows = [(1, 0, 0.0, 0.5), (1, 1, 0.4, 0.3), (1, 2, 0.2, 0.9), (1, 3, None, 2.0), (1, 4, 0.95, 9.0), (2, 0, 0.1, 0.1)]
    found = intervals.accepted_chunks(spark.createDataFrame(rows, "media_id long, idx long, start_s double, end_s double"), total_ms=1000).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 500), (1, 2, 500, 900), (1, 4, 950, 1000)]


def test_hypotheses_keep_first_times_and_rows_below_the_offset():
    s = live.Hypotheses.step({}, 0, [(True, [("one", 0.5), (" ", 0.1)]), (False, [("two", -1)])], 1)
    assert s == {"0:0": {"text": "one", "confidence": 0.5, "final": True, "at": 1}, "1:0": {"text": "two", "confidence": None, "final": False, "at": 1}}
    s = live.Hypotheses.step(s, 0, [(True, [(" one ", 0.6)]), (True, [("two", float("nan"))])], 2)
    assert (s["0:0"]["at"], s["1:0"]["at"], s["1:0"]["confidence"]) == (1, 2, None)
    s = live.Hypotheses.step(s, 2, [(True, [("three", 1.0)])], 3)
    assert sorted(s) == ["0:0", "1:0", "2:0"]
    assert sorted(live.Hypotheses.step(s, 1, [], 4)) == ["0:0"]


def test_sessions_commit_without_the_shared_words():
    s = live.Session.start()
    s = live.Session.step(s, "good morning all", "good morning", False)
    assert live.Session.texts(s) == ("good morning all", "good morning")
    s = live.Session.step(s, "", "good morning all", True)
    s = live.Session.step(s, "morning all of you", "morning all of", False)
    assert live.Session.texts(s) == ("good morning all of you", "good morning all of")


def test_hypotheses_as_a_stream_end_as_in_a_batch(spark, tmp_path):
    rng = random.Random(3)
    kind = "user_id long, event_id long, offset int, results array<struct<final:boolean,alternatives:array<struct<transcript:string,confidence:double>>>>"
    rows = [(e % 2, e, e // 6, [(rng.random() < 0.5, [(rng.choice(["a", "b", " "]), 0.5)]) for _ in range(rng.randint(0, 3))]) for e in range(24)]
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = sorted(map(tuple, live.hypotheses(spark.createDataFrame(rows, kind)).collect()), key=str)
    stream = live.hypotheses(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), stream=True)
    asked = stream.writeStream.format("memory").queryName("hypotheses").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    asked.awaitTermination(120)
    told = {tuple(r) for r in spark.table("hypotheses").collect()}
    assert set(batch) <= told


def test_first_source_that_has_words(spark):
    kind = "media_id long, idx long, word string, start_ms long, end_ms long"
    a, b = spark.createDataFrame([(1, 0, "x", 0, 5)], kind), spark.createDataFrame([(1, 0, "y", 1, 6), (1, 1, "z", 6, 9), (2, 0, "w", 0, 3)], kind)
    assert sorted(map(tuple, review.best_source([a, b]).collect())) == [(1, 0, "x", 0, 5, 0), (2, 0, "w", 0, 3, 1)]


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None), ({"durationMs": 0}, "durationMs"), ({"durationMs": "10"}, "durationMs"), ({"aligner": " "}, "aligner"), ({"language": None}, "language"), ({"confidence": 1.1}, "confidence"), ({"words": []}, "empty"), ({"phonemes": []}, "empty"),
        ({"words": [{"word": "a", "startMs": 5, "endMs": 5, "confidence": 1}]}, "words"), ({"words": [{"word": "a", "startMs": 0.5, "endMs": 5, "confidence": 1}]}, "words"), ({"words": [{"word": "a", "startMs": 0, "endMs": 500, "confidence": 1}]}, "words"),
        ({"words": [{"word": "a", "startMs": 0, "endMs": 9, "confidence": 1}, {"word": "b", "startMs": 8, "endMs": 12, "confidence": 1}]}, "order"), ({"phonemes": [{"phoneme": "a", "startMs": 0, "endMs": 9, "confidence": 1, "wordIndex": -1}]}, "phonemes"),
    ],
)
def test_strict_alignments(spark, change, error):
    whole = {"durationMs": 100, "aligner": "t", "language": "fr", "confidence": 0.5, "words": [{"word": "à", "startMs": 0, "endMs": 9, "confidence": 1}], "phonemes": [{"phoneme": "a", "startMs": 0, "endMs": 9, "confidence": 1, "wordIndex": 0}]}
    df = spark.createDataFrame([(json.dumps(whole | change),)], "payload string")
    row = df.select(imports.read_alignment(F.col("payload")).alias("r")).select("r.error", imports.matches_transcript(F.col("r.alignment"), F.lit("A!")).alias("m")).first()
    assert row.error == error
    if not change:
        assert row.m
    assert spark.createDataFrame([("[1]",), ("{",)], "payload string").select(imports.read_alignment(F.col("payload"))["error"].alias("e")).distinct().collect()[0].e == "object"


def test_progress_of_other_corpora_stays(spark):
    kind = "corpus_id string, speaker_id string, language string, version string, prompts array<bigint>, scenarios array<bigint>"
    old = spark.createDataFrame([("a", "s", "fr", "1", [1], [9]), ("b", "s", "fr", "1", [7], [3]), ("a", " ", "fr", "1", [2], [])], kind)
    takes = spark.createDataFrame([("a", "s", "fr", 2, "keeper"), ("a", "s", "fr", 3, "maybe"), ("a", "t", "fr", 1, "reject"), ("b", "s", "fr", 8, "keeper")], "corpus_id string, speaker_id string, language string, prompt_id long, rating string")
    scenarios = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "scenario_id long, prompt_id long")
    found = sorted(map(tuple, progress.reconcile(old, takes, scenarios, "a", "2").collect()))
    assert found == [("a", "s", "fr", "2", [1, 2], [1]), ("a", "t", "fr", "2", [], []), ("b", "s", "fr", "1", [7], [3])]


def test_a_consensus_of_timings_deals_rows_once(spark):
    from takewright.operators.alignment import timing_consensus

    rows = [("a", "m", "acoustic", 0.9, 0, "x", 10, 20), ("a", "w", "local_acoustic", 0.8, 0, "x", 60, 90), ("a", "g", "estimated", 0.7, 0, "x", 0, 5), ("a", "g", "estimated", 0.7, 1, "y", 7, 7), ("b", "g", "estimated", 0.7, 0, "x", 1, 2)]
    x = timing_consensus(spark.createDataFrame(rows, "take_id string, source string, kind string, confidence double, idx int, word string, start_ms long, end_ms long"))
    found = sorted(tuple(r) for r in x.select("take_id", "idx", "start_ms", "end_ms", "word", "agreement_ms", "status", "take_confidence").collect())
    assert found == [("a", 0, 10, 20, "x", 70, "acceptable", 0.76), ("a", 1, 7, 8, None, 70, "acceptable", 0.76)]
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
