"""Adaptive analyses, what devices tell, live folds as batches and streams, local corpora, anchors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewright.operators import adaptive, capture, corpus
from takewright.operators.intervals import increasing_anchors
from takewright.streaming import live

TAKES = "take_id long, kind string, snr double, reverb double, active double, duration_ms long, factor double"
READINGS = "reading string, take_id long, words long, expected long, matched long, supported double, speech_ms long, segments long, alignment string, run long, elapsed_ms double"


def reading(name: str, take: int, words: int, matched: int, **more) -> tuple:
    row = {"expected": 10, "supported": 1.0, "speech_ms": 10_000, "segments": 2, "alignment": "strong", "run": 1, "elapsed_ms": 1000.0} | more
    return (name, take, words, row["expected"], matched, row["supported"], row["speech_ms"], row["segments"], row["alignment"], row["run"], row["elapsed_ms"])


def test_takes_are_read_again_only_where_it_is_asked_for(spark):
    takes = [
        (1, "spoken", 30.0, 0.1, 0.5, 20_000, None),  # clean and matched
        (2, "spoken", 30.0, 0.1, 0.5, 20_000, None),  # clean, badly matched
        (3, "sung", 30.0, 0.1, 0.5, 20_000, None),  # all readings
        (4, "spoken", 20.0, 0.1, 0.5, 20_000, None),  # uncertain, not noisy: no separation
        (5, "spoken", 10.0, 0.1, 0.5, 400_000, None),  # too long for the voice's band
        (6, "sung", 30.0, 0.1, 0.5, 20_000, None),  # slow: two readings of the budget
        (7, "spoken", 10.0, 0.1, 0.5, 20_000, None),  # silence is believed
        (8, "spoken", 15.0, 0.1, 0.5, 20_000, 0.9),  # measured now, so that the stored factor does not count
    ]
    best = {1: "tiny", 2: "base", 3: "separated", 4: "focus", 5: "base", 6: "tiny", 7: "focus", 8: "separated"}
    rows = [reading(n, t, 10, 10 if n == best[t] else 5, segments=0 if t == 7 else 2, elapsed_ms=19_000.0 if t == 6 else 1000.0) for t in best for n in adaptive.READINGS]
    rows = [r if r[:2] != ("tiny", 1) else reading("tiny", 1, 10, 10) for r in rows]
    table = spark.createDataFrame(rows, READINGS)
    asked: dict[str, list[int]] = {}

    def read(name, keys):
        asked[name] = sorted(r["take_id"] for r in keys.collect())
        return adaptive.from_table(table)(name, keys)

    found = {r["take_id"]: r for r in adaptive.analyze(spark.createDataFrame(takes, TAKES), read).collect()}
    assert asked == {"tiny": [1, 2, 3, 4, 5, 6, 7, 8], "base": [2, 3, 4, 5, 6, 8], "focus": [3, 4, 6, 7, 8], "separated": [3, 7, 8]}
    assert {t: r["reading"] for t, r in found.items()} == best
    assert [found[t]["depth"] for t in range(1, 9)] == ["fast", "verified", "deep", "verified", "verified", "verified", "deep", "deep"]
    assert [found[t]["budget"] for t in (1, 3, 5, 6, 8)] == [1, 3, 2, 2, 3]
    assert found[1]["reason"] == "fast_path_sufficient" and found[1]["score"] == 1.0 and found[2]["reason"] == "prompt_match"
    assert found[3]["readings"] == "tiny,base,focus,separated"


def test_equal_scores_go_to_the_earlier_reading(spark):
    rows = [reading(n, 1, 10, 5, alignment="review", expected=0, supported=0.5) for n in adaptive.READINGS]
    found = adaptive.analyze(spark.createDataFrame([(1, "sung", 5.0, 0.1, 0.5, 1000, None)], TAKES), adaptive.from_table(spark.createDataFrame(rows, READINGS))).first()
    assert (found["reading"], found["reason"]) == ("base", "acoustic_support")
    assert adaptive.analyze(spark.createDataFrame([], TAKES), adaptive.from_table(spark.createDataFrame(rows, READINGS))).count() == 0


@pytest.mark.parametrize(("text", "run"), [("", 0), ("one", 1), ("no no No yes no", 3), ("a b a b", 1), ("x  y y\ty y", 4)])
def test_repeated_runs(spark, text, run):
    assert spark.createDataFrame([(text,)], "t string").select(adaptive.repeated_run(F.col("t"))).first()[0] == run


def test_the_acoustic_field(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 256, n).tolist(), rate, fft) for n, rate, fft in ((1024, 48_000, 2048), (64, 16_000, 128), (8, 8000, 16), (1024, 0, 2048), (0, 48_000, 2048), (64, 48_000, 0))]
    for (s, rate, fft), r in zip(rows, spark.createDataFrame(rows, "s array<long>, rate long, fft long").select(capture.acoustic_field(F.col("s"), F.col("rate"), F.col("fft")).alias("f")).collect(), strict=True):
        for name, (low, high) in capture.BANDS.items():
            want = 0.0
            if s and rate and fft:
                hz = rate / fft
                some = s[max(0, math.ceil(low / hz)) : min(len(s), math.floor(high / hz) + 1)]
                want = min(1.0, (np.mean(some) / 255) ** 0.7) if len(some) else 0.0
            assert r["f"][name] == pytest.approx(want, abs=1e-12)


def test_levels_and_settings(spark):
    rows = [([0.0] * 10,), ([1.0] * 10,), ([0.1, -0.1] * 5,), ([float("nan"), 0.001],), ([],), ([0.0] * 99 + [0.9],)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>").select(capture.level(F.col("x"))).collect()]
    for (x,), v in zip(rows, got, strict=True):
        x = np.nan_to_num(np.array(x, float))
        db = lambda y: 20 * math.log10(max(y, 1e-6))
        rms, peak = math.sqrt(float((x**2).sum()) / max(1, len(x))), float(np.abs(x).max(initial=0))
        assert v == pytest.approx(min(1, max(0, (db(rms) + 60) / 45, (db(peak) + 36) / 36 * 0.78)))
    told = spark.createDataFrame([('{"echoCancellation":true,"noiseSuppression":"true","voiceIsolation":0,"channelCount":"2","sampleRate":44100,"groupId":" ","deviceId":"d"}', " "), (None, "mic"), ("nonsense", None)], "s string, label string")
    a, b, c = (r["p"] for r in told.select(capture.capture_provenance(F.col("s"), F.col("label"), F.lit(48_000)).alias("p")).collect())
    assert a["processing"]["echoCancellation"] is True and a["processing"]["voiceIsolation"] is None and (a["captured_hz"], a["group_id"], a["device_id"], a["label"], a["resampled"]) == (44_100.0, None, "d", None, False)
    assert b["label"] == "mic" and b["channels"] is None and c["processing"]["echoCancellation"] is None


def test_anchors_are_ordered_by_their_estimates_alone(spark):
    rows = [(1, 0, 100, 0), (1, 10, 90, 1), (1, 20, 95, 2), (1, 20, 5, 3), (2, 7, 7, 0), (2, 7, 7, 1)]
    got = increasing_anchors(spark.createDataFrame(rows, "media_id long, source_ms long, target_ms long, n long"), order="n")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 100, 0), (1, 10, 90, 1), (1, 20, 95, 2), (2, 7, 7, 0)]


@pytest.mark.parametrize(
    ("confirmed", "now", "active", "quiet", "expressive", "ready"),
    [(None, 9e9, False, 9e9, False, False), (0, 519, False, 9e9, False, False), (0, 520, False, 520, False, True), (0, 520, True, 520, False, False), (0, 900, False, 519, False, False), (0, 1550, True, 0, False, True), (0, 1550, True, 0, True, False), (0, 640, False, 640, True, True), (0, 1900, True, 0, True, True), (50, 10, False, 9e9, False, False)],
)
def test_endpoints_settle(confirmed, now, active, quiet, expressive, ready):
    assert live.endpoint_ready(confirmed, now, active, quiet, expressive) is ready


def streamed(spark, df, tmp_path, make, order: str, parts: int = 3):
    """Rows of ``make`` over ``df`` as a stream of ``parts`` micro-batches in order."""
    rows = df.orderBy(order).collect()
    for i in range(parts):
        some = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_paces_and_endpoints_as_streams(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, at = [], {u: 0.0 for u in range(3)}
    for i in range(240):
        u = i % 3
        at[u] += float(rng.choice([16, 17, 30, 45, 60, 300, 0]))
        rows.append((u, i, at[u], bool(rng.random() < 0.1), bool(rng.random() < 0.2), u == 1))
    df = spark.createDataFrame(rows, "user_id long, event_id long, at double, final boolean, active boolean, expressive boolean")
    for name, make in {"pace": live.frame_paces, "end": live.endpoints}.items():
        batch = sorted(tuple(r) for r in make(df).collect())
        stream = sorted(tuple(r) for r in streamed(spark, df, tmp_path / name, lambda s, make=make: make(s, stream=True), "event_id").collect())
        assert batch == stream and len(batch) == 240
    told = {(r["user_id"], r["event_id"]): (r["mean"], r["slow"]) for r in live.frame_paces(df).collect()}
    for u in range(3):
        mean, slow, last = 1000 / 60, False, None
        for _, i, t, *_ in (r for r in rows if r[0] == u):
            gap = t - last if last is not None else -1
            last = t
            if 0 < gap <= 250:
                mean += 0.12 * (gap - mean)
                slow = True if not slow and mean > 1000 / 36 else slow and not mean < 1000 / 50
            assert told[u, i] == (pytest.approx(mean), slow)
    assert {s for _, s in told.values()} == {True, False}


def fnv(text: str) -> str:
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, d = divmod(h, 36)
        out = digits[d] + out
    return out or "0"


def test_local_corpora(spark):
    long = " ".join(f"w{i}" for i in range(60)) + "."
    subtitles = "1\n00:00:01,000 --> 00:00:02,000\nHello there\n\n2\n00:00:03,000 --> 00:00:04,500\nGoodbye now\n"
    rows = [(1, long, "en", "a.txt"), (2, subtitles, "en", "film.srt"), (3, "One line.\nTwo lines.\nThree lines.", "fr", " "), (4, "", "en", "x"), (5, None, "en", "x"), (6, "One line.\nTwo lines.\nThree lines.", "fr", "same.txt")]
    prompts, summary = corpus.local_corpora(spark.createDataFrame(rows, "doc_id long, text string, language string, source_name string"), "doc_id", "voice")
    by = {}
    for r in sorted(prompts.collect(), key=lambda r: (r["doc_id"], r["prompt_id"])):
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(by) == [1, 2, 3, 6]
    assert " ".join(r["text"] for r in by[1]) == long and [r["prompt_id"][-4:] for r in by[1]] == [".001", ".002", ".003"]
    assert [(r["text"], r["start_ms"], r["end_ms"]) for r in by[2]] == [("Hello there", 1000, 2000), ("Goodbye now", 3000, 4500)]
    assert by[3][0]["corpus_id"] == by[6][0]["corpus_id"] == "corpus.local.voice." + fnv("voice:fr:One line.\nTwo lines.\nThree lines.")
    told = {r["doc_id"]: r for r in summary.collect()}
    assert {d: (r["prompts"], r["timed"], r["words"], r["source_name"]) for d, r in told.items()} == {1: (3, 0, 60, "a.txt"), 2: (2, 2, 4, "film.srt"), 3: (3, 0, 6, None), 6: (3, 0, 6, "same.txt")}
