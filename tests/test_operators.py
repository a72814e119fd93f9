"""Operators on small literal tables."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from takewright.operators import corpus, intervals, package, planning, rules
from takewright.operators import statistics as S
from takewright.sources import archives, workspaces
from takewright.streaming import live


def test_hysteresis(spark):
    pattern = "..ssssssssss....ssssssssss" + "." * 12 + "sss" + "." * 12
    rows = [(1, i, 0.9 if c == "s" else 0.05) for i, c in enumerate(pattern)]
    found = intervals.hysteresis(spark.createDataFrame(rows, "media_id long, idx int, p double")).collect()
    # a gap of four frames (128 ms) does not close, three frames (96 ms) are too short
    assert [(r.start_ms, r.end_ms) for r in found] == [(2 * 32 - 30, 26 * 32 + 30)]


def test_resolve_overlaps(spark):
    rows = [(1, 0, 0, 100), (1, 1, 80, 200), (1, 2, 200, 300)]
    found = intervals.resolve_overlaps(spark.createDataFrame(rows, "media_id long, idx long, start_ms long, end_ms long"))
    assert [tuple(r)[1:] for r in found.orderBy("idx").collect()] == [(0, 0, 90), (1, 90, 200), (2, 200, 300)]


def test_word_at_edges(spark):
    words = spark.createDataFrame([(1, 0, 100, 200), (1, 1, 300, 400)], "media_id long, idx long, start_ms long, end_ms long")
    times = spark.createDataFrame([(1, t) for t in (0, 100, 200, 250, 300, 999)], "media_id long, t long")
    assert [r.idx for r in intervals.word_at(words, times).orderBy("t").collect()] == [-1, 0, 0, 0, 1, 1]


SRT = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i> there\nyou\n\nstray\n\n00:00:03,000 --> 00:00:02,000\nlate &amp; odd\n"
VTT = "WEBVTT\n\nNOTE skip me\nreally\n\n00:01.000 --> 00:02.000\nHi\n"


def test_subtitles(spark):
    files = spark.createDataFrame([(1, SRT), (2, VTT)], "id long, text string")
    found = corpus.subtitle_cues(files, "id").orderBy("id", "cue").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.text) for r in found] == [(1, 1000, 2000, "Hello there you"), (1, None, None, "late & odd"), (2, 1000, 2000, "Hi")]


def test_speaker_labels(spark):
    lines = [(1, 0, "Anna: hello"), (1, 1, "anna: again"), (1, 2, "Note: once"), (1, 3, "BOB: loud"), (1, 4, "no label"), (1, 5, "12: number")]
    found = corpus.strip_speaker_labels(spark.createDataFrame(lines, "id long, ord int, text string"), "id").orderBy("ord").collect()
    assert [r.text for r in found] == ["hello", "again", "Note: once", "loud", "no label", "12: number"]


def test_packed_sentences(spark):
    text = "One two three. " * 9 + "Tail"
    found = corpus.pack_sentences(spark.createDataFrame([(1, text), (2, "")], "id long, text string"), "id").orderBy("id", "idx").collect()
    assert [len(r.text.split()) for r in found] == [24, 4]


def test_segments_choose_their_way(spark):
    scripts = [(1, "a b\nc d\ne f", "x.txt"), (2, SRT, "x.srt"), (3, "One. Two.", "x.txt"), (4, "w " * 60, "y.txt")]
    found = corpus.segments(spark.createDataFrame(scripts, "id long, text string, source_name string"), "id").groupBy("id").count().collect()
    assert dict(map(tuple, found)) == {1: 3, 2: 2, 3: 1, 4: 3}


def test_greedy_plan_prefers_what_is_missing(spark):
    prompts = [(1, i, i, intent, pace) for i, (intent, pace) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")])]
    p = spark.createDataFrame(prompts, "k long, prompt_id long, ord long, intent string, pace string")
    found = planning.greedy(p, p.where("prompt_id = 0"), "k", ["intent", "pace"], 3).orderBy("place").collect()
    assert [(r.prompt_id, r.gain) for r in found] == [(3, 66), (2, 42), (1, 24)]


def test_package_validation(spark):
    manifest = spark.createDataFrame([("a.json", 3, "x"), ("b.json", 3, "x")], "path string, byte_size long, sha256 string")
    held = spark.createDataFrame([("a.json", 4, "x"), ("../c", 1, "y")], "path string, byte_size long, sha256 string")
    errors = {(r.path, r.error) for r in package.validate(manifest, held, ["manifest.json"]).collect()}
    assert errors == {("a.json", "size differs"), ("b.json", "missing file"), ("../c", "unmanifested file"), ("../c", "unsafe path"), ("manifest.json", "required file missing")}
    lines = spark.createDataFrame([("a" * 64 + "  p",), ("b" * 64 + "  p",), ("junk",)], "line string")
    assert sorted(r.error.split(":")[0] for r in package.parse_checksums(lines).collect()) == ["duplicate", "duplicate", "malformed"]


def test_archives(spark, tmp_path):
    files = [("a/x.json", b"{}"), ("b.txt", b"hi")]
    content = archives.pack(files)
    (tmp_path / "x.zip").write_bytes(content)
    found = {r.path: bytes(r.content) for r in archives.read_archives(spark, str(tmp_path / "x.zip")).collect()}
    assert found == dict(files)
    broken = bytearray(content)
    broken[content.index(b"{}")] ^= 1
    assert archives.entries(bytes(broken))[0]["error"]
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 100)
    assert "unsupported" in archives.entries((tmp_path / "d.zip").read_bytes())[0]["error"]
    assert "unsafe" in archives.entries(archives.pack([("../x", b"")]))[0]["error"]


def test_insert_only(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert archives.insert_only(None, rows, "k").count() == 2
    with pytest.raises(Exception, match="key exists"):
        archives.insert_only(rows.where("k = 'a'"), rows, "k").collect()


def test_workspaces(spark):
    docs = ['{"id":" ","version":1,"settings":{"minutes":99.6,"distanceCm":1},"capturedSessions":[{"id":"s","takes":[{"id":"t","durationMs":-4,"media":{"sha256":"zz"}}]}],"consents":[{"speakerId":"p","status":"granted"},{"speakerId":"","status":"granted"}]}', "[]", "nonsense"]
    x = workspaces.normalize(spark.createDataFrame([(d,) for d in docs], "json string"))
    rows = x.collect()
    assert [(r.workspace_id, r.minutes, r.distance_cm) for r in rows] == [("workspace", 60, 5), ("workspace", 10, 15), ("workspace", 10, 15)]
    assert len(rows[0].consents) == 1
    take = workspaces.takes(x).first()
    assert (take.duration_ms, take.sha256, take.file_name, take.rating) == (0, None, "s__t.wav", "unreviewed")
    with pytest.raises(Exception, match="later version"):
        workspaces.normalize(spark.createDataFrame([('{"version":3}',)], "json string")).collect()


def test_rules(spark):
    x = spark.range(1)
    scene = lambda *a: x.select(rules.capture_scene(*map(F.lit, a))).first()[0]
    assert scene("sung", 10.0, 0.9, 0.0) == "sung_voice"
    assert scene("spoken", 17.0, 0.1, 0.5) == "constrained_voice"
    assert scene("spoken", 30.0, 0.1, 0.5) == "clean_voice"
    assert scene("uncertain", 30.0, 0.1, 0.5) == "uncertain"
    match = lambda a, b: x.select(rules.tokens_match(F.lit(a), F.lit(b))).first()[0]
    assert match("hello", "hallo")
    assert match("recording", "record")
    assert not match("cat", "dog")


def test_weighted_median_and_runs(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 1.0), (1, 30.0, 3.0)], "k long, v double, w double")
    assert S.weighted_median(df, ["k"], "v", "w").first().value == 30.0
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("aabbbca")], "k long, i long, w string")
    assert S.longest_run(words, "k", "i", "w").first().longest == 3
    assert S.percentile(spark.createDataFrame([(1, float(i)) for i in range(1, 11)], "k long, v double"), "k", "v", 0.1).first().value == 2.0


def test_live_activity_stream_equals_batch(spark, tmp_path):
    rows = [(m, i, -20.0 if 10 <= i < 30 else -70.0) for m in (1, 2) for i in range(60)]
    frames = spark.createDataFrame(rows, "media_id long, idx long, level double")
    batch = {tuple(r) for r in live.activity(frames).collect()}
    assert any(r[2] for r in batch)
    for part in range(2):
        frames.where(F.col("idx") >= 30 if part else F.col("idx") < 30).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = live.activity(source, stream=True).writeStream.format("memory").queryName("live_activity").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    stream.processAllAvailable()
    stream.stop()
    assert {tuple(r) for r in spark.table("live_activity").collect()} == batch


def test_recognition_keeps_the_first_final_time():
    s = live.Recognition.start()
    s = live.Recognition.step(s, 0, 0, "hel", None, False, 1)
    s = live.Recognition.step(s, 0, 0, "hello", 0.9, True, 2)
    s = live.Recognition.step(s, 0, 0, "hello", 0.9, True, 9)
    assert s["0:0"]["at"] == 2
    assert live.Recognition.transcript(s) == "hello"
    p = live.RuntimeProfile.step(live.RuntimeProfile.start(), "transcription", 50, 100)
    p = live.RuntimeProfile.step(p, "transcription", 100, 100)
    assert p["transcription"] == pytest.approx(0.675)
    assert live.RuntimeProfile.step(p, "transcription", -1, 100) == p
