"""Golden values of functions and kernels."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewright.functions import numbers as N
from takewright.functions import phonemes as P
from takewright.functions import sequences as Q
from takewright.functions import signal as S
from takewright.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rounding_goes_up(spark):
    assert value(spark, N.js_round(F.lit(-19.35), 1)) == -19.3
    assert value(spark, N.js_round(F.lit(2.5))) == 3
    assert value(spark, N.bounded_int(F.lit(99.4), 1, 60)) == 60
    assert value(spark, N.bounded_int(F.lit(float("nan")), 1, 60, 10)) == 10
    assert value(spark, N.amplitude_to_dbfs(F.lit(0.0))) == -96.0


def test_checks_raise(spark):
    with pytest.raises(Exception, match="between 0 and 1"):
        value(spark, N.bounded_number(F.lit(1.5)))
    assert value(spark, N.bounded_integer(F.lit(3), 5)) == 3


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (X.fold, "Élève ÇA", "eleve ca"),
        (X.normalize_corpus_text, "a\r\nb\t c\n\n\n\nd ", "a\nb c\n\nd"),
        (X.clean_segment, " - hello   there", "hello there"),
        (X.decode_entities, "&amp;lt;b&gt; &quot;x&#39;", "<b> \"x'"),
        (X.clean_subtitle, "<v Ann>Hi <i>you</i></v>", "Hi you"),
        (X.timestamp_ms, "01:02:03,004", 3723004),
        (X.timestamp_ms, "02:03.004", 123004),
        (X.timestamp_ms, "nonsense", None),
        (X.hash_corpus_text, "abc", "7aigaz"),
        (X.slug, "Été à la plage!", "ete-a-la-plage"),
        (X.is_timing_line, "00:00:01,000 --> 00:00:02,500", True),
        (X.normalize_token, "«L’été!»", "l'ete"),
        (X.youtube_id, "https://youtu.be/abcdefghijk?t=3", "abcdefghijk"),
        (X.youtube_id, "https://www.youtube.com/embed/abcdefghijk", "abcdefghijk"),
        (X.youtube_id, "https://example.com/watch?v=abcdefghijk", None),
    ],
)
def test_text(spark, function, given, wanted):
    assert value(spark, function(F.lit(given).cast("string"))) == wanted


def test_cue_needs_a_later_end(spark):
    assert value(spark, X.timing(F.lit("00:01.000 --> 00:02.500"))) == (1000, 2500)
    assert value(spark, X.timing(F.lit("00:03.000 --> 00:02.500"))) is None


def test_paths(spark):
    for path, good in (("a/b.json", True), ("../b", False), ("/a", False), ("a//b", False), ("a\\b", False), ("", False), ("x" * 101, False)):
        assert value(spark, X.safe_relative_path(F.lit(path))) is good


def test_times(spark):
    assert value(spark, X.media_time(F.lit(3661.9))) == "1:01:01"
    assert value(spark, X.media_time(F.lit(61))) == "1:01"
    assert value(spark, X.capture_limit(F.lit(90000))) == "1 min 30 s"


def test_artifact_types_follow_their_order(spark):
    assert value(spark, X.artifact_type(F.lit("rights/consents.jsonl"))) == "provenance"
    assert value(spark, X.artifact_type(F.lit("audio/x.wav"))) == "audio"
    assert value(spark, X.artifact_type(F.lit("checksums.sha256"))) == "integrity"
    assert value(spark, X.schema_version(F.lit("manifest.json"))) == "voice.capture.package.v1"


def test_phonemes():
    assert P.french("eau") == ["o"]
    assert P.french("l'ami") == ["l", "an", "i"]
    assert P.french("") == ["spn"]
    assert P.english("nation") == ["N", "AE", "SH", "AH", "N"]
    assert P.english("quick") == ["K", "W", "IH", "K"]
    assert P.english("tree") == ["T", "R", "EH"]
    assert P.syllables("table", "fr") == 1
    assert P.confidence("a1", ["spn"]) == pytest.approx(0.47)
    parts = P.intervals(["b", "on", "s"], 100, 400)
    assert parts[0][1] == 100
    assert parts[-1][2] == 400
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))


def test_alignment_closes_with_the_recording():
    words = P.align("Bonjour, l'eau est belle.", 3000, "fr", [(500, 1200), (1250, 2500)])
    assert words[0]["start_ms"] == 500
    assert words[-1]["end_ms"] == 3000
    assert all(a["end_ms"] <= b["start_ms"] + 1 for a, b in zip(words, words[1:], strict=False))


def test_sequences():
    assert Q.edit_distance("kitten", "sitting") == 3
    assert Q.transcript_match(["a", "b", "c"], ["a", "c", "d"])["missing"] == ["b"]
    assert Q.transcript_match(["a"], [])["source"] == "prompt_only"
    assert Q.agreement(["hello", "world"], ["hello", "word"]) == 1.0
    assert Q.merge_transcripts("the quick brown", "Quick brown fox") == "the quick brown fox"
    assert Q.error_rates("a b c".split(), "a x c d".split())["wer"] == 0.667
    assert Q.align_spoken("the quick brown fox".split(), "the quik".split())["position"] == 1
    ops = [o for o, _, _ in Q.edit_operations(list("abc"), list("axcd"))]
    assert ops == ["match", "substitute", "match", "insert"]
    assert Q.longest_run(["a", "a", "", "b", "b", "b"]) == 3


def timing(word, start, end):
    return {"word": word, "start_ms": start, "end_ms": end, "support": 0.8}


def test_compare_timings():
    a = [timing("one", 0, 100), timing("two", 100, 300)]
    b = [timing("One", 20, 130), timing("two", 150, 310)]
    found = Q.compare_timings(a, b)
    assert (found["match_rate"], found["median_ms"], found["status"]) == (1.0, 40.0, "strong")
    assert Q.compare_timings(a, [])["status"] == "insufficient"


def test_lexical_consensus_votes_and_recovers():
    base = [timing("hello", 0, 300), timing("ghost", 400, 500), timing("world", 900, 1200)]
    other = [timing("hello", 20, 310), timing("missing", 600, 800), timing("world", 910, 1210)]
    third = [timing("helo", 10, 300), timing("missing", 610, 820), timing("world", 905, 1190)]
    make = lambda kind, model, words: {"kind": kind, "model": model, "signal": "original", "words": words}
    found = Q.consensus([make("a", "base", base), make("b", "tiny", other), make("c", "tiny", third)])
    assert [w["word"] for w in found["words"]] == ["hello", "missing", "world"]
    assert "ghost" not in [w["word"] for w in found["words"]]


@pytest.fixture
def sine():
    t = np.arange(48000) / 48000
    return 0.5 * np.sin(2 * np.pi * 150 * t)


def test_levels(sine):
    found = S.analyze(sine, 48000)
    assert found["peak_dbfs"] == pytest.approx(-6.0, abs=0.1)
    assert found["rms_dbfs"] == pytest.approx(-9.0, abs=0.1)
    assert found["pitch_hz"] == pytest.approx(150, abs=3)
    assert not found["clipping"]
    silence = S.analyze(np.zeros(4800), 48000)
    assert silence["peak_dbfs"] == -96.0
    odd = S.analyze(np.array([np.nan, np.inf, 0.5, -np.inf] * 600), 48000)
    assert math.isfinite(odd["rms_dbfs"])
    assert S.analyze(np.ones(4800), 48000)["clipping"]


def test_resampling(sine):
    assert len(S.resample(sine, 48000, 16000)) == 16000
    high = np.sin(2 * np.pi * 18000 * np.arange(44100) / 44100)
    assert np.abs(S.resample(high, 44100, 16000)[200:-200]).max() < 0.05
    ends = S.resample_linear(np.array([0.0, 1.0, 2.0]), 3, 9)
    assert (ends[0], ends[-1]) == (0.0, 2.0)


def test_separation_and_masks(sine):
    assert S.difference(sine, sine) == 0.0
    assert len(S.separate(sine, sine, 48000)) == len(sine)
    masked = S.mask_activity(sine, 48000, [(200, 400)])
    assert np.abs(masked[:4800]).max() == 0
    assert S.fade_edges(np.ones(100), 10)[0] == 0
    assert np.isfinite(S.stereo_focus(sine[:8000], sine[:8000], 16000)).all()


def test_wav(sine):
    content = S.encode_wav24(sine[:4801], 48000)
    assert S.validate_wav(content) == {"rate": 48000, "channels": 1, "depth": 24, "duration_ms": 100, "error": None}
    for bad in (content[:-1], b"", None, content[:20], b"RIFX" + content[4:]):
        assert S.validate_wav(bad)["error"]


def test_words_are_told_once_and_alike(monkeypatch):
    from takewright.functions import phonemes as P

    P.told.cache_clear()
    seen = []
    real = P.normalize_token
    monkeypatch.setattr(P, "normalize_token", lambda w: seen.append(w) or real(w))
    found = P.align("The ship, the ship. L'eau... d’été 42!", 9000, "fr")
    assert seen == sorted(set(seen), key=seen.index) and [w["word"] for w in found][:2] == ["The", "ship"]
    assert [{k: v for k, v in w.items() if k != "intervals"} for w in found] == P.align("The ship, the ship. L'eau... d’été 42!", 9000, "fr", with_intervals=False)
    assert all(w["intervals"] == P.intervals(w["phonemes"], w["start_ms"], w["end_ms"]) and w["confidence"] == P.confidence(real(w["word"]), w["phonemes"]) for w in found)
    assert seen == sorted(set(seen), key=seen.index)
    P.told.cache_clear()


def test_texts_are_hashed_together(spark):
    """Before, each letter was a text of its own, met by three passes of an interpreted lambda."""
    from takewright.functions import text as X

    texts = ["", "a", None, "é\u2028", "\U0001f600x", "abc" * 50, "\ud7ff\uffff", *("x" * n for n in range(9))]

    def plain(t):
        h = 0x811C9DC5
        for c in t:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    wanted = [None if t is None else plain(t) for t in texts]
    assert X.fnv1a_all(texts) == X.fnv1a_all(texts, most=7) == wanted
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.fnv1a("t").alias("h"))
    assert [r.h for r in rows.orderBy("i").collect()] == wanted
    assert "aggregate(" not in rows._jdf.queryExecution().toString()
