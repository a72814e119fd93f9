"""Finalised recordings, imported media by budget, stores restored as a whole."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from takewright.operators import adaptive, finalize
from takewright.plans import catalog
from takewright.sources import packages, stores

MEASURED = {"peak": -6.0, "true_peak": -5.0, "lufs": -20.0, "rms": -20.0, "floor": -70.0, "snr": 40.0, "active": 0.6, "reverb": 0.1, "plosive": 0.0, "mouth": 0.0, "voiced": 0.5, "dc": 0.0, "source_floor": None, "room_floor": -70.0}


def recordings(spark, rows):
    """(session_id, take_id, prompt_id, content) with measures of a good take, clipped where take_id ends with x."""
    x = spark.createDataFrame(rows, "session_id string, take_id string, prompt_id long, content binary")
    doubles = {k: F.lit(v).cast("double") for k, v in MEASURED.items()}
    other = {"clipping": F.col("take_id").endswith("x"), "sample_count": F.lit(48_000), "duration_ms": F.lit(1000), "truncated": F.lit(False), "gain_limit": F.lit(None).cast("string"), "room_tone": F.lit(True), "min_ms": F.lit(500), "max_ms": F.lit(5000), "transcript_source": F.lit("web_speech"), "transcript_status": F.lit("pass"), "words": F.lit(2), "phonemes": F.lit(4), "aligned": F.lit(True)}
    return x.withColumns(doubles | other)


def test_each_stage_tells_what_it_could_not_do(spark):
    rows = [("s 1", "a", 1, b"A"), ("s 1", "b/x", 1, b"B"), ("s 1", "c", 1, None), ("s 1", "d", 1, b""), ("s 1", "e", 99, b"E"), ("s 2", "f", 2, b"F"), ("s 2", "g", 2, b"G"), ("s 3", "a", 1, b"A"), ("s 3", "a", 1, b"A"), ("s 4", "h", None, b"H")]
    x = recordings(spark, rows)
    prompts = spark.createDataFrame([(1,), (2,), (2,), (None,)], "prompt_id long")
    names = finalize.identified(x)
    stored = names.where("take_id not in ('f')").select("file_name", F.when(F.col("take_id") == "g", "other").otherwise(F.col("sha256")).alias("sha256"))
    done = finalize.finalize(x, prompts, stored)
    got = sorted((r["session_id"], r["take_id"], r["file_name"], *r["evidence"], r["verdict"], r["rating"], r["gates"] and r["gates"][-1]["id"]) for r in done.collect())
    assert got == [
        ("s 1", "a", "s-1__a.wav", "done", "done", "done", "not_needed", "pass", "keeper", "corpus_consistent"),
        ("s 1", "b/x", "s-1__b-x.wav", "done", "done", "done", "not_needed", "reject", "reject", "corpus_consistent"),
        ("s 1", "c", "s-1__c.wav", "nothing_recorded", "nothing_recorded", "nothing_recorded", "not_needed", None, None, None),
        ("s 1", "d", "s-1__d.wav", "nothing_recorded", "nothing_recorded", "nothing_recorded", "not_needed", None, None, None),
        ("s 1", "e", "s-1__e.wav", "done", "done", "no_prompt", "not_needed", None, None, None),
        ("s 2", "f", "s-2__f.wav", "done", "not_stored", "done", "rejected", "reject", "reject", "audio_persistence"),
        ("s 2", "g", "s-2__g.wav", "done", "other_content", "done", "rejected", "reject", "reject", "audio_persistence"),
        ("s 3", "a", "s-3__a.wav", "done", "done", "done", "not_needed", "pass", "keeper", "corpus_consistent"),
        ("s 3", "a", "s-3__a.wav", "done", "done", "done", "not_needed", "pass", "keeper", "corpus_consistent"),
        ("s 4", "h", "s-4__h.wav", "done", "done", "no_prompt", "not_needed", None, None, None),
    ]
    sessions = {r["session_id"]: tuple(r)[1:] for r in finalize.completed(done).collect()}
    assert sessions == {"s 1": (2, 1, 0, 1, False, [1]), "s 2": (2, 0, 0, 2, False, []), "s 3": (2, 2, 0, 0, True, [1]), "s 4": (0, 0, 0, 0, True, [])}
    assert finalize.finalize(x.limit(0), prompts, stored).count() == 0


def test_imports_are_read_by_budget(spark):
    columns = "media_id long, duration_ms long, accelerated boolean, speech double, focused double, difference double, separated_difference double, center boolean"
    media = [(1, 60_000, True, 0.5, 0.5, 0.01, 0.0, False), (2, 60_000, True, 0.5, 0.5, 0.09, 0.1, False), (3, 60_000, True, 0.5, 0.5, 0.09, 0.0, False), (4, 60_000, False, 0.5, 0.5, 0.09, 0.1, False), (5, 400_000, True, 0.5, 0.5, 0.09, 0.1, False), (6, 60_000, True, 0.05, 0.05, 0.01, 0.1, False), (7, 60_000, True, 0.5, 0.5, 0.09, 0.1, False)]
    readings = [(n, m, "review", ["one", "two"], {(7, "base"): 40_000.0}.get((m, n), 10_000.0)) for m in range(1, 8) for n in adaptive.READINGS]
    table = spark.createDataFrame(readings, "reading string, media_id long, status string, tokens array<string>, elapsed_ms double")
    asked: dict[str, list[int]] = {}

    def read(name, keys):
        asked[name] = sorted(r["media_id"] for r in keys.select("media_id").collect())
        return table.where(F.col("reading") == name).join(keys.select("media_id"), "media_id", "left_semi")

    got = {r["media_id"]: tuple(r)[1:] for r in adaptive.segment(spark.createDataFrame(media, columns), read).collect()}
    assert asked == {"tiny": [1, 2, 3, 4, 5, 6, 7], "base": [1, 2, 3, 4, 6, 7], "focus": [2, 3, 7], "separated": [2]}
    assert got == {
        1: ("clean_voice", 2, 2, "not_needed", "not_needed", "tiny,base"), 2: ("music_mix", 4, 4, "read", "separated", "tiny,base,focus,separated"), 3: ("music_mix", 4, 4, "read", "separated", "tiny,base,focus"),
        4: ("music_mix", 2, 2, "skipped_for_budget", "skipped_for_budget", "tiny,base"), 5: ("music_mix", 1, 1, "skipped_for_length", "skipped_for_length", "tiny"), 6: ("constrained_voice", 3, 3, "not_needed", "not_needed", "tiny,base"),
        7: ("music_mix", 4, 3, "read", "skipped_for_budget", "tiny,base,focus"),
    }


def table(spark, files: dict[str, bytes]):
    return spark.createDataFrame(list(files.items()), "path string, content binary")


def content(spark, root) -> dict[str, bytes]:
    return {r["path"]: bytes(r["content"]) for r in packages.held(spark, root).collect()}


@pytest.mark.parametrize("layout", ["files", "archives"])
def test_restores_are_all_or_nothing(spark, tmp_path, layout):
    root = str(tmp_path / "store")
    assert stores.names(spark, root).count() == 0
    stores.restore(spark, root, table(spark, {"a": b"1", "b/c": b"2"}), layout)
    stores.restore(spark, root, table(spark, {"b/c": b"2", "d": b"3"}), layout)
    whole = {"a": b"1", "b/c": b"2", "d": b"3"}
    assert content(spark, root) == whole
    before = packages.current(spark, root)[0]
    with pytest.raises(stores.Conflict, match="b/c"):
        stores.restore(spark, root, table(spark, {"b/c": b"other", "e": b"4"}), layout)
    twice = table(spark, {"e": b"4"}).unionByName(table(spark, {"e": b"5"}))
    with pytest.raises(stores.Conflict, match="e"):
        stores.restore(spark, root, twice, layout)
    with pytest.raises(Exception, match="unsafe path"):
        stores.restore(spark, root, table(spark, {"f": b"6", "../g": b"7"}), layout)
    assert packages.current(spark, root)[0] == before and content(spark, root) == whole
    stores.restore(spark, root, table(spark, {"e": b"4"}).unionByName(table(spark, {"e": b"4"})), layout)
    assert content(spark, root) == whole | {"e": b"4"} and os.path.exists(f"{root}/CURRENT")


def test_tiers_are_read_in_order(spark):
    wanted = table(spark, {"a": b"", "b": b"", "c": b"", "d": b""}).select("path")
    got = stores.first_of(wanted, table(spark, {"a": b"1"}), table(spark, {"a": b"8", "b": b"2"}), table(spark, {"b": b"9", "c": b"3", "z": b"0"}))
    assert sorted((r["path"], bytes(r["content"]), r["tier"], r["promote"]) for r in got.collect()) == [("a", b"1", 0, False), ("b", b"2", 1, True), ("c", b"3", 2, True)]


def test_sessions_are_told_without_measures(spark):
    """Before, all measures of a recording and its digest in 64 letters were sent twice, only to count ratings."""
    told = catalog.QUERIES["b15_completed_sessions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("unhex(") == 2
    assert told.count("sha2(") <= 5


def test_gates_go_along_as_a_number(spark):
    """Before, all measures were sent to make 25 gates of them after the joins, in code too long to be compiled, and each gate was joined by itself."""
    from takewright.operators import takes

    told = catalog.QUERIES["b15_finalized_recordings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "rms#" not in told.split("Join")[0] and "transform(" not in told
    rows = [("s", f"{i}{'x' if i % 3 else ''}", i, b"") for i in range(12)]
    i = F.col("prompt_id")
    status = F.when(i % 5 == 0, "pass").when(i % 5 == 1, "review").when(i % 5 == 2, "fail").when(i % 5 == 3, "unheard")
    x = recordings(spark, rows).withColumns({"transcript_status": status, "transcript_source": F.when(i % 2 == 0, "prompt_only"), "aligned": i % 4 < 2, "peak": F.when(i != 6, -6.0 - i * 5), "rms": F.when(i != 4, F.lit(1.0)), "room_tone": F.when(i != 8, i != 9), "voiced": F.when(i != 10, 0.5)})
    done = takes.recorded(x).withColumn("levels", F.when(i == 11, F.col("levels").bitwiseOR(F.lit(takes.LOST))).otherwise(F.col("levels")))
    for r in done.select("*", takes.gates_of(F.col("levels")).alias("list"), takes.gates_text(F.col("levels")).alias("text")).collect():
        said = dict.fromkeys(takes.GATES, "pass") | {"transcript_match": r.transcript_status, "browser_asr_consistent": r.transcript_status}
        said |= {g: "fail" for g, bad in (("clipping", r.clipping), ("energy_valid", r.rms is None)) if bad}
        said |= {"signal_level": "review"} if r.peak is not None and -55 < r.peak < -34 else {"signal_level": "fail"} if r.peak is not None and r.peak <= -55 else {}
        quiet = "pass" if r.room_tone else "review"
        said |= {"noise_floor": quiet, "noise_floor_valid": quiet, "phoneme_alignment": "pass" if r.aligned else "review", "prosody_valid": "pass" if r.voiced else "review"}
        clean = r.room_tone and said["signal_level"] == "pass" and (r.transcript_source == "prompt_only" or r.transcript_status == "pass")
        assert r.verdict == ("reject" if "fail" in (said["clipping"], said["signal_level"]) else "pass" if clean else "review")
        wanted = [*said.items(), *([("audio_persistence", "fail")] if r.prompt_id == 11 else [])]
        assert [tuple(g) for g in r.list] == wanted
        assert r.text == ",".join(g if s is None else f"{g}:{s}" for g, s in wanted)
