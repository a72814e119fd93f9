"""Queries of gates as evidence, best choices, lookups by place, and audio activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import dsp, gates, intervals, rules
from ..operators import statistics as S
from .base import Tables, query


@query("m02_m03_gate_evidence", "SELECT take_id, ord, CASE gate_id WHEN 'transcript_match' THEN 'browser_asr' ELSE 'audio_analysis' END AS source, CASE gate_id WHEN 'transcript_match' THEN NULL ELSE 0.9 END AS confidence FROM gates")
def gate_evidence(t: Tables) -> DataFrame:
    return gates.enrich(t.gates).select("take_id", "ord", "source", "confidence")


@query("m07_transcript_message", "SELECT session_id, take_ord, CASE WHEN clipping THEN 'no_reliable_transcript' ELSE CASE WHEN active >= 0.92 THEN 'aligned' WHEN active >= 0.75 THEN 'to_reread' WHEN dc > 0.01 THEN 'sung_unconfirmed' ELSE 'incompatible' END || ':' || CAST(floor(active * 100 * 1.0 + 0.5) AS BIGINT) END AS message FROM metrics")
def transcript_message(t: Tables) -> DataFrame:
    return t.metrics.select("session_id", "take_ord", gates.transcript_message(F.when(F.col("clipping"), "prompt_only").otherwise("web_speech"), F.col("active"), F.col("dc") > 0.01).alias("message"))


@query("b16_unsaved_takes", "SELECT take_id, count(*) AS gates, bool_or(status = 'fail') AS rejected FROM (SELECT take_id, status FROM gates UNION ALL SELECT DISTINCT take_id, 'fail' FROM gates WHERE take_id % 5 = 0) GROUP BY take_id")
def unsaved_takes(t: Tables) -> DataFrame:
    saved = t.gates.where("take_id % 5 <> 0").select("take_id").distinct()
    return gates.reject_unsaved(t.gates, saved).groupBy("take_id").agg(F.count("*").alias("gates"), F.bool_or(F.col("status") == "fail").alias("rejected"))


@query("g06_g07_take_alignment", "SELECT session_id, take_ord, coalesce(CASE WHEN clipping THEN 0.95 END, floor(active * greatest(0.0, 1 - abs(peak) * 9 / 500) * 1000.0 + 0.5) / 1000.0, 0) AS confidence, NOT clipping AS forced_required FROM metrics")
def take_alignment(t: Tables) -> DataFrame:
    forced = F.when(F.col("clipping"), 0.95)
    return t.metrics.select("session_id", "take_ord", F.coalesce(forced, gates.local_confidence(F.col("active"), F.abs("peak") * 9), F.lit(0.0)).alias("confidence"), forced.isNull().alias("forced_required"))


BEST = "SELECT user_id, arg_max(event_id, (score, -event_id)) AS event_id FROM (SELECT user_id, event_id, {0} AS score FROM events) GROUP BY user_id"


@query("h05_best_hypothesis", BEST.format("value"))
def best_hypothesis(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("event_id"))


@query("h06_best_acoustic", BEST.format("CASE WHEN event_type = 'view' THEN value ELSE -1 END"))
def best_acoustic(t: Tables) -> DataFrame:
    score = F.when(F.col("event_type") == "view", F.col("value")).otherwise(-1.0)
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct(score, -F.col("event_id"))).alias("event_id"))


@query("h07_best_alternative", BEST.format("floor((value / 300 * 0.68 + event_id % 7 / 7 * 0.27 + 0.5 * 0.05) * 1e9)"))
def best_alternative(t: Tables) -> DataFrame:
    score = F.floor(gates.alternative_score(F.col("value") / 300, F.col("event_id") % 7 / 7, F.lit(0.5)) * 1e9)
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct(score, -F.col("event_id"))).alias("event_id"))


@query("h10_newest_first", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 50")
def newest_first(t: Tables) -> DataFrame:
    top = t.events.orderBy(F.desc("ts"), "event_id").limit(50)
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc("ts"), "event_id")).alias("place"))


@query("h13_rights_upsert", "SELECT consent_id, speaker_id FROM consents WHERE speaker_id <> 3 UNION ALL SELECT 0, 3")
def rights_upsert(t: Tables) -> DataFrame:
    row = t.spark.createDataFrame([(0, 3)], "consent_id long, speaker_id long")
    return S.upsert(t.consents.select("consent_id", "speaker_id"), row, "speaker_id")


@query("h22_equal_progress", "SELECT a.speaker_id, a.p = b.p AS same FROM (SELECT speaker_id, list_sort(list_distinct(list(prompt_id))) AS p FROM takes WHERE rating = 'keeper' GROUP BY speaker_id) a JOIN (SELECT speaker_id, list_sort(list_distinct(list(prompt_id))) AS p FROM takes WHERE rating IN ('keeper', 'maybe') GROUP BY speaker_id) b ON a.speaker_id = b.speaker_id")
def equal_progress(t: Tables) -> DataFrame:
    of = lambda x, n: x.groupBy("speaker_id").agg(F.array_sort(F.collect_set("prompt_id")).alias(n))
    a, b = of(t.takes.where("rating = 'keeper'"), "a"), of(t.takes.where("rating in ('keeper', 'maybe')"), "b")
    return a.join(b, "speaker_id").select("speaker_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("d04_find_progress", "SELECT p.prompt_id, count(k.speaker_id) AS keepers FROM prompts p LEFT JOIN (SELECT DISTINCT speaker_id, prompt_id FROM takes WHERE rating = 'keeper') k ON p.prompt_id = k.prompt_id AND k.speaker_id = 1 GROUP BY p.prompt_id")
def find_progress(t: Tables) -> DataFrame:
    done = t.takes.where("rating = 'keeper' and speaker_id = 1").select("prompt_id", "speaker_id").distinct()
    return t.prompts.join(done, "prompt_id", "left").groupBy("prompt_id").agg(F.count("speaker_id").alias("keepers"))


@query("d18_word_progress", "SELECT media_id, min(idx) AS idx FROM word_timings WHERE end_ms >= 5000 GROUP BY media_id")
def word_progress(t: Tables) -> DataFrame:
    return t.word_timings.where("end_ms >= 5000").groupBy("media_id").agg(F.min("idx").alias("idx"))


@query("d19_acoustic_by_index", "SELECT media_id, idx, CASE WHEN idx % 3 = 0 THEN start_ms + 20 ELSE start_ms END AS start_ms FROM word_timings")
def acoustic_by_index(t: Tables) -> DataFrame:
    heard = t.word_timings.where("idx % 3 = 0").select("media_id", "idx", (F.col("start_ms") + 20).alias("heard"))
    return t.word_timings.join(heard, ["media_id", "idx"], "left").select("media_id", "idx", F.coalesce("heard", "start_ms").alias("start_ms"))


@query("c15_has_timing", "SELECT media_id, idx FROM frames WHERE isfinite(level) AND level >= -1000")
def has_timing(t: Tables) -> DataFrame:
    return t.frames.where(N.finite("level") >= -1000).select("media_id", "idx")


@query("c16_words_in_speech", "SELECT w.media_id, w.idx FROM word_timings w WHERE EXISTS (SELECT 1 FROM speech_segments s WHERE s.media_id = w.media_id AND w.start_ms < s.end_ms AND s.start_ms < w.end_ms)")
def words_in_speech(t: Tables) -> DataFrame:
    s = t.speech_segments.select(F.col("media_id").alias("m"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return t.word_timings.join(s, (F.col("media_id") == F.col("m")) & (F.col("start_ms") < F.col("e")) & (F.col("s") < F.col("end_ms")), "left_semi").select("media_id", "idx")


@query("e06_timestamps", "SELECT page_id, page_id % 3 * 3600000 + page_id % 60 * 60000 + page_id % 59 * 1000 + page_id % 999 AS ms FROM pages")
def timestamps(t: Tables) -> DataFrame:
    part = lambda m, n: F.lpad((F.col("page_id") % m).cast("string"), n, "0")
    clock = F.concat(part(3, 2), F.lit(":"), part(60, 2), F.lit(":"), part(59, 2), F.lit(","), part(999, 3))
    return t.pages.select("page_id", X.timestamp_ms(clock).alias("ms"))


@query("e07_cue_timing", "SELECT page_id, CASE WHEN page_id % 50 + 2 > page_id % 60 THEN page_id % 60 * 1000 END AS start_ms FROM pages")
def cue_timing(t: Tables) -> DataFrame:
    clock = lambda x: F.concat(F.lit("00:00:"), F.lpad(x.cast("string"), 2, "0"), F.lit(".000"))
    line = F.concat(clock(F.col("page_id") % 60), F.lit(" --> "), clock(F.col("page_id") % 50 + 2))
    return t.pages.select("page_id", X.timing(line)["start_ms"].alias("start_ms"))


@query("e09_stable_tokens", "SELECT count(DISTINCT text) AS tokens FROM documents")
def stable_tokens(t: Tables) -> DataFrame:
    return t.documents.agg(F.countDistinct(X.stable_token("text")).alias("tokens"))


@query("m13_recommendation", "SELECT session_id, take_ord, CASE WHEN duration_ms % 7 = 0 THEN 'start_with_room_tone' WHEN active * 100 < 80 THEN 'clean_audio' WHEN reverb * 100 < 100 THEN 'verify_text' ELSE 'import_alignment' END AS next FROM metrics")
def recommendation(t: Tables) -> DataFrame:
    full = F.lit(99)
    return t.metrics.select("session_id", "take_ord", rules.recommendation(F.col("duration_ms") % 7, F.col("active") * 100, F.col("reverb") * 100, full, full, full, full, F.array(F.lit("x"))).alias("next"))


@query("o07_checksum_file", "SELECT owner, string_agg(sha256 || '  ' || path, chr(10) ORDER BY path) AS content FROM files GROUP BY owner")
def checksum_file(t: Tables) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("path", F.concat("sha256", F.lit("  "), "path").alias("l"))))
    return t.files.groupBy("owner").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("content"))


@query("i06_focused_activity")
def focused_activity(t: Tables) -> DataFrame:
    """Voice activity from levels of frames: soft probabilities around a threshold from floor and peak, then hysteresis."""
    x = t.frames.withColumn("rms", F.pow(F.lit(10.0), F.col("level") / 20))
    per = x.groupBy("media_id").agg(F.max("rms").alias("peak"), F.array_sort(F.collect_list("rms")).alias("levels"))
    floor = F.element_at("levels", (F.floor(F.size("levels") * 0.2) + 1).cast("int"))
    per = per.where("peak >= 0.002").select("media_id", F.greatest(F.lit(0.0025), floor * 2.4, F.col("peak") * 0.075).alias("threshold"))
    p = N.clamp((F.col("rms") - F.col("threshold") * 0.55) / (F.col("threshold") * 0.9), 0.0, 1.0)
    return intervals.hysteresis(x.join(per, "media_id").select("media_id", "idx", p.alias("p")))


@query("l02_frame_levels", "SELECT vec_id, 1 AS frames FROM embeddings")
def frame_levels(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.size(dsp.frame_levels("embedding")).alias("frames"))


@query("l25_signal_difference", "SELECT vec_id, 0.0 AS difference FROM embeddings")
def signal_difference(t: Tables) -> DataFrame:
    """A signal and its multiple do not differ."""
    twice = F.transform("embedding", lambda x: x * 2)
    return t.embeddings.select("vec_id", F.abs(dsp.difference("embedding", twice)).alias("difference"))


@query("l27_faded_edges", "SELECT vec_id, 0.0 AS first FROM embeddings")
def faded_edges(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.abs(F.element_at(dsp.fade_edges("embedding", F.lit(5)), 1)).alias("first"))


@query("q49_stored_profiles", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(event_id % 4 AS DOUBLE) END AS factor FROM events")
def stored_profiles(t: Tables) -> DataFrame:
    stored = F.when(F.col("event_id") % 4 == 0, "not json").otherwise(F.concat(F.lit('{"factor":'), F.col("event_id") % 4, F.lit("}")))
    return t.events.select("event_id", F.coalesce(F.from_json(stored, "factor double")["factor"], F.lit(0.0)).alias("factor"))
