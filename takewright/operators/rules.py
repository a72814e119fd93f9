"""Ordered rules: gates, verdicts, scenes, budgets, rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, decibels_to_linear, finite, js_round

#: The gates that count for audio quality.
AUDIO_GATES = ["capture_truncated", "clipping", "noise_floor", "signal_level", "snr", "duration", "audio_persistence", "headroom", "dc_offset", "speech_activity", "plosives", "mouth_noise", "reverb"]
#: Of each mode, least activity, least SNR and highest room tone.
MODES = {"training": (0.25, 24.0, -50.0), "dubbing": (0.18, 18.0, -46.0), "mastering": (0.12, 14.0, -42.0)}


def tier(steps: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, condition in steps:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def dataset_readiness(completed: Column, audio: Column, asr: Column, aligned: Column) -> Column:
    return tier([
        ("Premium Candidate", (completed >= 1500) & (audio >= 90) & (asr >= 90) & (aligned >= 90)),
        ("Production Candidate", (completed >= 500) & (audio >= 85) & (asr >= 90) & (aligned >= 80)),
        ("MVP Candidate", (completed >= 6) & (audio >= 80) & (asr >= 80)),
    ], "Needs Calibration")


def recommendation(completed: Column, audio: Column, asr: Column, aligned: Column, intents: Column, prosody: Column, phonetics: Column, missing: Column) -> Column:
    """What to record next, as a key: the first rule that applies."""
    return tier([
        ("start_with_room_tone", completed == 0), ("clean_audio", audio < 80), ("verify_text", asr < 100), ("import_alignment", aligned < 100),
        ("add_intent", intents < 70), ("vary_rhythm", prosody < 70), ("target_phonetics", (phonetics < 70) & (F.size(missing) > 0)),
    ], "continue")


def gate_points(status: Column | None = None) -> Column:
    status = F.col("status") if status is None else status
    return F.when(status == "pass", 1.0).when(status == "review", 0.5).otherwise(0.0)


def audio_score(gates: DataFrame) -> DataFrame:
    """The mean over takes of their mean audio gate points, in per cent to two places, and the number of takes."""
    takes = gates.where(F.col("gate_id").isin(AUDIO_GATES)).groupBy("take_id").agg(F.avg(gate_points()).alias("score"))
    return takes.agg(js_round(F.avg("score") * 100, 2).alias("score"), F.count("*").alias("takes"))


def headroom(true_peak: Column) -> Column:
    return F.when(true_peak >= -1, "fail").when(true_peak >= -3, "review").otherwise("pass")


def gate_statuses(mode: str) -> dict[str, Column]:
    """Statuses of the measured gates over the columns peak, lufs, floor, snr, active, reverb, dc, clipping and duration_ms."""
    active, snr, _ = MODES[mode]
    review = lambda bad: F.when(bad, "review").otherwise("pass")
    return {
        "clipping": F.when(F.col("clipping"), "fail").otherwise("pass"),
        "headroom": headroom(F.col("peak")),
        "signal_level": F.when((F.col("peak") <= -55) | (F.col("lufs") <= -60), "fail").otherwise(review((F.col("peak") < -34) | (F.col("lufs") < -42))),
        "duration": review(~F.col("duration_ms").between(690, 8000)),
        "dc_offset": review(F.abs("dc") > 0.02),
        "speech_activity": review(F.col("active") < active),
        "snr": review(F.col("snr") < snr),
        "reverb": review(F.col("reverb") > 0.65),
    }


def verdict(mode: str) -> Column:
    """Rejected by any failed gate, passed if all pass, else for review."""
    statuses = list(gate_statuses(mode).values())
    failed = F.array_contains(F.array(*statuses), "fail")
    return F.when(failed, "reject").when(F.forall(F.array(*statuses), lambda s: s == "pass"), "pass").otherwise("review")


VERDICT_SQL = """SELECT session_id, take_ord, CASE WHEN clipping OR peak >= -1 OR peak <= -55 OR lufs <= -60 THEN 'reject'
  WHEN peak < -3 AND NOT (peak < -34 OR lufs < -42) AND duration_ms BETWEEN 690 AND 8000 AND abs(dc) <= 0.02 AND active >= 0.25 AND snr >= 24 AND reverb <= 0.65 THEN 'pass' ELSE 'review' END AS verdict FROM metrics"""


def transcript_status(source: Column, score: Column, sung: Column) -> Column:
    return F.when(source == "prompt_only", "review").when(score < 0.75, F.when(sung, "review").otherwise("fail")).when(score < 0.92, "review").otherwise("pass")


def prosody_score(deviation: Column, energy: Column) -> Column:
    return js_round((F.least(F.lit(1.0), deviation / 4) + F.least(F.lit(1.0), energy / 12)) / 2, 2)


def performance(pitch_range: Column, variation: Column, voiced: Column, sung: Column) -> Column:
    """Sung by intent, possibly sung by the signal, spoken, or undetermined; without a pitch never more than that."""
    pitched = pitch_range.isNotNull() & variation.isNotNull()
    kind = F.when(sung, "sung").when(pitched & (pitch_range >= 7) & (variation >= 2.2) & (voiced >= 0.2), "sung_candidate").when(pitched & (voiced >= 0.12), "spoken").otherwise("undetermined")
    confidence = F.when(kind == "sung", 1.0).when(kind == "sung_candidate", 0.55).when(kind == "spoken", 0.66).otherwise(0.35)
    return F.struct(kind.alias("kind"), confidence.alias("confidence"))


def lifecycle(rating: Column) -> Column:
    return F.when(rating == "keeper", "training_candidate").when(rating == "maybe", "needs_review").when(rating == "reject", "rejected").otherwise("captured")


def lifecycle_reasons(rating: Column, alignment: Column, has_rights: Column, verdict: Column) -> Column:
    """Why a take is not simply ready; the list is empty for a candidate without reservations."""
    own = F.when(rating == "reject", "legacy_rejected_rating").when(rating == "maybe", "legacy_maybe_rating").when(rating == "unreviewed", "not_reviewed")
    reservations = F.array_compact(F.array(F.when(alignment == "estimated_g2p", "alignment_is_estimated"), F.when(alignment == "local_acoustic_comparison", "local_acoustic_alignment_requires_confirmation"), F.when(~has_rights, "rights_not_granted"), F.when(verdict != "pass", "quality_requires_review")))
    return F.when(own.isNotNull(), F.array(own)).otherwise(reservations)


def included(rating: Column, statuses: list[str]) -> Column:
    return rating.isin(statuses) | lifecycle(rating).isin(statuses)


def valid_right(status: Column, evidence: Column) -> Column:
    return F.coalesce((status == "granted") & evidence.isNotNull(), F.lit(False))


def valid_consent(status: Column, grants: Column, restrictions: Column, granted_at: Column, revoked_at: Column, evidence: Column) -> Column:
    wanted = F.array_contains(grants, "forge_ingestion") & F.array_contains(grants, "model_training")
    return F.coalesce((status == "granted") & wanted & (F.size(restrictions) == 0) & granted_at.isNotNull() & revoked_at.isNull() & evidence.isNotNull(), F.lit(False))


def capture_scene(kind: Column, snr: Column, reverb: Column, active: Column) -> Column:
    snr, reverb, active = finite(snr), finite(reverb), finite(active)
    known = lambda x: F.coalesce(x, F.lit(False))
    return tier([
        ("sung_voice", kind.isin("sung", "sung_candidate")),
        ("constrained_voice", known(snr < 18) | known(reverb > 0.6) | known(active < 0.12)),
        ("clean_voice", (kind == "spoken") & F.coalesce(snr >= 24, F.lit(True)) & F.coalesce(reverb <= 0.45, F.lit(True)) & F.coalesce(active >= 0.18, F.lit(True))),
    ], "uncertain")


def escalates(segments: Column, scene: Column, words: Column, expected: Column, matched: Column, alignment: Column) -> Column:
    """Whether a first pass needs a second: never for verified silence, but for singing."""
    rate = matched / expected
    return F.when(segments == 0, scene == "sung_voice").when(scene != "clean_voice", True).when(words == 0, True).when(expected == 0, False).otherwise((rate < 0.9) | ~alignment.isin("strong", "acceptable"))


def runtime_class(factor: Column) -> Column:
    return F.when(factor <= 0.35, "fast").when(factor <= 0.8, "moderate").otherwise("constrained")


def slower_class(a: Column, b: Column) -> Column:
    rank = lambda x: F.when(x == "fast", 0).when(x == "moderate", 1).otherwise(2)
    return F.element_at(F.array(F.lit("fast"), F.lit("moderate"), F.lit("constrained")), F.greatest(rank(a), rank(b)) + 1)


def realtime_factor(elapsed: Column, duration: Column) -> Column:
    factor = js_round(finite(elapsed / duration), 3)
    return F.when(factor > 0, factor)


def auto_gain() -> list[Column]:
    """Gain towards -20 LUFS, held back by a true peak of -3 dBFS, a noise floor of -42 dBFS and 12 dB; what holds it back."""
    target, peak, floor = -20 - F.col("lufs"), -3 - F.col("peak"), -42 - F.col("floor")
    gain = F.greatest(F.lit(0.0), F.least(F.lit(12.0), target, peak, floor))
    least = F.least(target, peak, floor, F.lit(12.0))
    limit = F.when(target == least, "target").when(peak == least, "true_peak").when(floor == least, "noise_floor").otherwise("maximum")
    quiet = (F.col("active") < 0.04) | (F.col("peak") <= -72)
    none = F.col("clipping") | quiet
    return [F.when(none, 0.0).otherwise(gain).alias("gain_db"), F.when(F.col("clipping"), "clipping").when(quiet, "insufficient_signal").otherwise(limit).alias("limited_by")]


def manual_gain_db(factor: Column, peak: Column) -> Column:
    return F.least(20 * F.log10(clamp(factor, 0.5, 3.0)), -3 - peak)


def gain_factor(db: Column) -> Column:
    return decibels_to_linear(db)


GAIN_SQL = """SELECT session_id, take_ord, CASE WHEN clipping OR active < 0.04 OR peak <= -72 THEN 0.0 ELSE greatest(0.0, least(12.0, -20 - lufs, -3 - peak, -42 - floor)) END AS gain_db,
  CASE WHEN clipping THEN 'clipping' WHEN active < 0.04 OR peak <= -72 THEN 'insufficient_signal' WHEN -20 - lufs = least(-20 - lufs, -3 - peak, -42 - floor, 12.0) THEN 'target' WHEN -3 - peak = least(-20 - lufs, -3 - peak, -42 - floor, 12.0) THEN 'true_peak' WHEN -42 - floor = least(-20 - lufs, -3 - peak, -42 - floor, 12.0) THEN 'noise_floor' ELSE 'maximum' END AS limited_by FROM metrics"""


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 where it is more."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def tokens_match(expected: Column, actual: Column) -> Column:
    """Equal; or of three letters each: one of five letters or more ends with the other, both of five where one begins with the
    other, or one edit apart, two from seven letters on."""
    short = F.least(F.length(expected), F.length(actual))
    ends = ((F.length(expected) >= 5) & expected.endswith(actual)) | ((F.length(actual) >= 5) & actual.endswith(expected))
    begins = (short >= 5) & (expected.startswith(actual) | actual.startswith(expected))
    return (expected == actual) | ((short >= 3) & (ends | begins | (F.levenshtein(expected, actual) <= F.when(short >= 7, 2).otherwise(1))))


def words_compatible(a: Column, b: Column) -> Column:
    longest, short = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    alike = (1 - F.levenshtein(a, b) / longest) >= F.when(longest <= 5, 0.8).otherwise(0.72)
    return ((a == b) & (a != "")) | ((short >= 4) & (longest - short <= 2) & alike)


def token_confidence(word: Column, unsupported: Column) -> Column:
    c = 0.82 - F.when(word.rlike("[0-9]"), 0.14).otherwise(0.0) - F.when(unsupported, 0.18).otherwise(0.0) - F.when(word.rlike("[.-]"), 0.05).otherwise(0.0) - F.when(F.length(word) <= 2, 0.03).otherwise(0.0)
    return js_round(F.greatest(F.lit(0.45), c), 2)


def pause_weight(trailing: Column) -> Column:
    return F.when(trailing.rlike("[.!?]"), 0.9).when(trailing.rlike("[,;:]"), 0.42).otherwise(0.0)


def source_weight(kind: Column, confidence: Column) -> Column:
    return js_round(F.when(kind == "acoustic", 1.0).when(kind == "local_acoustic", 0.65).otherwise(0.2) * confidence, 3)


def media_limits(byte_size: Column, duration_ms: Column) -> Column:
    return (byte_size <= 200_000_000) & F.coalesce(duration_ms <= 600_000, F.lit(True))
