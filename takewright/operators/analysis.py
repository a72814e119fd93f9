"""Analysis plans, hypothesis scores and evidence of takes, as column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clamp, finite, js_round, js_round_int
from .rules import runtime_class, tier


def imported_scene(status: Column, speech: Column, focused: Column, difference: Column, center: Column) -> Column:
    music = ((difference >= 0.07) & (focused >= 0.08)) | ((focused - speech >= 0.16) & (focused >= 0.18)) | (center & (difference >= 0.045))
    return tier([("music_mix", music), ("constrained_voice", (status == "insufficient") | (speech < 0.12)), ("clean_voice", (speech >= 0.18) & (difference < 0.035))], "uncertain")


def measured_class(factor: Column) -> Column:
    return F.when(factor.isNull(), "unmeasured").otherwise(runtime_class(factor))


def imported_hypotheses(scene: Column, duration_ms: Column, profile: Column, factor: Column) -> Column:
    """How many hypotheses an imported recording is worth, 1 to 4."""
    speed, clean = measured_class(factor), scene == "clean_voice"
    return (
        F.when(duration_ms > 300_000, 1).when((profile == "compatible") | (speed == "constrained"), F.when(clean, 1).otherwise(2)).when(clean | (duration_ms > 180_000), 2)
        .when((scene == "music_mix") & (speed != "moderate"), 4).otherwise(3)
    )


def depth(hypotheses: Column) -> Column:
    return F.when(hypotheses == 1, "fast").when(hypotheses == 2, "verified").otherwise("deep")


def refined_hypotheses(hypotheses: Column, verified: Column) -> Column:
    return F.when(verified > 0.8, F.least(hypotheses, F.lit(2))).when(verified > 0.45, F.least(hypotheses, F.lit(3))).otherwise(hypotheses)


def captured_hypotheses(scene: Column, duration_ms: Column, factor: Column) -> Column:
    speed = measured_class(factor)
    guard = (duration_ms > 300_000) | (speed == "constrained") | ((speed == "moderate") & (duration_ms > 120_000))
    return F.when(scene == "clean_voice", 1).when(guard, 2).otherwise(3)


def hypothesis_score(words: Column, expected: Column, matched: Column, supported: Column, alignment: Column, base: Column, density: Column, run: Column) -> Column:
    """With a prompt: matches, boundaries, length and support; without: support and length.  Penalties for density and repetition."""
    close = F.greatest(F.lit(0.0), 1 - F.abs(words - expected) / expected)
    bounds = F.when(alignment == "strong", 1.0).when(alignment == "acceptable", 0.78).when(alignment == "review", 0.42).otherwise(0.0)
    extra = F.when(base, 0.12).otherwise(0.0) - F.when(density > 360, 1.5).otherwise(0.0) - F.when(run >= 4, 1.0).otherwise(0.0)
    return F.when(expected == 0, supported * 2.5 + F.least(words, F.lit(24)) / 80).otherwise(matched / expected * 4 + bounds * 1.6 + close * 0.8 + supported * 0.6) + extra


def processing_profile(duration_ms: Column, accelerated: Column) -> Column:
    return F.when((duration_ms > 600_000) | ~accelerated, "compatible").otherwise("enhanced")


def signal_evidence(duration_ms: Column, active: Column, words: Column) -> Column:
    speech = js_round_int(duration_ms * active)
    wpm = F.when(duration_ms > 0, js_round(words * 60000 / duration_ms, 1))
    return F.struct((active >= 0.1).alias("speech_detected"), speech.alias("speech_ms"), wpm.alias("words_per_minute"))


def alignment_record(forced: Column, match: Column, median_ms: Column, estimated: Column) -> Column:
    """Forced alignment first, then the local acoustic one, then rules, then none; with its confidence."""
    local = js_round(match * F.greatest(F.lit(0.0), 1 - median_ms / 500), 3)
    source = F.when(forced.isNotNull(), "forced").when(median_ms.isNotNull(), "local_acoustic").when(estimated.isNotNull(), "g2p").otherwise("absent")
    return F.struct(source.alias("source"), F.coalesce(forced, local, estimated).alias("confidence"))


def evidence(value: Column, status: Column, source: str, reason: Column | None = None) -> Column:
    return F.struct(value.alias("value"), status.alias("status"), F.lit(source).alias("source"), (reason if reason is not None else F.lit(None).cast("string")).alias("reason"))


def recognition_confidence(x: Column) -> Column:
    return F.when(finite(x).between(0, 1), x).otherwise(0.5)


def energy(x: Column) -> Column:
    return F.least(F.lit(1.0), F.pow(x / 255, 0.7))


def capture_duration(ms: Column) -> Column:
    return F.when(finite(ms) > 0, ms.cast("long")).otherwise(F.lit(120000).cast("long"))


def noise_floor(x: Column) -> Column:
    return clamp(F.coalesce(finite(x), F.lit(-60.0)), -78.0, -28.0)


def start_threshold(floor: Column) -> Column:
    return clamp(floor + 10, -50.0, -27.0)


def take_verdict(gates: Column) -> Column:
    """Of an array of statuses: any failure rejects, any review reviews."""
    return F.when(F.exists(gates, lambda g: g == "fail"), "reject").when(F.exists(gates, lambda g: g == "review"), "review").otherwise("pass")


def vocal_label(kind: Column) -> Column:
    return F.when(kind == "sung", "sung voice").when(kind == "sung_candidate", "possibly sung").when(kind == "spoken", "spoken voice").otherwise("undetermined")
