"""Gates as evidence: where each comes from, how sure it is, and what a take's gates say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import js_round, js_round_int

#: Gates by the source of their evidence; all others come from audio analysis.
SOURCES = {
    "browser_asr": ["browser_asr_consistent", "transcript_match"], "corpus": ["corpus_consistent"], "audio_signal": ["audio_present"],
    "evidence_fusion": ["estimated_alignment_valid"], "g2p": ["phoneme_alignment", "phoneme_sequence_valid"], "energy_vad": ["vad_valid", "speech_detected", "speech_activity"],
}
#: Confidence by source; that of a recogniser is unknown.
CONFIDENCE = {"corpus": 1.0, "energy_vad": 0.72, "g2p": 0.82, "evidence_fusion": 0.8, "audio_signal": 0.9, "audio_analysis": 0.9}


def source(gate: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, gates in SOURCES.items():
        out = out.when(gate.isin(gates), name)
    return out.otherwise("audio_analysis")


def confidence(gate: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in CONFIDENCE.items():
        out = out.when(source(gate) == name, value)
    return out


def enrich(gates: DataFrame) -> DataFrame:
    return gates.withColumn("source", source(F.col("gate_id"))).withColumn("confidence", confidence(F.col("gate_id")))


def transcript_message(origin: Column, score: Column, sung: Column) -> Column:
    """A key for what the transcript gate says, and the per cent it names."""
    key = F.when(origin == "prompt_only", "no_reliable_transcript").when(score >= 0.92, "aligned").when(score >= 0.75, "to_reread").when(sung, "sung_unconfirmed").otherwise("incompatible")
    return F.concat_ws(":", key, F.when(key != "no_reliable_transcript", js_round_int(score * 100)))


def reject_unsaved(gates: DataFrame, saved: DataFrame) -> DataFrame:
    """A failed persistence gate for each take that was not saved."""
    missing = gates.select("take_id").distinct().join(saved, "take_id", "left_anti")
    rows = missing.select("take_id", F.lit(10_000).cast("long").alias("ord"), F.lit("audio_persistence").alias("gate_id"), F.lit("fail").alias("status"))
    return gates.select("take_id", "ord", "gate_id", "status").unionByName(rows)


def local_confidence(match: Column, median_ms: Column) -> Column:
    return js_round(match * F.greatest(F.lit(0.0), 1 - median_ms / 500), 3)


def alternative_score(precision: Column, coverage: Column, confidence: Column) -> Column:
    return precision * 0.68 + coverage * 0.27 + confidence * 0.05
