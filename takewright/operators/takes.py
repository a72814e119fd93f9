"""Takes as samples: joins to prompts, rights and audio, with derived columns, reports and a manifest."""

from __future__ import annotations

from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import finite, js_round
from . import rules
from .rules import MODES
from .statistics import duplicate_groups


def samples(takes: DataFrame, prompts: DataFrame, rights: DataFrame) -> DataFrame:
    """One row per take with its prompt and its speaker's rights.

    A take without prompt has the error that would abort an export; a speaker without rights has status unknown.  Files are named by
    digests, so that equal content is stored once.
    """
    p = prompts.select("prompt_id", "language", "scenario_id", F.col("text").alias("prompt_text"))
    x = takes.join(p, "prompt_id", "left").join(rights.select("speaker_id", F.col("status").alias("rights")), "speaker_id", "left")
    spoken = F.coalesce(F.nullif(F.trim("text"), F.lit("")), "prompt_text")
    digest = F.sha2(X.normalize_text(spoken), 256)
    return x.select(
        F.concat_ws("__", "session_id", "take_ord").alias("sample_id"), "session_id", "take_ord", "speaker_id", "prompt_id", "language", "scenario_id", X.locale(F.col("language")).alias("locale"), "rating", "duration_ms",
        rules.lifecycle(F.col("rating")).alias("lifecycle"), F.coalesce("rights", F.lit("unknown")).alias("rights"), digest.alias("text_sha256"), F.concat(F.lit("text/"), digest, F.lit(".json")).alias("text_path"),
        F.when(F.col("duration_ms") > 0, js_round(F.col("words") * 60000 / F.col("duration_ms"), 2)).alias("words_per_minute"), F.when(F.col("prompt_text").isNull(), "prompt missing").alias("error"),
    )


def rights_of(consents: DataFrame) -> DataFrame:
    """A speaker's first record, valid or not: granted, blocked or unknown."""
    first = consents.groupBy("speaker_id").agg(F.min_by(F.struct("status", "evidence"), "consent_id").alias("c"))
    ok = rules.valid_right(F.col("c.status"), F.col("c.evidence"))
    return first.select("speaker_id", F.when(ok, "resolved").when(F.col("c.status") == "unknown", "unknown").otherwise("blocked").alias("status"))


def manifest(rows: DataFrame) -> DataFrame:
    """One row: distinct counts, total duration, and whether anything blocks the package."""
    x = rows.agg(F.count("*").alias("samples"), F.countDistinct("speaker_id").alias("speakers"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("text_path").alias("texts"), F.sum("duration_ms").alias("duration_ms"), F.count("error").alias("errors"), F.count_if(F.col("rights") == "blocked").alias("blocked"))
    status = F.when((F.col("errors") > 0) | (F.col("blocked") > 0), "blocked").otherwise("ready")
    return x.withColumn("status", status)


def reports(rows: DataFrame) -> DataFrame:
    """Counts by verdict, lifecycle, language, locale and rights in one pass, long form."""
    names = ["rating", "lifecycle", "language", "locale", "rights"]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("report"), F.coalesce(F.col(n).cast("string"), F.lit("unknown")).alias("key")) for n in names)))
    return rows.select(pairs.alias("x")).groupBy("x.report", "x.key").agg(F.count("*").alias("n"))


def duplicate_texts(rows: DataFrame) -> DataFrame:
    return duplicate_groups(rows, F.col("text_sha256"), "sample_id")


def text_files(rows: DataFrame) -> DataFrame:
    """One file row for each distinct path."""
    x = rows.groupBy("text_path").agg(F.min("sample_id").alias("owner"), F.min("language").alias("language"))
    content = F.to_json(F.struct(F.col("owner").alias("sample"), "language"))
    return x.select(F.col("text_path").alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("byte_size"), F.sha2(content, 256).alias("sha256"), "owner")


def write_package(rows: DataFrame, path: str) -> None:
    """Index, texts, reports and manifest under a folder; the committer's success marker ends each part."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/samples")
    text_files(rows).write.json(f"{path}/texts")
    reports(rows).coalesce(1).write.json(f"{path}/reports")
    manifest(rows).coalesce(1).write.json(f"{path}/manifest")


#: The columns of a word timeline.
TIMELINE = ["index", "word", "start_ms", "end_ms", "duration_ms", "clip_start_ms", "clip_end_ms", "acoustic_support", "evidence", "confidence", "consensus_votes", "audio_path"]


def timeline_csv(clips: DataFrame) -> DataFrame:
    """(media_id, idx, line): the lines of a word timeline (TIMELINE) of clips with their evidence; words and paths alone are quoted."""
    cells = {"index": F.col("sequence"), "word": X.csv_cell(F.col("word")), "duration_ms": F.col("end_ms") - F.col("start_ms"), "audio_path": X.csv_cell(F.col("path"))}
    return clips.select("media_id", "idx", F.concat_ws(",", *(cells.get(c, F.col(c)).cast("string") for c in TIMELINE)).alias("line"))


def failed_verdict(gates: DataFrame) -> DataFrame:
    """Takes again judged from all of their gates."""
    from .analysis import take_verdict

    return gates.groupBy("take_id").agg(take_verdict(F.collect_list("status")).alias("verdict"))


#: The gates of a take, in order; and what each of them may say.
GATES = (
    "clipping", "capture_truncated", "signal_level", "headroom", "input_gain", "dc_offset", "speech_activity", "plosives", "mouth_noise", "reverb", "noise_floor", "snr", "duration", "transcript_match", "phoneme_alignment", "audio_present",
    "speech_detected", "vad_valid", "energy_valid", "noise_floor_valid", "prosody_valid", "estimated_alignment_valid", "phoneme_sequence_valid", "browser_asr_consistent", "corpus_consistent",
)
PASS, REVIEW, FAIL, OTHER = range(4)
STOPS = ("capture_truncated", "clipping", "headroom", "signal_level")
TEXTS = ("transcript_match", "browser_asr_consistent")
CLEAN = ("duration", "signal_level", "snr", "headroom", "dc_offset", "speech_activity", "plosives", "mouth_noise", "reverb", "noise_floor")
OPEN_TEXT = 1 << 2 * len(GATES)
LOST = OPEN_TEXT << 1


def _bits(level: int, *gates: str) -> int:
    return sum(level << 2 * GATES.index(g) for g in gates)


def room_tone_drift() -> Column:
    measured = F.coalesce("source_floor", "floor")
    return F.when(F.col("room_tone"), js_round(measured - F.coalesce(F.col("room_floor"), measured), 1))


def levels(mode: str = "training") -> Column:
    """What the gates of a measured take say, as one number of two bits a gate (PASS, REVIEW, FAIL, or OTHER: what ``transcript_status`` says), with OPEN_TEXT where its text is not told (and LOST, where what is stored says so later).

    A number goes where 25 texts would make code too long to be compiled, and is sent in place of all that is measured.
    Measured columns: peak, true_peak, lufs, rms, floor, snr, active, reverb, plosive, mouth, voiced, dc, clipping, sample_count, duration_ms; of the recording:
    truncated, gain_limit, source_floor, room_tone, room_floor; of the prompt: min_ms, max_ms; of the text: transcript_source, transcript_status, words, phonemes, aligned.
    """
    active, snr, room = MODES[mode]
    c = F.col
    number = lambda n: F.lit(n).cast("long")
    where = lambda bad, level, *gates: F.when(bad, number(_bits(level, *gates))).otherwise(number(0))
    unless = lambda good, level, *gates: F.when(good, number(0)).otherwise(number(_bits(level, *gates)))
    measured = F.coalesce("source_floor", "floor")
    quiet = c("room_tone") & ~F.coalesce(F.coalesce(c("room_floor"), measured) > room, F.lit(False)) & ~F.coalesce(room_tone_drift() > 6, F.lit(False))
    told = c("transcript_status")
    parts = [
        where(c("clipping"), FAIL, "clipping"), where(c("truncated"), FAIL, "capture_truncated"),
        F.when((c("peak") <= -55) | (c("lufs") <= -60), number(_bits(FAIL, "signal_level"))).otherwise(where((c("peak") < -34) | (c("lufs") < -42), REVIEW, "signal_level")),
        F.when(c("true_peak") >= -1, number(_bits(FAIL, "headroom"))).otherwise(where(c("true_peak") >= -3, REVIEW, "headroom")),
        where(c("gain_limit").isin("insufficient_signal", "clipping"), REVIEW, "input_gain"), where(F.abs("dc") > 0.02, REVIEW, "dc_offset"), where(c("active") < active, REVIEW, "speech_activity", "speech_detected", "vad_valid"),
        where(c("plosive") > 0.08, REVIEW, "plosives"), where(c("mouth") > 0.08, REVIEW, "mouth_noise"), where(c("reverb") > 0.65, REVIEW, "reverb"), unless(quiet, REVIEW, "noise_floor", "noise_floor_valid"), where(c("snr") < snr, REVIEW, "snr"),
        where((c("duration_ms") < c("min_ms")) | (c("duration_ms") > c("max_ms")), REVIEW, "duration"),
        F.when(told == "pass", number(0)).when(told == "review", number(_bits(REVIEW, *TEXTS))).when(told == "fail", number(_bits(FAIL, *TEXTS))).otherwise(number(_bits(OTHER, *TEXTS))),
        where(~c("aligned"), REVIEW, "phoneme_alignment"), where(c("sample_count") <= 0, FAIL, "audio_present"), where(finite("rms").isNull(), FAIL, "energy_valid"), unless(c("voiced") > 0, REVIEW, "prosody_valid"),
        where(c("words") <= 0, FAIL, "estimated_alignment_valid"), unless(c("phonemes") > 0, REVIEW, "phoneme_sequence_valid"), F.when((c("transcript_source") == "prompt_only") | (told == "pass"), number(0)).otherwise(number(OPEN_TEXT)),
    ]
    return reduce(Column.bitwiseOR, parts)


def _says(levels: Column, gate: int, words: Column, bits: int = 3) -> Column:
    return F.get(words, F.shiftright(levels, 2 * gate).bitwiseAND(F.lit(bits)).cast("int"))


def gates_of(levels: Column) -> Column:
    """The gates (id, status; 25 of them, in order) that ``levels`` tells, and what ``transcript_status`` says where it says neither; last LOST, if it is told."""
    words = F.array(F.lit("pass"), F.lit("review"), F.lit("fail"), F.col("transcript_status"))
    gates = F.arrays_zip(F.array(*map(F.lit, GATES)).alias("id"), F.array(*(_says(levels, i, words) for i in range(len(GATES)))).alias("status"))
    return F.when(levels < LOST, gates).when(levels >= LOST, F.array_append(gates, F.struct(F.lit("audio_persistence").alias("id"), F.lit("fail").alias("status"))))


def gates_text(levels: Column) -> Column:
    """``gates_of`` as id:status, joined by commas: up to three gates at once are looked up, by their six bits."""
    other = F.array(F.lit(":pass"), F.lit(":review"), F.lit(":fail"), F.coalesce(F.concat(F.lit(":"), "transcript_status"), F.lit("")))
    said, parts, first = ("pass", "review", "fail", ""), [], 0
    while first < len(GATES):
        comma = "," if first else ""
        if GATES[first] in TEXTS:
            parts += [F.lit(comma + GATES[first]), _says(levels, first, other)]
            first += 1
            continue
        run = list(takewhile(lambda g: g not in TEXTS, GATES[first : first + 3]))
        texts = [comma + ",".join(f"{g}:{said[n >> 2 * i & 3]}" for i, g in enumerate(run)) for n in range(4 ** len(run))]
        parts.append(_says(levels, first, F.array(*map(F.lit, texts)), 4 ** len(run) - 1))
        first += len(run)
    return F.concat(*parts, F.when(levels < LOST, "").when(levels >= LOST, ",audio_persistence:fail"))


def told_by(levels: Column) -> dict[str, Column]:
    """``verdict``, ``rating`` and ``best`` by ``levels``, and ``room_tone_drift``.

    The verdict is not that of all gates: those that judge the evidence, such as alignment, do not hold a take back.
    """
    said = lambda bits: levels.bitwiseAND(F.lit(bits).cast("long")) != 0
    stopped, held = said(_bits(FAIL, *STOPS)), said(_bits(OTHER, *CLEAN) | OPEN_TEXT)
    tell = lambda reject, review, clean: F.when(stopped, reject).when(held, review).otherwise(clean)
    return {"verdict": tell("reject", "review", "pass"), "rating": tell("reject", "maybe", "keeper"), "best": ~stopped & ~held, "room_tone_drift": room_tone_drift()}


def recorded(takes: DataFrame, mode: str = "training") -> DataFrame:
    """``takes`` with their ``levels``, ``gates`` and what ``told_by`` tells of them."""
    own = F.col("levels")
    return takes.withColumn("levels", levels(mode)).withColumns({"gates": gates_of(own), **told_by(own)})
