"""Queries of samples, packages, evidence and the remaining rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import analysis as A
from ..operators import corpus, package, rules, takes
from .base import Tables, query
from .scalar import DOC, LINE, NEIGHBOURS, TOKENS, WORDS, js

EVENT = ("events", ["event_id"])
TAKE = ("takes", ["session_id", "take_ord"])
SCENE = "CASE WHEN (reverb >= 0.07 AND active >= 0.08) OR (active - dc >= 0.16 AND active >= 0.18) THEN 'music_mix' WHEN dc < 0.012 THEN 'constrained_voice' ELSE 'uncertain' END"
CLASS = "CASE WHEN value / 100 <= 0.35 THEN 'fast' WHEN value / 100 <= 0.8 THEN 'moderate' ELSE 'constrained' END"

ROWS: list[tuple[str, tuple[str, list[str]], Callable[[], Column], str]] = [
    ("a03_prompt_minimum", DOC, lambda: corpus.canonical_bounds(X.count_words("text"))[0], f"CAST(greatest(1500, 230 * len({TOKENS})) AS BIGINT)"),
    ("a03_prompt_maximum", DOC, lambda: corpus.canonical_bounds(X.count_words("text"))[1], f"CAST(greatest(6500, 740 * len({TOKENS})) AS BIGINT)"),
    ("q02_prompt_minimum", DOC, lambda: corpus.prompt_defaults(X.count_words("text"))[0], f"CAST(greatest(900, floor(260 * len({TOKENS}) + 0.5)) AS BIGINT)"),
    ("q02_prompt_difficulty", DOC, lambda: corpus.prompt_defaults(X.count_words("text"))[2], f"CASE WHEN len({TOKENS}) > 26 THEN 'high' WHEN len({TOKENS}) > 14 THEN 'medium' ELSE 'low' END"),
    ("q04_smile", ("prompts", ["prompt_id"]), lambda: corpus.infer_smile(F.array("intent", F.when(F.col("prompt_id") % 4 == 0, "smile"))), "CASE WHEN prompt_id % 4 = 0 THEN 'slight' ELSE 'none' END"),
    ("q05_pause_style", ("prompts", ["prompt_id"]), lambda: corpus.infer_pause_style(F.col("pace"), F.col("text")), "CASE WHEN pace IN ('fast', 'medium_fast') THEN 'urgent' WHEN contains(lower(text), 'pause') THEN 'thoughtful' ELSE 'structured' END"),
    ("q06_pitch", ("prompts", ["prompt_id"]), lambda: corpus.infer_pitch(F.col("energy")), "CASE energy WHEN 'high' THEN 'slightly_lifted' WHEN 'low' THEN 'lower_stable' ELSE 'natural' END"),
    ("q07_pitch_variation", ("prompts", ["prompt_id"]), lambda: corpus.infer_pitch_variation(F.col("intent")), "CASE WHEN regexp_matches(intent, 'thinking|question|surprise|narrative') THEN 'medium' ELSE 'low' END"),
    ("q08_attack", ("prompts", ["prompt_id"]), lambda: corpus.infer_attack(F.col("intent")), "CASE WHEN regexp_matches(intent, 'thinking|narrative') THEN 'soft' ELSE 'clean' END"),
    ("b03_words_per_minute", TAKE, lambda: F.when(F.col("duration_ms") > 0, N.js_round(F.col("words") * 60000 / F.col("duration_ms"), 2)), "CASE WHEN duration_ms > 0 THEN " + js("words * 60000 / CAST(duration_ms AS DOUBLE)", 2) + " END"),
    ("b05_sentences", DOC, lambda: F.size(F.split(F.trim("text"), r"(?<=[.!?])\s+")).cast("long"), r"CAST(len(regexp_extract_all(trim(text), '[.!?]\s+')) + 1 AS BIGINT)"),
    ("b06_signal_evidence", LINE, lambda: A.signal_evidence(F.col("duration_ms"), F.col("active"), F.lit(10))["speech_ms"], "CAST(floor(duration_ms * active * 1.0 + 0.5) AS BIGINT)"),
    ("b10_alignment_confidence", LINE, lambda: A.alignment_record(F.when(F.col("clipping"), 0.9), F.col("active"), F.abs("peak") * 12, F.lit(0.4))["confidence"], "coalesce(CASE WHEN clipping THEN 0.9 END, " + js("active * greatest(0.0, 1 - abs(peak) * 12 / 500)", 3) + ")"),
    ("c18_words_compatible", NEIGHBOURS, lambda: F.coalesce(rules.words_compatible(F.col("a"), F.col("b")), F.lit(False)), "CASE WHEN a = b AND a <> '' THEN true WHEN least(length(a), length(b)) >= 4 AND abs(length(a) - length(b)) <= 2 THEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= CASE WHEN greatest(length(a), length(b)) <= 5 THEN 0.8 ELSE 0.72 END ELSE false END"),
    ("c20_media_limits", DOC, lambda: rules.media_limits(F.col("n_chars") * 50000, F.col("n_chars") * 90), "n_chars * 50000 <= 200000000 AND n_chars * 90 <= 600000"),
    ("e46_crc32", DOC, lambda: F.crc32("text"), ""),
    ("e44_browser", ("pages", ["page_id"]), lambda: X.browser_runtime(F.concat(F.lit("Mozilla/5.0 Chrome/"), F.col("page_id"), F.lit(".1 Safari/537 Edg/9.5")))["name"], "'Edge'"),
    ("e35_embed_url", ("pages", ["page_id"]), lambda: X.youtube_embed(F.lit("abcdefghijk"), F.col("page_id") % 5, F.col("page_id") % 7), "'https://www.youtube-nocookie.com/embed/abcdefghijk?autoplay=0&controls=1&mute=0&playsinline=1&rel=0' || CASE WHEN page_id % 5 > 0 THEN '&start=' || page_id % 5 ELSE '' END || CASE WHEN page_id % 7 > page_id % 5 THEN '&end=' || page_id % 7 ELSE '' END"),
    ("k03_source_weight", LINE, lambda: rules.source_weight(F.when(F.col("clipping"), "acoustic").otherwise("estimated"), F.col("active")), js("CASE WHEN clipping THEN 1.0 ELSE 0.2 END * active", 3)),
    ("k08_fused_confidence", LINE, lambda: N.js_round(F.col("active") * (0.85 + 0.15 * F.col("reverb")), 3), js("active * (0.85 + 0.15 * reverb)", 3)),
    ("m04_transcript_gate", LINE, lambda: rules.transcript_status(F.lit("web_speech"), F.col("active"), F.col("clipping")), "CASE WHEN active < 0.75 THEN CASE WHEN clipping THEN 'review' ELSE 'fail' END WHEN active < 0.92 THEN 'review' ELSE 'pass' END"),
    ("m06_prosody_score", LINE, lambda: rules.prosody_score(F.abs("peak") / 10, F.abs("lufs") / 3), js("(least(1.0, abs(peak) / 10 / 4) + least(1.0, abs(lufs) / 3 / 12)) / 2", 2)),
    ("m17_imported_scene", LINE, lambda: A.imported_scene(F.lit("review"), F.col("dc") * 10, F.col("active"), F.col("reverb"), F.lit(False)), "CASE WHEN (reverb >= 0.07 AND active >= 0.08) OR (active - dc * 10 >= 0.16 AND active >= 0.18) THEN 'music_mix' WHEN dc * 10 < 0.12 THEN 'constrained_voice' WHEN dc * 10 >= 0.18 AND reverb < 0.035 THEN 'clean_voice' ELSE 'uncertain' END"),
    ("m18_escalates", LINE, lambda: rules.escalates(F.col("duration_ms") % 3, F.when(F.col("clipping"), "clean_voice").otherwise("uncertain"), F.lit(5), F.lit(10), F.col("take_ord") + 5, F.lit("strong")), "CASE WHEN duration_ms % 3 = 0 THEN false WHEN NOT clipping THEN true ELSE (take_ord + 5) / 10 < 0.9 END"),
    ("m19_imported_plan", EVENT, lambda: A.imported_hypotheses(F.col("event_type"), F.col("value").cast("long") * 1000, F.lit("enhanced"), F.col("value") / 100).cast("long"), f"CAST(CASE WHEN CAST(trunc(value) AS BIGINT) * 1000 > 300000 THEN 1 WHEN {CLASS} = 'constrained' THEN 2 WHEN CAST(trunc(value) AS BIGINT) * 1000 > 180000 THEN 2 ELSE 3 END AS BIGINT)"),
    ("m20_refined_plan", EVENT, lambda: A.refined_hypotheses(F.lit(4), F.col("value") / 100).cast("long"), "CAST(CASE WHEN value / 100 > 0.8 THEN 2 WHEN value / 100 > 0.45 THEN 3 ELSE 4 END AS BIGINT)"),
    ("m23_captured_budget", EVENT, lambda: A.captured_hypotheses(F.lit("uncertain"), F.col("value").cast("long") * 2000, F.col("value") / 100).cast("long"), f"CAST(CASE WHEN CAST(trunc(value) AS BIGINT) * 2000 > 300000 OR {CLASS} = 'constrained' OR ({CLASS} = 'moderate' AND CAST(trunc(value) AS BIGINT) * 2000 > 120000) THEN 2 ELSE 3 END AS BIGINT)"),
    ("m22_hypothesis_score", LINE, lambda: N.js_round(A.hypothesis_score(F.col("take_ord") + 3, F.lit(8), F.col("take_ord"), F.col("active"), F.lit("acceptable"), F.col("clipping"), F.lit(0), F.lit(0)), 6), js("take_ord / 8 * 4 + 0.78 * 1.6 + greatest(0.0, 1 - abs(take_ord + 3 - 8) / 8) * 0.8 + active * 0.6 + CASE WHEN clipping THEN 0.12 ELSE 0.0 END", 6)),
    ("m24_processing_profile", DOC, lambda: A.processing_profile(F.col("n_chars") * 90, F.col("doc_id") % 2 == 0), "CASE WHEN n_chars * 90 > 600000 OR doc_id % 2 <> 0 THEN 'compatible' ELSE 'enhanced' END"),
    ("m26_token_confidence", WORDS, lambda: rules.token_confidence(X.ascii_word("word"), F.lit(False)), "floor(greatest(0.45, 0.82 - CASE WHEN regexp_matches(w, '[0-9]') THEN 0.14 ELSE 0.0 END - CASE WHEN length(w) <= 2 THEN 0.03 ELSE 0.0 END) * 100.0 + 0.5) / 100.0"),
    ("m28_pause_weight", DOC, lambda: rules.pause_weight(F.substring("text", 5, 4)), "CASE WHEN regexp_matches(text[5:8], '[.!?]') THEN 0.9 WHEN regexp_matches(text[5:8], '[,;:]') THEN 0.42 ELSE 0.0 END"),
    ("m08_room_tone_limit", LINE, lambda: F.col("floor") > rules.MODES["dubbing"][2], "floor > -46"),
    ("q38_round_score", LINE, lambda: N.score("reverb"), js("least(greatest(reverb, 0.0), 1.0)", 2)),
    ("q44_ratio", TAKE, lambda: N.ratio(F.col("take_ord"), F.col("words")), "CASE WHEN words > 0 THEN take_ord / CAST(words AS DOUBLE) ELSE 0.0 END"),
    ("q47_realtime_factor", EVENT, lambda: rules.realtime_factor(F.col("value"), F.lit(100.0)), "CASE WHEN " + js("value / 100.0", 3) + " > 0 THEN " + js("value / 100.0", 3) + " END"),
    ("q48_slower_class", EVENT, lambda: rules.slower_class(rules.runtime_class(F.col("value") / 100), F.lit("moderate")), f"CASE WHEN {CLASS} = 'constrained' THEN 'constrained' ELSE 'moderate' END"),
    ("q65_decibels_to_linear", LINE, lambda: N.js_round(N.decibels_to_linear("peak"), 8), js("power(10.0, peak / 20)", 8)),
    ("q66_linear_to_decibels", LINE, lambda: N.js_round(N.linear_to_decibels("active"), 6), js("20 * log10(greatest(active, 2.220446049250313e-16))", 6)),
    ("q69_capture_duration", TAKE, lambda: A.capture_duration(F.col("duration_ms")), "CASE WHEN duration_ms > 0 THEN duration_ms ELSE 120000 END"),
    ("q73_start_threshold", LINE, lambda: A.start_threshold(F.col("floor")), "least(greatest(floor + 10, -50.0), -27.0)"),
    ("q74_noise_floor", LINE, lambda: A.noise_floor(F.col("floor")), "least(greatest(floor, -78.0), -28.0)"),
    ("q76_vocal_label", LINE, lambda: A.vocal_label(F.when(F.col("clipping"), "sung").otherwise("spoken")), "CASE WHEN clipping THEN 'sung voice' ELSE 'spoken voice' END"),
    ("q79_corpus_key", DOC, lambda: F.concat_ws("@", "source", "lang"), "source || '@' || lang"),
    ("q94_energy", EVENT, lambda: N.js_round(A.energy(F.col("value")), 6), js("least(1.0, power(value / 255, 0.7))", 6)),
    ("q99_recognition_confidence", EVENT, lambda: A.recognition_confidence(F.col("value") / 50), "CASE WHEN value / 50 BETWEEN 0 AND 1 THEN value / 50 ELSE 0.5 END"),
    ("o10_clamped_profile", LINE, lambda: N.bounded_int("floor", -120, -65), "CAST(least(greatest(floor(floor * 1.0 + 0.5), -120), -65) AS BIGINT)"),
    ("q45_word_count", DOC, lambda: F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0))).cast("long"), r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) AS BIGINT)"),
]
_PRELUDE = {
    "m26_token_confidence": "(SELECT media_id, idx, regexp_replace(lower(strip_accents(word)), '[^a-z0-9]', '', 'g') AS w FROM word_timings)",
}


def _register(name: str, where: tuple[str, list[str]], make: Callable[[], Column], sql: str) -> None:
    table, keys = where

    @query(name, f"SELECT {', '.join(keys)}, {sql} AS value FROM {_PRELUDE.get(name, table)}" if sql else None)
    def run(t: Tables) -> DataFrame:
        return getattr(t, table).select(*keys, make().alias("value"))


for _row in ROWS:
    _register(*_row)


def _samples(t: Tables) -> DataFrame:
    return takes.samples(t.takes, t.prompts, takes.rights_of(t.consents))


SAMPLES = """(SELECT t.session_id || '__' || t.take_ord AS sample_id, t.session_id, t.take_ord, t.speaker_id, t.rating, t.duration_ms, p.language,
  CASE t.rating WHEN 'keeper' THEN 'training_candidate' WHEN 'maybe' THEN 'needs_review' WHEN 'reject' THEN 'rejected' ELSE 'captured' END AS lifecycle,
  CASE WHEN p.language = 'fr' THEN 'fr-FR' ELSE 'en-US' END AS locale,
  CASE WHEN r.status = 'granted' AND r.evidence IS NOT NULL THEN 'resolved' WHEN r.status IS NULL OR r.status = 'unknown' THEN 'unknown' ELSE 'blocked' END AS rights,
  sha256(lower(regexp_replace(trim(CASE WHEN trim(t.text) = '' THEN p.text ELSE t.text END), '\\s+', ' ', 'g'))) AS text_sha256
  FROM takes t LEFT JOIN prompts p ON t.prompt_id = p.prompt_id LEFT JOIN (SELECT speaker_id, arg_min(status, consent_id) AS status, first(evidence ORDER BY consent_id) AS evidence FROM consents GROUP BY speaker_id) r ON t.speaker_id = r.speaker_id)""".replace("\\\\", "\\")


@query("a26_package_samples", f"SELECT sample_id, speaker_id, language, locale, lifecycle, rights, text_sha256 FROM {SAMPLES}")
def package_samples(t: Tables) -> DataFrame:
    return _samples(t).select("sample_id", "speaker_id", "language", "locale", "lifecycle", "rights", "text_sha256")


@query("a26_package_manifest", f"SELECT count(*) AS samples, count(DISTINCT speaker_id) AS speakers, count(DISTINCT session_id) AS sessions, count(DISTINCT text_sha256) AS texts, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (language IS NULL) AS errors, count(*) FILTER (rights = 'blocked') AS blocked, CASE WHEN count(*) FILTER (language IS NULL OR rights = 'blocked') > 0 THEN 'blocked' ELSE 'ready' END AS status FROM {SAMPLES}")
def package_manifest(t: Tables) -> DataFrame:
    return takes.manifest(_samples(t))


@query("g05_package_reports", "WITH s AS (SELECT * FROM " + SAMPLES + ") " + " UNION ALL ".join(f"SELECT '{n}' AS report, coalesce({n}, 'unknown') AS key, count(*) AS n FROM s GROUP BY 2" for n in ("rating", "lifecycle", "language", "locale", "rights")))
def package_reports(t: Tables) -> DataFrame:
    return takes.reports(_samples(t))


@query("a33_text_files_once", f"SELECT 'text/' || text_sha256 || '.json' AS path, min(sample_id) AS owner FROM {SAMPLES} GROUP BY text_sha256")
def text_files_once(t: Tables) -> DataFrame:
    return takes.text_files(_samples(t)).select("path", "owner")


@query(
    "a22_timeline_csv",
    r"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, idx) AS n FROM word_timings)
    SELECT media_id, idx, concat_ws(',', n, '"' || replace(word, '"', '""') || '"', start_ms, end_ms, end_ms - start_ms, greatest(0, start_ms - 60), end_ms + 60, (idx % 4 + 1) / 8.0::DOUBLE, 'speech_vad', (idx % 3 + 1) / 4.0::DOUBLE, idx % 3,
      '"words/' || lpad(CAST(n AS VARCHAR), 4, '0') || '-' || coalesce(nullif(substring(regexp_replace(regexp_replace(lower(strip_accents(word)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'word') || '.wav"') AS line FROM x""",
)
def timeline_csv(t: Tables) -> DataFrame:
    from ..operators.intervals import word_clips

    clips = word_clips(t.word_timings, F.lit(1 << 40), keep=["idx", "start_ms", "end_ms"])
    i = F.col("idx")
    return takes.timeline_csv(clips.withColumns({"acoustic_support": (i % 4 + 1) / 8.0, "evidence": F.lit("speech_vad"), "confidence": (i % 3 + 1) / 4.0, "consensus_votes": i % 3}))


@query("b17_reapplied_verdict", "SELECT take_id, CASE WHEN bool_or(status = 'fail') THEN 'reject' WHEN bool_or(status = 'review') THEN 'review' ELSE 'pass' END AS verdict FROM gates GROUP BY take_id")
def reapplied_verdict(t: Tables) -> DataFrame:
    return takes.failed_verdict(t.gates)


@query("b09_capture_context", "SELECT session_id, arg_min(rating, take_ord) FILTER (rating <> 'unreviewed') AS context FROM takes GROUP BY session_id")
def capture_context(t: Tables) -> DataFrame:
    known = F.when(F.col("rating") != "unreviewed", F.col("rating"))
    return t.takes.groupBy("session_id").agg(F.min_by(known, F.when(known.isNotNull(), F.col("take_ord"))).alias("context"))


@query("d21_full_reconciliation", "SELECT coalesce(t.prompt_id, p.prompt_id) AS prompt_id, p.prompt_id IS NULL AS unknown, t.prompt_id IS NULL AS unused FROM (SELECT DISTINCT prompt_id FROM takes) t FULL JOIN (SELECT prompt_id FROM prompts WHERE language <> 'de') p ON t.prompt_id = p.prompt_id")
def full_reconciliation(t: Tables) -> DataFrame:
    a = t.takes.select("prompt_id", F.lit(True).alias("a")).distinct()
    b = t.prompts.where("language <> 'de'").select("prompt_id", F.lit(True).alias("b"))
    return a.join(b, "prompt_id", "full").select("prompt_id", F.col("b").isNull().alias("unknown"), F.col("a").isNull().alias("unused"))


@query("o06_artifacts", "SELECT path, 'provenance' AS type, byte_size, sha256 FROM files")
def artifacts(t: Tables) -> DataFrame:
    return package.artifacts(t.files.select("path", F.col("text").alias("content"))).select("path", "type", "byte_size", "sha256")


@query("o03_parse_checksums", "SELECT sha256, path FROM files")
def parse_checksums(t: Tables) -> DataFrame:
    return package.parse_checksums(package.checksum_lines(t.files)).where("error is null").select("sha256", "path")


@query("o05_json_lines", "SELECT doc_id, source FROM documents")
def json_lines(t: Tables) -> DataFrame:
    lines = package.json_lines(t.documents.select("doc_id", "source"))
    return lines.select(F.from_json("line", "doc_id long, source string").alias("x")).select("x.*")


@query("o04_unique_ids", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def unique_ids(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).where("n > 1")


ANCHORED = "SELECT media_id, idx, start_ms - start_ms % 500 AS source_ms, CAST(start_ms + idx * 3 - idx % 7 * 400 AS BIGINT) AS target_ms FROM word_timings"


@query("i14_time_anchors", f"SELECT media_id, source_ms, target_ms FROM (SELECT *, row_number() OVER (PARTITION BY media_id, source_ms ORDER BY idx) AS n FROM ({ANCHORED})) WHERE n = 1")
def time_anchors(t: Tables) -> DataFrame:
    """Estimates that repeat, with heard times that rise, fall and repeat."""
    from ..operators.intervals import increasing_anchors

    source, target = F.col("start_ms") - F.col("start_ms") % 500, F.col("start_ms") + F.col("idx") * 3 - F.col("idx") % 7 * 400
    x = t.word_timings.select("media_id", "idx", source.alias("source_ms"), target.alias("target_ms"))
    return increasing_anchors(x, order="idx").select("media_id", "source_ms", "target_ms")


@query("i11_rescaled_words", "SELECT media_id, idx, CAST(floor(1000 + start_ms / CAST(greatest(whole, 1) AS DOUBLE) * 5000 + 0.5) AS BIGINT) AS start_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY media_id) AS whole FROM word_timings)")
def rescaled_words(t: Tables) -> DataFrame:
    from ..operators.intervals import scale_boundary

    x = t.word_timings.withColumn("whole", F.max("end_ms").over(Window.partitionBy("media_id")))
    return x.select("media_id", "idx", scale_boundary(F.col("start_ms"), F.col("whole"), F.lit(1000), F.lit(6000)).alias("start_ms"))


@query("i22_closed_boundary", "SELECT media_id, idx, CASE WHEN idx = max(idx) OVER (PARTITION BY media_id) THEN 999999999 ELSE end_ms END AS end_ms FROM word_timings")
def closed_boundary(t: Tables) -> DataFrame:
    last = F.max("idx").over(Window.partitionBy("media_id"))
    return t.word_timings.select("media_id", "idx", F.when(F.col("idx") == last, F.lit(999999999).cast("long")).otherwise(F.col("end_ms")).alias("end_ms"))


@query("i23_unordered_intervals", "SELECT media_id, idx FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY idx) AS before FROM (SELECT media_id, idx, start_ms, end_ms + idx % 5 * 10 AS end_ms FROM word_timings)) WHERE start_ms < before")
def unordered_intervals(t: Tables) -> DataFrame:
    x = t.word_timings.withColumn("end_ms", F.col("end_ms") + F.col("idx") % 5 * 10)
    x = x.withColumn("before", F.lag("end_ms").over(Window.partitionBy("media_id").orderBy("idx")))
    return x.where("start_ms < before").select("media_id", "idx")


@query("h19_flatten_distinct", "SELECT language, array_to_string(list_sort(list_distinct(flatten(list([pace, energy])))), ',') AS labels FROM prompts GROUP BY language")
def flatten_distinct(t: Tables) -> DataFrame:
    x = t.prompts.groupBy("language").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("pace", "energy"))))).alias("l"))
    return x.select("language", F.array_join("l", ",").alias("labels"))


@query("h02_priority_score", "SELECT prompt_id, (CASE WHEN intent IN ('calm', 'soft') THEN 0 ELSE 42 END + CASE WHEN pace = 'slow' THEN 0 ELSE 24 END + CASE WHEN energy = 'low' THEN 0 ELSE 16 END) AS score FROM prompts")
def priority_score(t: Tables) -> DataFrame:
    from ..operators.planning import WEIGHTS

    covered = {"intent": ["calm", "soft"], "pace": ["slow"], "energy": ["low"]}
    return t.prompts.select("prompt_id", sum(F.when(F.col(f).isin(v), 0).otherwise(WEIGHTS[f]) for f, v in covered.items()).alias("score"))


@query(
    "f12_bias_phrases",
    rf"""WITH w AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {TOKENS} AS ws FROM documents)))
    SELECT doc_id, phrase, CAST(max(boost) AS DOUBLE) AS boost FROM (SELECT doc_id, w AS phrase, 3.2 AS boost FROM w WHERE length(w) >= 5 UNION ALL SELECT doc_id, w || ' ' || next, 2.4 FROM w WHERE next IS NOT NULL) GROUP BY doc_id, phrase""",
)
def bias_phrases(t: Tables) -> DataFrame:
    ws = X.tokens_by_space("text")
    texts = t.documents.select("doc_id", "text").repartition(3 * int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # phrases are counted where their text is
    x = texts.select("doc_id", F.explode(F.zip_with(ws, F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))), lambda w, n: F.struct(w.alias("w"), n.alias("next")))).alias("x")).select("doc_id", "x.*")
    single = x.where(F.length("w") >= 5).select("doc_id", F.col("w").alias("phrase"), F.lit(3.2).alias("boost"))
    pairs = x.where("next is not null").select("doc_id", F.concat_ws(" ", "w", "next").alias("phrase"), F.lit(2.4).alias("boost"))
    return single.unionByName(pairs).groupBy("doc_id", "phrase").agg(F.max("boost").alias("boost"))


@query("f01_script_segments")
def script_segments(t: Tables) -> DataFrame:
    return corpus.segments(t.documents.select("doc_id", "text", F.lit("script.txt").alias("source_name")), "doc_id")


@query("f15_whisper_timings", "SELECT media_id, idx, greatest(start_ms, coalesce(lag(told) OVER (PARTITION BY media_id ORDER BY idx), 0)) AS start_ms, told AS end_ms FROM (SELECT *, end_ms + idx % 3 * 20 AS told FROM word_timings)")
def whisper_timings(t: Tables) -> DataFrame:
    """Chunks in seconds, some of which begin before the one before them ends."""
    from ..operators.intervals import accepted_chunks

    x = t.word_timings.select("media_id", "idx", (F.col("start_ms") / 1000).alias("start_s"), ((F.col("end_ms") + F.col("idx") % 3 * 20) / 1000).alias("end_s"))
    return accepted_chunks(x)

