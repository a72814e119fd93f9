"""Queries of whole sample rows, their split groups and the splits made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules, splits
from .base import Tables, query

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
LINKED = ("session", "prompt")


def rows(t: Tables) -> DataFrame:
    """Takes as samples: recordings by digest (some are missing), three devices and a nameless one, a corpus for each source."""
    s, o = F.col("session_id"), F.col("take_ord")
    verdict = F.when((s + o) % 3 == 0, "review").otherwise("pass")
    aligned = F.when(o % 2 == 0, "estimated_g2p").otherwise("forced")
    takes = t.takes.withColumns({
        "dataset_id": F.lit("voices"), "project_id": F.concat(F.lit("project-"), s % 5), "observed": F.when(F.col("role") == "user", F.col("text")), "verdict": verdict, "alignment": aligned, "declared_ms": F.col("duration_ms") + o,
        "audio_sha256": F.when((s + o) % 17 != 0, F.sha2(F.concat_ws(":", s, o), 256)), "byte_size": F.col("duration_ms") * 144 + 44, "observed_settings": F.when(s % 4 != 0, F.concat(F.lit("gain-"), s % 4)), "room_tone": F.when(s % 2 == 0, F.lit("quiet")),
        "device": F.when(s % 4 != 3, F.concat(F.lit("device-"), s % 4)), "recorded_at": F.concat(F.lit("2024-05-"), F.lpad((s % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")),
    })
    i = F.col("prompt_id")
    prompts = t.prompts.select("prompt_id", "text", "language", F.col("scenario_id").alias("corpus_id"), F.lit("1").alias("corpus_version"), F.concat(F.lit("license-"), "scenario_id").alias("license_id"), "intent", F.col("pace").alias("tone"), "energy", (i % 11 / 10).alias("valence"), (i % 7 / 10).alias("arousal"), (i % 3 / 10).alias("dominance"))
    first = t.consents.groupBy("speaker_id").agg(F.min("consent_id").alias("consent_id"), F.min_by(F.struct("status", "evidence"), "consent_id").alias("c"))
    return splits.sample_rows(takes, prompts, first.select("speaker_id", "consent_id", rules.valid_right(F.col("c.status"), F.col("c.evidence")).alias("granted")))


X = r"""(SELECT t.session_id, t.take_ord, t.speaker_id, t.prompt_id, t.rating, t.duration_ms, t.role, t.text AS heard, p.prompt_id IS NOT NULL AS known, p.text AS expected, p.language, p.scenario_id AS corpus, p.intent, p.pace, p.energy, c.consent_id, coalesce(c.granted, false) AS granted,
  lower(regexp_replace(trim(CASE WHEN trim(coalesce(t.text, '')) = '' THEN coalesce(p.text, '') ELSE t.text END), '\s+', ' ', 'g')) AS normalized, CASE WHEN (t.session_id + t.take_ord) % 17 <> 0 THEN sha256(t.session_id || ':' || t.take_ord) END AS sha,
  CASE WHEN (t.session_id + t.take_ord) % 3 = 0 THEN 'review' ELSE 'pass' END AS verdict FROM takes t LEFT JOIN prompts p ON t.prompt_id = p.prompt_id
  LEFT JOIN (SELECT speaker_id, min(consent_id) AS consent_id, coalesce(first(status ORDER BY consent_id) = 'granted' AND first(evidence ORDER BY consent_id) IS NOT NULL, false) AS granted FROM consents GROUP BY speaker_id) c ON t.speaker_id = c.speaker_id)"""


@query("b11_sample_rows", f"""SELECT session_id || '-' || take_ord AS take_id, 'audio_' || sha AS audio_id, 'audio/audio_' || sha || '.wav' AS audio_path, duration_ms, duration_ms + take_ord AS declared_ms, duration_ms * 144 + 44 AS byte_size, normalized, CASE WHEN role = 'user' THEN heard END AS observed, language,
    CASE WHEN language = 'fr' THEN 'fr-FR' WHEN language IS NOT NULL THEN 'en-US' END AS locale, sha256(expected) AS source_hash, sha256(normalized) AS normalized_hash, 'corpus:' || corpus || '@1#prompt:' || prompt_id AS provenance_ref, 'license-' || corpus AS license_ref, intent, pace AS style, energy AS intensity,
    CASE WHEN known THEN prompt_id % 11 / 10 END AS valence, 'alignment/' || session_id || '-' || take_ord || '.json' AS alignment_path, verdict, coalesce(CAST(consent_id AS VARCHAR), '') AS consents,
    CASE rating WHEN 'keeper' THEN 'training_candidate' WHEN 'maybe' THEN 'needs_review' WHEN 'reject' THEN 'rejected' ELSE 'captured' END AS lifecycle,
    CASE rating WHEN 'reject' THEN 'legacy_rejected_rating' WHEN 'maybe' THEN 'legacy_maybe_rating' WHEN 'unreviewed' THEN 'not_reviewed' ELSE array_to_string(list_filter([CASE WHEN take_ord % 2 = 0 THEN 'alignment_is_estimated' END, CASE WHEN NOT granted THEN 'rights_not_granted' END, CASE WHEN verdict <> 'pass' THEN 'quality_requires_review' END], lambda r: r IS NOT NULL), ',') END AS reasons,
    rating <> 'reject' AND (rating <> 'keeper' OR take_ord % 2 = 0 OR NOT granted OR verdict <> 'pass') AS review_required, array_to_string(list_filter([CASE WHEN language IS NULL THEN 'prompt' END, CASE WHEN sha IS NULL THEN 'recording' END, CASE WHEN consent_id IS NULL THEN 'consent' END], lambda r: r IS NOT NULL), ',') AS errors
    FROM {X}""")  # fmt: skip
def sample_rows(t: Tables) -> DataFrame:
    c = {"audio.path": "audio_path", "audio.duration_ms": "duration_ms", "audio.declared_duration_ms": "declared_ms", "audio.byte_size": "byte_size", "labels.intent_target": "intent", "labels.style": "style", "labels.intensity": "intensity", "labels.valence": "valence", "alignment.path": "alignment_path", "quality.status": "verdict", "lifecycle.status": "lifecycle", "lifecycle.review_required": "review_required"}
    c |= {f"text.{k}": k for k in ("normalized", "observed", "language", "locale", "source_hash", "normalized_hash", "provenance_ref", "license_ref")}
    lists = {"consent_refs": "consents", "lifecycle.reasons": "reasons", "errors": "errors"}
    return rows(t).select("take_id", "audio_id", *(F.col(k).alias(v) for k, v in c.items()), *(F.array_join(F.col(k).cast("array<string>"), ",").alias(v) for k, v in lists.items()))


@query("b11_split_groups", f"""WITH x AS {X}, k AS (SELECT unnest([{{'kind': 'speaker', 'key': CAST(speaker_id AS VARCHAR)}}, {{'kind': 'session', 'key': CAST(session_id AS VARCHAR)}}, {{'kind': 'prompt', 'key': CAST(prompt_id AS VARCHAR)}}, {{'kind': 'normalized_text', 'key': normalized}}, {{'kind': 'corpus', 'key': corpus || '@1'}},
    {{'kind': 'environment', 'key': CASE WHEN session_id % 4 <> 0 OR session_id % 2 = 0 THEN CAST(session_id % 4 AS VARCHAR) END}}, {{'kind': 'room_tone', 'key': NULL}}, {{'kind': 'device', 'key': CASE WHEN session_id % 4 <> 3 THEN CAST(session_id % 4 AS VARCHAR) END}}, {{'kind': 'day', 'key': CAST(session_id % 28 AS VARCHAR)}}]) AS e FROM x)
    SELECT kind, count(*) AS groups, count(*) FILTER (key = 'unknown') AS unknown, CAST(sum(n) AS BIGINT) AS samples, max(n) AS largest FROM (SELECT e.kind AS kind, coalesce(e.key, 'unknown') AS key, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY kind""")  # fmt: skip
def split_groups(t: Tables) -> DataFrame:
    """Groups of each kind by their tokens: their number, whether one of them is the unknown, and the largest."""
    ids = F.col("split.group_ids")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), ids[k].alias("key")) for k in splits.KINDS)))
    by = rows(t).select(each.alias("e")).groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))
    return by.groupBy("kind").agg(F.count("*").alias("groups"), F.count_if(F.col("key") == "unknown").alias("unknown"), F.sum("n").alias("samples"), F.max("n").alias("largest"))


@query("b11_assigned_splits", """WITH RECURSIVE g AS (SELECT session_id || '-' || take_ord AS take_id, 'session:' || session_id AS a, 'prompt:' || prompt_id AS b FROM takes),
    e AS (SELECT a AS x, b AS y FROM g UNION SELECT b, a FROM g), r AS (SELECT x AS node, x AS label FROM e UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.node), l AS (SELECT node, min(label) AS label FROM r GROUP BY node),
    u AS (SELECT take_id, label AS split_group, CAST('0x' || substr(sha256('7:' || label), 1, 8) AS BIGINT) / 4294967296 AS u FROM g JOIN l ON g.a = l.node)
    SELECT take_id, split_group, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS assignment FROM u""")  # fmt: skip
def assigned_splits(t: Tables) -> DataFrame:
    """Splits that share neither a session nor a prompt."""
    x = splits.assigned(rows(t).select("take_id", "split"), F.col("split.group_keys"), F.col("take_id"), LINKED, SHARES, seed=7)
    return x.select("take_id", "split_group", "assignment")
