"""Records of workspaces and packages: what makes one valid, what stands for a missing one, and what is told of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import display_name, named, trimmed
from ..functions.numbers import finite, js_round
from ..functions.text import is_sha256, safe_recording_name, transcript_tokens

ENTRY = "struct<fileName:string,path:string,byteLength:double,sha256:string>"
SCOPE_LISTS = ("speakerIds", "languages", "corpusRefs", "sessionIds", "takeStatuses")
SOURCE = "local_user_attestation"


def filled(x: Column) -> Column:
    return F.coalesce(trimmed(x) != "", F.lit(False))


def filled_list(x: Column) -> Column:
    """A list, empty or not, of texts that are not blank."""
    return F.coalesce(x.isNotNull() & F.forall(x, filled), F.lit(False))


def is_consent(r: Column) -> Column:
    status = F.coalesce(r["status"].isin("granted", "revoked", "unknown"), F.lit(False))
    return filled(r["consentId"]) & filled(r["speakerId"]) & filled(r["policyVersion"]) & status & filled_list(r["grants"]) & filled_list(r["restrictions"]) & F.coalesce(r["source"] == SOURCE, F.lit(False))


def is_license(r: Column) -> Column:
    status = F.coalesce(r["status"].isin("granted", "unknown"), F.lit(False))
    return filled(r["licenseId"]) & filled(r["corpusId"]) & filled(r["corpusVersion"]) & status & filled_list(r["restrictions"]) & F.coalesce(r["source"] == SOURCE, F.lit(False))


def is_snapshot(r: Column) -> Column:
    keys = filled(r["corpusId"]) & filled(r["corpusVersionSeen"]) & filled(r["speakerId"]) & filled(r["language"])
    return keys & r["completedScenarios"].isNotNull() & r["completedPrompts"].isNotNull()


def is_progress_source(r: Column, corpus_id: str) -> Column:
    return F.coalesce(r["corpusId"] == corpus_id, F.lit(False)) & filled(r["speakerId"]) & filled(r["language"]) & r["takes"].isNotNull()


def with_consent(takes: DataFrame, consents: DataFrame) -> DataFrame:
    """``takes`` with the consent of their speaker (consent_id, status, evidence), the last one by consent_id; a speaker without one has an unknown consent named after it."""
    last = consents.groupBy("speaker_id").agg(F.max(F.struct("consent_id", "status", "evidence")).alias("c"))
    x = takes.join(last, "speaker_id", "left")
    missing = F.concat(F.lit("consent.unknown."), F.col("speaker_id"))
    return x.select(*takes.columns, F.coalesce(F.col("c.consent_id").cast("string"), missing).alias("consent_id"), F.coalesce("c.status", F.lit("unknown")).alias("consent_status"), F.col("c.evidence").alias("evidence"))


def with_license(takes: DataFrame, licenses: DataFrame) -> DataFrame:
    """``takes`` (corpus_id, corpus_version) with their corpus version's license; one without has an unknown license named after it."""
    x = takes.join(licenses.select("corpus_id", "corpus_version", "license_id", F.col("status").alias("license_status")), ["corpus_id", "corpus_version"], "left")
    missing = F.concat_ws(".", F.lit("license.unknown"), "corpus_id", "corpus_version")
    return x.withColumn("license_id", F.coalesce(F.col("license_id").cast("string"), missing)).withColumn("license_status", F.coalesce("license_status", F.lit("unknown")))


def recording_entry(json: Column) -> Column:
    """A recording's place in an archive, and as ``error`` what is wrong with it: its name, or that its path is not made of its digest."""
    e = F.from_json(json, ENTRY, {"mode": "PERMISSIVE"})
    size = finite(e["byteLength"])
    whole = F.coalesce((size > 0) & (F.floor(size) == size) & (size < float(1 << 53)), F.lit(False))
    mapped = F.coalesce(is_sha256(e["sha256"]) & (e["path"] == F.concat(F.lit("audio/"), e["sha256"], F.lit(".wav"))), F.lit(False)) & whole
    error = F.when(F.json_object_keys(json).isNull(), "record").when(~F.coalesce(safe_recording_name(e["fileName"]), F.lit(False)), "name").when(~mapped, "mapping")
    return F.struct(error.alias("error"), e.alias("entry"))


def scope(s: Column, empty_sessions: bool = False) -> Column:
    """An export's scope with each list's first occurrences, and as ``error`` what it lacks: its ids, a selection, or a locale."""
    lists = [c for c in SCOPE_LISTS if not (empty_sessions and c == "sessionIds")]
    none = lambda c: F.coalesce(F.size(s[c]), F.lit(0)) <= 0
    lacks = none(lists[0])
    for c in lists[1:]:
        lacks = lacks | none(c)
    error = F.when(~(filled(s["datasetId"]) & filled(s["projectId"])), "ids").when(lacks, "selection").when(none("locales"), "locale")
    return F.struct(error.alias("error"), *(F.array_distinct(s[c]).alias(c) for c in (*SCOPE_LISTS, "locales")))


def recognition_observation(hypotheses: DataFrame, key: str = "user_id") -> DataFrame:
    """Of each session's hypotheses (result, alternative, text, confidence, final): the final first alternatives as ``transcript`` (none: null), and the mean confidence of final ones."""
    final = hypotheses.where("final")
    first = F.array_sort(F.collect_list(F.when(F.col("alternative") == 0, F.struct("result", "text"))))
    x = final.groupBy(key).agg(first.alias("x"), js_round(F.avg("confidence"), 3).alias("confidence"))
    x = hypotheses.select(key).distinct().join(x, key, "left")
    return x.select(key, F.nullif(F.trim(F.array_join(F.col("x.text"), " ")), F.lit("")).alias("transcript"), "confidence")


def free_transcript(text: Column, kind: Column, available: Column) -> Column:
    """What is known of a capture without a prompt: how, and how many words."""
    words = F.size(transcript_tokens(text))
    status = F.when(~available, "unavailable").when((words > 0) & kind.isin("sung", "sung_candidate"), "candidate-sung").when(words > 0, "detected").otherwise("no-final-words")
    return F.struct(status.alias("status"), words.alias("words"))


def speakers(workspace: DataFrame, initial: DataFrame) -> DataFrame:
    """Profiles (id, ord, display_name) of each workspace's speakers (workspace_id, ord, speaker_id, name), and of one without any those of ``initial`` (ord, speaker_id, name)."""
    ids = workspace.select("workspace_id").distinct()
    some = workspace.where("speaker_id is not null")
    empty = ids.join(some.select("workspace_id").distinct(), "workspace_id", "left_anti").crossJoin(F.broadcast(initial))  # a few rows
    every = some.select("workspace_id", "ord", "speaker_id", "name").unionByName(empty.select("workspace_id", "ord", "speaker_id", "name"))
    return every.select("workspace_id", "ord", "speaker_id", display_name(F.col("name"), F.col("ord")).alias("display_name"))


def lookup(rows: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """By key, the version that was given first; of what repeats both, the last row."""
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, version).orderBy(F.desc(order)))).where("n = 1").drop("n")
    first = rows.groupBy(key).agg(F.min_by(version, order).alias(version))
    return last.join(first, [key, version])


def stored(name: DataFrame, first: DataFrame, second: DataFrame, key: str = "file_name") -> DataFrame:
    """The content of each name from the first store, else from the second; in neither: null."""
    x = name.join(first.select(key, F.col("content").alias("a")), key, "left").join(second.select(key, F.col("content").alias("b")), key, "left")
    return x.select(key, F.coalesce("a", "b").alias("content"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("store"))


def tracked(files: DataFrame) -> DataFrame:
    """(path, content) as rows of an artifact list: path, byte_size and sha256 of the text's bytes."""
    return files.select("path", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def readme(title: Column, counts: dict[str, Column]) -> Column:
    """A package's short description: a title and a line for each count."""
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *(F.concat(F.lit(f"- {k}: "), v.cast("string")) for k, v in counts.items()))


STATUS = {"keeper": "training_candidate", "maybe": "needs_review", "reject": "rejected"}


def manifest_rows(takes: DataFrame, words: DataFrame) -> DataFrame:
    """One row of a manifest for each take (take_id, prompt_id, rating, sha256, byte_size): nulls for missing media, and of its ``words`` (take_id, phonemes) the sorted distinct sounds."""
    sounds = words.select("take_id", F.explode("phonemes").alias("p")).groupBy("take_id").agg(F.array_sort(F.collect_set("p")).alias("inventory"))
    x = takes.join(sounds, "take_id", "left")
    return x.select("take_id", "prompt_id", named(F.col("rating"), STATUS, F.lit("captured")).alias("status"), "sha256", F.when(F.col("sha256").isNotNull(), F.col("byte_size")).alias("byte_size"), F.coalesce("inventory", F.array().cast("array<string>")).alias("inventory"))
