"""Whole sample rows of a capture package with their nine split groups, and splits that no group straddles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import shared_folder
from . import rules

#: The groups of a sample by which a split may be made, and a recording's format.
KINDS = ("speaker", "session", "prompt", "normalized_text", "corpus", "environment", "room_tone", "device", "day")
CONTAINER, ENCODING, RATE, CHANNELS, DEPTH = "WAVE", "PCM_S24LE", 48_000, 1, 24


def group_keys(normalized: Column, corpus: Column) -> dict[str, Column]:
    """What a sample shares with others, by kind, as text; null where it is not known, so that it joins none.  Room tones are not told apart yet."""
    environment = F.to_json(F.struct("observed_settings", "room_tone"), {"ignoreNullFields": "false"})
    known = F.col("observed_settings").isNotNull() | F.col("room_tone").isNotNull()
    keys = {"speaker": F.col("speaker_id"), "session": F.col("session_id"), "prompt": F.col("prompt_id"), "normalized_text": normalized, "corpus": corpus, "environment": F.when(known, environment), "room_tone": F.lit(None), "device": F.col("device"), "day": F.substring("recorded_at", 1, 10)}
    return {k: keys[k].cast("string") for k in KINDS}


def group_id(key: Column) -> Column:
    """A token of one of ``group_keys``; what is not known is called so."""
    return F.when(key.isNotNull(), X.stable_token(key)).otherwise("unknown")


def sample_rows(takes: DataFrame, prompts: DataFrame, rights: DataFrame) -> DataFrame:
    """A row per take with all that a package tells of it: ids, audio, text, labels, quality, references, lifecycle and split groups.

    ``takes``: session_id, take_ord, speaker_id, prompt_id, dataset_id, project_id, text, observed, rating, verdict, alignment, duration_ms, declared_ms, audio_sha256, byte_size,
    observed_settings, room_tone, device, recorded_at; ``prompts``: prompt_id, text, language, corpus_id, corpus_version, license_id, intent, tone, energy, valence, arousal, dominance;
    ``rights``: speaker_id, consent_id, granted.  A take whose prompt, recording or consent is not there keeps its row, and ``errors`` names what would
    stop the package; a blank text is the prompt's own.  Prompts and rights have one row a key.
    """
    p = prompts.withColumnRenamed("text", "expected")
    x = takes.join(p, "prompt_id", "left").join(rights.select("speaker_id", "consent_id", "granted"), "speaker_id", "left")
    c = F.col
    spoken = F.coalesce(F.nullif(F.trim("text"), F.lit("")), "expected", F.lit(""))
    corpus = F.when(c("corpus_id").isNotNull(), F.concat_ws("@", "corpus_id", "corpus_version"))
    x = x.withColumns({"normalized": X.normalize_text(spoken), "corpus": corpus, "take_id": F.concat_ws("-", "session_id", "take_ord"), "granted": F.coalesce("granted", F.lit(False))})
    # columns first, so that a split by some kinds reads no more than these need
    keys = group_keys(c("normalized"), c("corpus"))
    x = x.withColumns({"key": X.sanitize(c("take_id"))} | {f"key_{k}": v for k, v in keys.items()})
    known = F.struct(*(c(f"key_{k}").alias(k) for k in KINDS))
    path = lambda folder: F.concat(F.lit(f"{folder}/"), "key", F.lit(".json"))
    audio_id = F.concat(F.lit("audio_"), "audio_sha256")
    audio = F.struct(
        F.concat(F.lit("audio/"), audio_id, F.lit(".wav")).alias("path"), c("audio_sha256").alias("sha256"), F.lit(CONTAINER).alias("container"), F.lit(ENCODING).alias("encoding"), F.lit(RATE).alias("sample_rate_hz"), F.lit(CHANNELS).alias("channels"),
        F.lit(DEPTH).alias("bit_depth"), "duration_ms", c("declared_ms").alias("declared_duration_ms"), "byte_size", F.lit(False).alias("source_signal_retained"), F.lit(True).alias("raw_immutable"),
    )
    provenance = F.concat(F.lit("corpus:"), "corpus", F.lit("#prompt:"), "prompt_id")
    text = F.struct("expected", "normalized", "observed", "language", F.when(c("language").isNotNull(), X.locale(c("language"))).alias("locale"), F.sha2("expected", 256).alias("source_hash"), F.sha2("normalized", 256).alias("normalized_hash"), provenance.alias("provenance_ref"), c("license_id").alias("license_ref"))
    labels = F.struct(c("intent").alias("intent_target"), F.lit(None).cast("string").alias("emotion_observed"), c("tone").alias("style"), c("energy").alias("intensity"), "valence", "arousal", "dominance")
    reasons = rules.lifecycle_reasons(c("rating"), c("alignment"), c("granted"), c("verdict"))
    lifecycle = F.struct(rules.lifecycle(c("rating")).alias("status"), reasons.alias("reasons"), (c("rating") != "reject").alias("review_required"))
    lifecycle = lifecycle.withField("review_required", F.when(c("rating") == "keeper", F.size(reasons) > 0).otherwise(lifecycle["review_required"]))
    missing = {"prompt": c("language").isNull(), "recording": c("audio_sha256").isNull(), "consent": c("consent_id").isNull()}
    split = F.struct(F.lit("unassigned").alias("assignment"), F.struct(*(group_id(c(f"key_{k}")).alias(k) for k in KINDS)).alias("group_ids"), known.alias("group_keys"))
    return x.select(
        F.concat(F.lit("sample_"), X.stable_token(F.concat_ws(":", "session_id", "take_id"))).alias("sample_id"), F.concat(F.lit("utterance_"), X.stable_token(F.concat_ws(":", "corpus", "prompt_id", "normalized"))).alias("utterance_id"), "take_id", audio_id.alias("audio_id"),
        "speaker_id", "session_id", "take_ord", "dataset_id", "project_id", audio.alias("audio"), text.alias("text"), labels.alias("labels"), F.struct(c("alignment").alias("status"), path("alignment").alias("path")).alias("alignment"), F.struct(c("verdict").alias("status"), path("quality").alias("path")).alias("quality"),
        F.array_compact(F.array("consent_id")).alias("consent_refs"), F.array_compact(F.array("license_id")).alias("license_refs"), lifecycle.alias("lifecycle"), split.alias("split"), F.array_compact(F.array(*(F.when(bad, k) for k, bad in missing.items()))).alias("errors"),
    )


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read back: rounds neither recompute one another nor depend on the executors that made them."""
    path = shared_folder(df.sparkSession, "splits")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of undirected ``edges`` (a, b), loops included; ``label``: the smallest node that can be reached.

    Every round takes the least label among the neighbours', then that label's own, so that labels leap over long chains; nothing changes once each node has its component's least.
    Messages are minima, made before they are shuffled; a node of any degree is a skewed key of a join, never a group in one task.
    """
    edges = edges.where("a is not null and b is not null")
    both = _kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _kept(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("b")).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = _kept(near.join(own, "label").select("node", F.least("label", "further").alias("label"), "old"))
        changed = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels


def components(rows: DataFrame, groups: Column, kinds: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``split_group``: the same for any two that share a known group of one of ``kinds``, be it over others; null where a row knows none.

    Groups are the nodes, not rows: a row links its first known group to its others, and of equal links one is kept.
    """
    wrong = set(kinds) - set(KINDS)
    if wrong or not kinds:
        raise ValueError(f"no groups to split by, or unknown ones: {sorted(wrong)}")
    nodes = F.array_compact(F.array(*(F.concat(F.lit(f"{k}:"), groups[k]) for k in kinds)))
    first = F.get(nodes, 0)
    links = rows.select(first.alias("a"), F.explode(nodes).alias("b")).distinct()
    labels = connected(links).select(F.col("node").alias("first_group_"), F.col("label").alias("split_group"))
    return rows.withColumn("first_group_", first).join(labels, "first_group_", "left").drop("first_group_")


def assigned(rows: DataFrame, groups: Column, row_id: Column, kinds: tuple[str, ...], shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``rows`` with ``split_group`` and ``assignment``: whole components fall to a split by a seeded number, so that no known group of ``kinds`` is in two.

    ``shares``: the splits' parts of 1, in order; the last takes what is left.  A row without any known group falls by its own ``row_id``.  Assignments depend on nothing but the seed
    and the component's least group: other components may come or go.  Shares hold for components, not for rows, as far as components are alike in size.
    """
    if not shares or min(shares.values()) < 0 or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    x = components(rows, groups, kinds)
    name = F.coalesce("split_group", F.concat(F.lit("row:"), row_id.cast("string")))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double") / 2**32
    ends, total = [], 0.0
    for split, share in list(shares.items())[:-1]:
        total += share
        ends.append((split, total))
    last = F.lit(list(shares)[-1])
    return x.withColumns({"split_group": name, "assignment": reduce(lambda rest, e: F.when(u < e[1], e[0]).otherwise(rest), reversed(ends), last)})


def leaks(rows: DataFrame, groups: Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, groups, shared, rows, shared_rows): how many known groups there are of each kind, how many lie in more than one assignment, and their rows."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), groups[k].alias("key")) for k in kinds)))
    # by assignment first: two small counts of a group meet, not its rows
    by = rows.select("assignment", each.alias("e")).where("e.key is not null").groupBy("e.kind", "e.key", "assignment").agg(F.count("*").alias("n"))
    by = by.groupBy("kind", "key").agg(F.count("*").alias("splits"), F.sum("n").alias("n"))
    return by.groupBy("kind").agg(F.count("*").alias("groups"), F.count_if(F.col("splits") > 1).alias("shared"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("splits") > 1, F.col("n"))), F.lit(0)).alias("shared_rows"))
