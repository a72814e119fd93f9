"""Progress of speakers through a corpus, rebuilt from what they kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["corpus_id", "speaker_id", "language"]


def reconcile(progress: DataFrame, takes: DataFrame, scenarios: DataFrame, corpus_id: str, version: str) -> DataFrame:
    """Progress after one corpus has been rebuilt; that of other corpora stays.

    ``progress`` (KEYS, version, prompts, scenarios) holds sorted arrays; ``takes`` (KEYS, prompt_id, rating) those of all sessions; ``scenarios`` (scenario_id,
    prompt_id) the corpus.  A row with a blank key takes no part.  A scenario is complete where all its prompts are.
    """
    whole = F.col("corpus_id").isNotNull() & (F.trim(F.col("speaker_id").cast("string")) != "") & (F.trim("language") != "")
    kept = progress.where(whole & (F.col("corpus_id") != corpus_id))
    before = progress.where(whole & (F.col("corpus_id") == corpus_id)).select(*KEYS, F.explode_outer("prompts").alias("prompt_id"))
    # a session counts as progress of none where it has no keeper
    now = takes.where(whole & (F.col("corpus_id") == corpus_id)).select(*KEYS, F.when(F.col("rating") == "keeper", F.col("prompt_id")).alias("prompt_id"))
    done = before.unionByName(now).distinct()
    sizes = scenarios.groupBy("scenario_id").agg(F.count("*").alias("all"))
    parts = done.join(scenarios, "prompt_id").groupBy(*KEYS, "scenario_id").agg(F.count("*").alias("n")).join(sizes, "scenario_id").where("n = all")
    complete = parts.groupBy(*KEYS).agg(F.array_sort(F.collect_list("scenario_id")).alias("scenarios"))
    prompts = done.groupBy(*KEYS).agg(F.array_sort(F.collect_list("prompt_id")).alias("prompts"))
    rebuilt = prompts.join(complete, KEYS, "left").select(*KEYS, F.lit(version).alias("version"), "prompts", F.coalesce("scenarios", F.array().cast(scenarios_type(scenarios))).alias("scenarios"))
    return kept.select(*rebuilt.columns).unionByName(rebuilt)


def scenarios_type(scenarios: DataFrame) -> str:
    return f"array<{scenarios.schema['scenario_id'].dataType.simpleString()}>"


def complete_session(takes: DataFrame, session: DataFrame, progress: DataFrame, scenarios: DataFrame, corpus_id: str, version: str) -> tuple[DataFrame, DataFrame]:
    """All takes after ``session`` (as ``takes``, of one session or several) has replaced its earlier self, and the progress reconciled with them."""
    other = takes.join(session.select("session_id").distinct(), "session_id", "left_anti")
    after = other.unionByName(session)
    return after, reconcile(progress, after, scenarios, corpus_id, version)


def coverage(takes: DataFrame, prompts: DataFrame, first_only: bool = False) -> DataFrame:
    """Of each speaker and language in ``takes`` (speaker_id, language, session_id, prompt_id, rating): how many of the language's prompts are kept, and in per cent.

    ``first_only`` summarises the pair of the first session alone.
    """
    pairs = takes.groupBy("speaker_id", "language").agg(F.min("session_id").alias("first"))
    if first_only:
        pairs = pairs.orderBy("first", "speaker_id", "language").limit(1)
    required = prompts.groupBy("language").agg(F.count("*").alias("required"))
    kept = takes.where("rating = 'keeper'").select("speaker_id", "language", "prompt_id").distinct().join(prompts.select("language", "prompt_id"), ["language", "prompt_id"])
    kept = kept.groupBy("speaker_id", "language").agg(F.count("*").alias("completed"))
    x = pairs.join(kept, ["speaker_id", "language"], "left").join(required, "language", "left")
    done, need = F.coalesce("completed", F.lit(0)), F.coalesce("required", F.lit(0))
    return x.select("speaker_id", "language", done.alias("completed"), need.alias("required"), F.when(need > 0, F.floor(done / need * 100 + 0.5)).otherwise(F.lit(0)).alias("percent"))


def planned_prompts(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """(session_id, planned, found): of each session's ``planned`` prompt ids, those the corpus has, in the planned order."""
    each = sessions.select("session_id", F.posexplode("planned").alias("ord", "prompt_id"))
    found = each.join(prompts.select("prompt_id"), "prompt_id").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "prompt_id"))).alias("x"))
    x = sessions.join(found, "session_id", "left")
    return x.select("session_id", F.size("planned").alias("planned"), F.coalesce(F.col("x.prompt_id"), F.array().cast("array<bigint>")).alias("found"))
