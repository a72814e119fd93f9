"""The end of a recording: identified, stored, judged, and told of, as stages of one plan.

A stage that fails ends nothing: what it could not do is evidence in the row, and where it counts against the take, a gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_sha256
from . import takes as T

STAGES = ("identified", "persisted", "evaluated", "compensated")


def name_part(x: str):
    return F.regexp_replace(F.col(x).cast("string"), "[^a-zA-Z0-9._-]+", "-")


def identified(recordings: DataFrame) -> DataFrame:
    """``recordings`` (session_id, take_id, content) with their file's name, and size and digest of those that hold a sound."""
    there = F.octet_length("content") > 0
    return recordings.withColumns({"file_name": F.concat(name_part("session_id"), F.lit("__"), name_part("take_id"), F.lit(".wav")), "byte_size": F.when(there, F.octet_length("content").cast("long")), "sha256": F.when(there, F.sha2("content", 256))})


def persisted(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` with ``saved`` and, where not, why: nothing was recorded, or ``stored`` (file_name, sha256) lacks the file or holds another under its name.

    Digests meet as 32 bytes in ``digest``, which takes the place of ``sha256``.
    """
    held = stored.select("file_name", F.when(is_sha256(F.col("sha256")), F.unhex("sha256")).alias("digest")).groupBy("file_name").agg(F.collect_set("digest").alias("held"))
    x = rows.withColumn("digest", F.unhex("sha256")).drop("sha256").join(held, "file_name", "left")
    why = F.when(F.col("digest").isNull(), "nothing_recorded").when(F.col("held").isNull(), "not_stored").when(~F.array_contains("held", F.col("digest")), "other_content")
    return x.withColumn("save_error", why).withColumn("saved", why.isNull()).withColumn("sounds", F.col("digest").isNotNull()).drop("held")


def evaluated(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """``rows`` that were judged (``levels`` and what ``takes.told_by`` tells): those alone that hold a sound and whose prompt is known; the others have no take."""
    known = prompts.select("prompt_id").distinct().withColumn("known", F.lit(True))
    x = rows.join(known, "prompt_id", "left")
    is_take = F.coalesce("known", F.lit(False)) & F.col("sounds")
    told = ("levels", *T.told_by(F.col("levels")))
    return x.select(*(c for c in rows.columns if c not in told), is_take.alias("is_take"), *(F.when(is_take, F.col(c)).alias(c) for c in told))


def compensated(rows: DataFrame) -> DataFrame:
    """Takes whose sound was not stored: they get a gate that says so, and are rejected."""
    lost = F.col("is_take") & ~F.col("saved")
    own = F.when(lost, F.col("levels").bitwiseOR(F.lit(T.LOST))).otherwise(F.col("levels"))
    return rows.withColumn("levels", own).withColumns({
        "gates": T.gates_of(F.col("levels")), "verdict": F.when(lost, "reject").otherwise(F.col("verdict")),
        "rating": F.when(lost, "reject").otherwise(F.col("rating")), "best": F.when(lost, False).otherwise(F.col("best")), "compensated": lost,
    })


def finalize(recordings: DataFrame, prompts: DataFrame, stored: DataFrame, mode: str = "training") -> DataFrame:
    """Each recording through all stages, with ``evidence``: a status for each of STAGES.

    ``recordings`` has session_id, take_id, prompt_id, content and what ``takes.recorded`` reads; ``stored`` says what the store holds.  A null or empty content is no sound.  One row a
    recording, repeated ones included; an empty table gives an empty one.
    """
    # what gates say goes along, as a number, and not what they are made of
    rows = identified(recordings).withColumn("levels", T.levels(mode)).withColumns(T.told_by(F.col("levels")))
    x = compensated(evaluated(persisted(rows, stored), prompts)).withColumn("sha256", F.lower(F.hex("digest")))
    status = {
        "identified": F.when(F.col("sounds"), "done").otherwise("nothing_recorded"), "persisted": F.coalesce("save_error", F.lit("done")),
        "evaluated": F.when(F.col("is_take"), "done").when(~F.col("sounds"), "nothing_recorded").otherwise("no_prompt"), "compensated": F.when(F.col("compensated"), "rejected").otherwise("not_needed"),
    }
    return x.withColumn("evidence", F.struct(*(status[s].alias(s) for s in STAGES))).drop("digest", "sounds")


def completed(rows: DataFrame) -> DataFrame:
    """Of each session: its takes, how many of each rating, whether all its recordings are stored, and the prompts that it completed, in order."""
    take = F.col("is_take")
    count = lambda r: F.count_if(take & (F.col("rating") == r)).alias(r)
    prompts = F.array_sort(F.collect_set(F.when(take & (F.col("rating") == "keeper"), F.col("prompt_id"))))
    return rows.groupBy("session_id").agg(F.count_if(take).alias("takes"), *map(count, ("keeper", "maybe", "reject")), F.bool_and("saved").alias("all_saved"), prompts.alias("completed"))
