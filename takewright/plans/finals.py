"""Queries of whole recordings: finalised takes and sessions, imported media by their budgets, restores of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adaptive, finalize, takes
from ..sources import stores
from ..sources.shared import shared_folder
from .base import CTES, ENTITIES, ORACLE_SQL, Tables, query
from .further import recorded_lines


def recordings(t: Tables) -> DataFrame:
    """Measured lines as recordings: some without a sound, some of prompts that no corpus has."""
    s, o = F.col("session_id"), F.col("take_ord")
    sound = F.when((s + o) % 17 != 0, F.concat_ws(":", F.lit("sound"), s, o).cast("binary")).when(s % 2 == 0, F.lit("").cast("binary"))
    return recorded_lines(t).withColumns({"take_id": F.concat_ws("/", s, o), "prompt_id": s * 100 + o, "content": sound})


def corpus_prompts(t: Tables) -> DataFrame:
    return t.metrics.where("session_id % 13 <> 0").select((F.col("session_id") * 100 + F.col("take_ord")).alias("prompt_id"))


def stored_files(t: Tables) -> DataFrame:
    """What the store holds: not every recording, and under some names something else."""
    s, o = F.col("session_id"), F.col("take_ord")
    sound = F.when(s % 11 == 0, F.lit("other")).otherwise(F.concat_ws(":", F.lit("sound"), s, o))
    return t.metrics.where((s + o) % 7 != 0).select(F.concat(s, F.lit("__"), s, F.lit("-"), o, F.lit(".wav")).alias("file_name"), F.sha2(sound.cast("binary"), 256).alias("sha256"))  # repeated names are met as one


FINAL = f"""b01 AS ({ORACLE_SQL['b01_recorded_takes']}),
    x AS (SELECT *, (session_id + take_ord) % 17 <> 0 AS sound, session_id % 13 <> 0 AS known FROM b01),
    y AS (SELECT *, sound AND known AS is_take, CASE WHEN NOT sound THEN 'nothing_recorded' WHEN (session_id + take_ord) % 7 = 0 THEN 'not_stored' WHEN session_id % 11 = 0 THEN 'other_content' END AS save_error FROM x),
    z AS (SELECT session_id, take_ord, is_take, save_error, session_id || '__' || session_id || '-' || take_ord || '.wav' AS file_name, CASE WHEN sound THEN sha256('sound:' || session_id || ':' || take_ord) END AS sha256, is_take AND save_error IS NOT NULL AS lost, sound, rating, verdict, gates FROM y)"""


@query("b15_finalized_recordings", f"""WITH {FINAL} SELECT session_id, take_ord, file_name, sha256, CASE WHEN sound THEN 'done' ELSE 'nothing_recorded' END AS identified, coalesce(save_error, 'done') AS persisted,
    CASE WHEN is_take THEN 'done' WHEN NOT sound THEN 'nothing_recorded' ELSE 'no_prompt' END AS evaluated, CASE WHEN lost THEN 'rejected' ELSE 'not_needed' END AS compensated, CASE WHEN lost THEN 'reject' WHEN is_take THEN verdict END AS verdict, CASE WHEN lost THEN 'reject' WHEN is_take THEN rating END AS rating,
    CASE WHEN is_take THEN gates || CASE WHEN lost THEN ',audio_persistence:fail' ELSE '' END ELSE '' END AS gates FROM z""")  # fmt: skip
def finalized_recordings(t: Tables) -> DataFrame:
    x = finalize.finalize(recordings(t), corpus_prompts(t), stored_files(t))
    gates = F.coalesce(takes.gates_text(F.col("levels")), F.lit(""))
    return x.select("session_id", "take_ord", "file_name", "sha256", *(F.col(f"evidence.{s}").alias(s) for s in finalize.STAGES), "verdict", "rating", gates.alias("gates"))


@query("b15_completed_sessions", f"""WITH {FINAL}, r AS (SELECT *, CASE WHEN lost THEN 'reject' ELSE rating END AS final FROM z)
    SELECT session_id, count(*) FILTER (is_take) AS takes, count(*) FILTER (is_take AND final = 'keeper') AS keeper, count(*) FILTER (is_take AND final = 'maybe') AS maybe, count(*) FILTER (is_take AND final = 'reject') AS reject, bool_and(save_error IS NULL) AS all_saved,
      coalesce(array_to_string(list_sort(list_distinct(list(session_id * 100 + take_ord) FILTER (is_take AND final = 'keeper'))), ','), '') AS completed FROM r GROUP BY session_id""")  # fmt: skip
def completed_sessions(t: Tables) -> DataFrame:
    x = finalize.completed(finalize.finalize(recordings(t), corpus_prompts(t), stored_files(t)))
    return x.withColumn("completed", F.array_join(F.transform("completed", lambda p: p.cast("string")), ","))


def _imports(t: Tables) -> DataFrame:
    """Imported recordings: customers as media of 3 to 400 seconds."""
    i = F.col("c_custkey")
    return t.customer.select(i.cast("long").alias("media_id"), ((i * 37) % 398 * 1000 + 3000).cast("long").alias("duration_ms"), (i % 5 != 0).alias("accelerated"), ((i % 50) / 50).alias("speech"), ((i % 33) / 40).alias("focused"), ((i % 23) / 200).alias("difference"), ((i % 19) / 500).alias("separated_difference"), (i % 4 == 0).alias("center"))


def _import_readings(t: Tables) -> DataFrame:
    i, p = F.col("c_custkey"), F.col("place")
    rows = t.customer.select("c_custkey", F.posexplode(F.array(*map(F.lit, adaptive.READINGS))).alias("place", "reading"))
    word = F.when((i % 3 == 0) & (p == 1), F.lit("other")).otherwise(F.lit("same"))
    return rows.select(i.cast("long").alias("media_id"), "reading", F.when((i + p * 5) % 9 == 0, "insufficient").otherwise("review").alias("status"), F.array(word, word).alias("tokens"), ((i % 29 + 1) * 4000.0 * (p + 1)).alias("elapsed_ms"))


CTES["imported"] = "SELECT c_custkey AS media_id, CAST((c_custkey * 37) % 398 * 1000 + 3000 AS BIGINT) AS duration_ms, c_custkey % 5 <> 0 AS accelerated, (c_custkey % 50) / 50.0 AS speech, (c_custkey % 33) / 40.0 AS focused, (c_custkey % 23) / 200.0 AS difference, (c_custkey % 19) / 500.0 AS separated_difference, c_custkey % 4 = 0 AS center, (c_custkey % 29 + 1) * 4000.0 AS elapsed_ms FROM customer"
ENTITIES |= {"imported": _imports, "import_readings": _import_readings}


def read_from(readings: DataFrame) -> adaptive.Read:
    return lambda name, keys: readings.where(F.col("reading") == name).join(keys.select("media_id"), "media_id", "left_semi")


@query("p06_imported_readings", """WITH a AS (SELECT *, CASE WHEN media_id % 9 = 0 THEN 'insufficient' ELSE 'review' END AS status, floor(elapsed_ms / duration_ms * 1000 + 0.5) / 1000 AS factor, floor(elapsed_ms * 2 / duration_ms * 1000 + 0.5) / 1000 AS verified FROM imported),
    b AS (SELECT *, CASE WHEN (difference >= 0.07 AND focused >= 0.08) OR (focused - speech >= 0.16 AND focused >= 0.18) OR (center AND difference >= 0.045) THEN 'music_mix' WHEN status = 'insufficient' OR speech < 0.12 THEN 'constrained_voice' WHEN speech >= 0.18 AND difference < 0.035 THEN 'clean_voice' ELSE 'uncertain' END AS scene FROM a),
    c AS (SELECT *, CASE WHEN duration_ms > 300000 THEN 1 WHEN duration_ms > 600000 OR NOT accelerated OR factor > 0.8 THEN CASE WHEN scene = 'clean_voice' THEN 1 ELSE 2 END WHEN scene = 'clean_voice' OR duration_ms > 180000 THEN 2 WHEN scene = 'music_mix' AND factor <= 0.35 THEN 4 ELSE 3 END AS planned FROM b),
    d AS (SELECT *, CASE WHEN planned >= 2 AND verified > 0.8 THEN least(planned, 2) WHEN planned >= 2 AND verified > 0.45 THEN least(planned, 3) ELSE planned END AS effective,
      planned >= 2 AND (scene = 'music_mix' OR status = 'insufficient' OR (media_id + 5) % 9 = 0 OR media_id % 3 = 0 OR difference > 0.08) AS ensemble FROM c)
    SELECT media_id, scene, planned, effective, CASE WHEN ensemble AND effective >= 3 AND difference > 0.015 THEN 'read' WHEN ensemble AND effective < 3 THEN 'skipped_for_budget' WHEN duration_ms > 300000 THEN 'skipped_for_length' ELSE 'not_needed' END AS vocal_focus,
      CASE WHEN ensemble AND effective >= 4 THEN 'separated' WHEN ensemble AND effective < 4 THEN 'skipped_for_budget' WHEN duration_ms > 300000 THEN 'skipped_for_length' ELSE 'not_needed' END AS separation,
      concat_ws(',', 'tiny', CASE WHEN planned >= 2 THEN 'base' END, CASE WHEN ensemble AND effective >= 3 AND difference > 0.015 THEN 'focus' END, CASE WHEN ensemble AND effective >= 4 AND separated_difference > 0.015 THEN 'separated' END) AS readings FROM d""")  # fmt: skip
def imported_readings(t: Tables) -> DataFrame:
    return adaptive.segment(t.imported, read_from(t.import_readings))


@query("a10_a11_restored_store", """SELECT 'text/' || doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN doc_id % 3 = 1 THEN 'both' ELSE 'restored' END AS origin FROM documents""")
def restored_store(t: Tables) -> DataFrame:
    """Two thirds of all documents in a store, into which two thirds are restored: those in both are alike."""
    root = shared_folder(t.spark)
    rows = t.documents.select("doc_id", F.concat(F.lit("text/"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    stores.restore(t.spark, root, rows.where("doc_id % 3 <> 2").select("path", "content"))
    stores.restore(t.spark, root, rows.where("doc_id % 3 <> 0").select("path", "content"))
    doc = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    x = stores.names(t.spark, root)
    return x.select(F.col("path").alias("name"), "sha256", F.when(doc % 3 == 0, "kept").when(doc % 3 == 1, "both").otherwise("restored").alias("origin"))
