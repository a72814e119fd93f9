"""Workspaces from untrusted JSON: every field coerced, defaulted and clamped; flattened to sessions and takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bounded_int
from ..functions.text import is_sha256, recording_file_name

TAKE = "struct<id:string,promptId:string,durationMs:double,recordedAt:string,fileName:string,media:struct<sha256:string>,review:struct<rating:string>>"
WORKSPACE = f"struct<id:string,version:double,settings:struct<minutes:double,distanceCm:double,noiseFloorDbfs:double>,capturedSessions:array<struct<id:string,speakerId:string,language:string,corpusId:string,takes:array<{TAKE}>>>,consents:array<struct<speakerId:string,status:string,evidence:string>>>"
VERSION = 2


def text_or(x: Column, default: str) -> Column:
    return F.when(F.trim(x) != "", x).otherwise(F.lit(default))


def array_or_empty(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(kind))


def normalize(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row per document: what is no record becomes an empty workspace; a later version than this fails the query."""
    w = F.from_json(column, WORKSPACE, {"mode": "PERMISSIVE"})
    x = documents.withColumn("w", w)
    version = F.when(F.col("w.version") > VERSION, F.raise_error(F.lit("workspace is of a later version"))).otherwise(F.lit(VERSION))
    rights = F.filter(F.coalesce("w.consents", F.array().cast("array<struct<speakerId:string,status:string,evidence:string>>")), lambda c: (F.trim(c["speakerId"]) != "") & c["status"].isin("granted", "revoked", "unknown"))
    return x.select(
        *[c for c in documents.columns if c != column], text_or(F.col("w.id"), "workspace").alias("workspace_id"), version.alias("version"),
        bounded_int("w.settings.minutes", 1, 60, 10).alias("minutes"), bounded_int("w.settings.distanceCm", 5, 45, 15).alias("distance_cm"), bounded_int("w.settings.noiseFloorDbfs", -120, 0).alias("noise_floor_dbfs"),
        F.col("w.capturedSessions").alias("sessions"), rights.alias("consents"),
    )


def takes(workspaces: DataFrame) -> DataFrame:
    """One row per take, in order; a digest that is none becomes null, a missing file name is made of the ids."""
    x = workspaces.select("workspace_id", F.posexplode("sessions").alias("session_ord", "s")).select("workspace_id", "session_ord", "s.id", "s.speakerId", "s.language", F.posexplode("s.takes").alias("take_ord", "t"))
    sha = F.when(is_sha256(F.col("t.media.sha256")), F.col("t.media.sha256"))
    return x.select(
        "workspace_id", "session_ord", F.col("id").alias("session_id"), F.col("speakerId").alias("speaker_id"), F.when(F.col("language") == "fr", "fr").otherwise("en").alias("language"), "take_ord", F.col("t.id").alias("take_id"), F.col("t.promptId").alias("prompt_id"),
        bounded_int("t.durationMs", 0, 60000, 0).alias("duration_ms"), F.coalesce("t.fileName", recording_file_name(F.col("id"), F.col("t.id"))).alias("file_name"), sha.alias("sha256"), F.coalesce("t.review.rating", F.lit("unreviewed")).alias("rating"),
    )


def backup(workspaces: DataFrame) -> DataFrame:
    """Pretty JSON documents that name their format and version."""
    body = F.struct(F.lit("workspace-backup").alias("format"), F.lit(1).alias("version"), F.struct("*").alias("workspace"))
    return workspaces.select("workspace_id", F.to_json(body, {"pretty": "true"}).alias("json"))
