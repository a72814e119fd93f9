"""Analyses of takes that read a recording again only where the readings before ask for it.

A *reading* is what one model made of one form of a recording: ``tiny`` and ``base`` of the recording as it is, ``focus`` of the voice's band, ``separated`` of the
separated voice.  Readings come from ``read(name, keys)``, which is asked for one reading of those takes alone that need it: each stage joins its keys
before it reads, so that a take that a stage leaves out costs it nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite, js_round
from . import alignment, analysis, rules

READINGS = ("tiny", "base", "focus", "separated")
COLUMNS = ["take_id", "words", "expected", "matched", "supported", "speech_ms", "segments", "alignment", "run", "elapsed_ms"]
MOST_FOCUS_MS = 5 * 60_000
Read = Callable[[str, DataFrame], DataFrame]


def from_table(readings: DataFrame) -> Read:
    """``read`` over a table of readings (``reading`` and COLUMNS)."""
    return lambda name, keys: readings.where(F.col("reading") == name).join(keys.select("take_id"), "take_id", "left_semi").select(*COLUMNS)


def repeated_run(text: Column) -> Column:
    """The most often that a word of a text follows itself without another between, itself counted."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(w == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(words, start, step)["most"]


def scored(rows: DataFrame, name: str) -> DataFrame:
    """The readings' scores; ``prompted`` says that their take has a prompt."""
    density = F.when(F.col("speech_ms") > 0, F.col("words") / (F.col("speech_ms") / 60000)).otherwise(0.0)
    score = analysis.hypothesis_score(F.col("words"), F.col("expected"), F.col("matched"), F.col("supported"), F.col("alignment"), F.lit(name != "tiny"), density, F.col("run"))
    return rows.select("take_id", F.lit(READINGS.index(name)).alias("place"), F.lit(name).alias("reading"), score.alias("score"), (F.col("expected") > 0).alias("prompted"), "words", "matched", "elapsed_ms")


def analyze(takes: DataFrame, read: Read) -> DataFrame:
    """Of each take (take_id, kind, snr, reverb, active, duration_ms and ``factor``, the stored real-time factor or null) with a first reading: the reading that is kept, and why.

    The first is ``tiny``; ``base`` follows where the scene or the first reading asks for it.  The budget comes from the slowest of those, or else the stored factor, and says
    whether the voice's band and, for sung or noisy takes, the separated voice are read as well.  The best score wins, of equal ones the earlier reading.
    Returns take_id, scene, budget, depth, reading, reason, score, words, matched and readings, their names in order.
    """
    scene = rules.capture_scene(F.col("kind"), F.col("snr"), F.col("reverb"), F.col("active"))
    x = takes.withColumn("scene", scene)
    first = read("tiny", x)
    x = x.join(first, "take_id")
    again = rules.escalates(F.col("segments"), F.col("scene"), F.col("words"), F.col("expected"), F.col("matched"), F.col("alignment"))
    second = read("base", x.where(again).select("take_id"))
    slowest = scored(first, "tiny").unionByName(scored(second, "base")).groupBy("take_id").agg(F.max("elapsed_ms").alias("slowest"))
    measured = finite(F.col("slowest") / F.col("duration_ms"))
    x = x.select("take_id", "scene", "snr", "duration_ms", "factor").join(slowest, "take_id")
    x = x.withColumn("factor", F.coalesce(js_round(F.when(measured > 0, measured), 3), "factor"))
    x = x.withColumn("budget", analysis.captured_hypotheses(F.col("scene"), F.col("duration_ms"), F.col("factor")))
    focused = (F.col("scene") != "clean_voice") & (F.col("budget") >= 2) & (F.col("duration_ms") <= MOST_FOCUS_MS)
    third = read("focus", x.where(focused).select("take_id"))
    separated = focused & (F.col("budget") >= 3) & ((F.col("scene") == "sung_voice") | (F.coalesce("snr", F.lit(99.0)) < 16))
    fourth = read("separated", x.where(separated).select("take_id"))
    every = scored(first, "tiny")
    for name, rows in (("base", second), ("focus", third), ("separated", fourth)):
        every = every.unionByName(scored(rows, name))
    best = every.groupBy("take_id").agg(F.max_by(F.struct("reading", "score", "words", "matched"), F.struct("score", -F.col("place"))).alias("best"), F.array_sort(F.collect_list(F.struct("place", "reading"))).alias("all"), F.bool_or("prompted").alias("prompted"))
    names = F.col("all.reading")
    depth = F.when(F.array_contains(names, "separated"), "deep").when(F.size(names) > 1, "verified").otherwise("fast")
    reason = F.when(F.size(names) == 1, "fast_path_sufficient").when(F.col("prompted"), "prompt_match").otherwise("acoustic_support")
    return x.join(best, "take_id").select("take_id", "scene", "budget", depth.alias("depth"), "best.reading", reason.alias("reason"), js_round(F.when(F.size(names) == 1, 1.0).otherwise(F.col("best.score")), 3).alias("score"), "best.words", "best.matched", F.array_join(names, ",").alias("readings"))


def segment(media: DataFrame, read: Read) -> DataFrame:
    """Which readings of imported recordings are made, by the budget that the first ones leave.

    ``media``: media_id, duration_ms, accelerated, speech and focused (shares of the time), difference (of the voice's band from the recording), separated_difference (of the
    separated voice) and center (whether the voice lay between two channels).  ``read`` gives media_id, status (``review`` or ``insufficient``), tokens and elapsed_ms, of the media it is asked for alone.

    ``tiny`` scouts and plans; ``base`` verifies, and its own speed may take readings back; ``focus`` and ``separated`` follow where music, a bad reading or readings that do not
    agree ask for them, and where they would hear something else.  Returns media_id, scene, planned and effective (numbers of readings), vocal_focus, separation and readings, in order.
    """
    factor = lambda c: F.when(finite(F.col(c) / F.col("duration_ms")) > 0, js_round(F.col(c) / F.col("duration_ms"), 3))
    first = read("tiny", media).select("media_id", "status", F.col("tokens").alias("tiny_tokens"), "elapsed_ms")
    x = media.join(first, "media_id")
    x = x.withColumn("scene", analysis.imported_scene(F.col("status"), F.col("speech"), F.col("focused"), F.col("difference"), F.col("center")))
    x = x.withColumn("planned", analysis.imported_hypotheses(F.col("scene"), F.col("duration_ms"), analysis.processing_profile(F.col("duration_ms"), F.col("accelerated")), factor("elapsed_ms")))
    second = read("base", x.where("planned >= 2").select("media_id")).select("media_id", F.col("status").alias("base_status"), F.col("tokens").alias("base_tokens"), F.col("elapsed_ms").alias("base_ms"))
    x = x.join(second, "media_id", "left")
    x = x.withColumn("effective", F.when(F.col("base_status").isNotNull(), analysis.refined_hypotheses(F.col("planned"), factor("base_ms"))).otherwise(F.col("planned")))
    agreed = alignment.agreement(F.coalesce("tiny_tokens", F.array().cast("array<string>")), F.coalesce("base_tokens", F.array().cast("array<string>")))
    asked = (F.col("scene") == "music_mix") | (F.col("status") == "insufficient") | (F.col("base_status") == "insufficient") | (agreed < 0.9) | (F.col("difference") > 0.08)
    x = x.withColumn("ensemble", F.col("base_status").isNotNull() & asked)
    third = read("focus", x.where("ensemble and effective >= 3 and difference > 0.015").select("media_id")).select("media_id", F.lit(True).alias("focus"))
    parts = x["ensemble"] & (x["effective"] >= 4) & (x["duration_ms"] <= MOST_FOCUS_MS)
    fourth = read("separated", x.where(parts & (x["separated_difference"] > 0.015)).select("media_id")).select("media_id", F.lit(True).alias("separated"))
    x = x.withColumn("parts", parts).join(third, "media_id", "left").join(fourth, "media_id", "left")
    length = F.when(F.col("duration_ms") > MOST_FOCUS_MS, "skipped_for_length").otherwise("not_needed")
    focus = F.when(F.col("focus"), "read").when(F.col("ensemble") & (F.col("effective") < 3), "skipped_for_budget").otherwise(length)
    separation = F.when(F.col("parts"), "separated").when(F.col("ensemble") & (F.col("effective") < 4), "skipped_for_budget").otherwise(length)
    names = F.concat_ws(",", F.lit("tiny"), F.when(F.col("base_status").isNotNull(), "base"), F.when(F.col("focus"), "focus"), F.when(F.col("separated"), "separated"))
    return x.select("media_id", "scene", "planned", "effective", focus.alias("vocal_focus"), separation.alias("separation"), names.alias("readings"))
