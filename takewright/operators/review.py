"""Timings as a reviewer sees them: fused with heard words, calibrated to speech, by phrases, by the best source there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, js_round, js_round_int
from .intervals import scale_boundary, warp

#: Speech is taken to begin so long before its first segment and to end so long after its last, in ms.
LEAD, TAIL = 55, 45
#: How far words may be stretched to fill the speech.
SCALE = (0.82, 1.22)
PHRASE = r"[^.!?…]+(?:[.!?…]+|$)"
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def bounds(segments: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, speech_start, speech_end): where the first segment begins and the last one ends."""
    return segments.groupBy(key).agg(F.min("start_ms").alias("speech_start"), F.max_by("end_ms", "start_ms").alias("speech_end"))


def calibrated(words: DataFrame, segments: DataFrame, totals: DataFrame, key: str = "media_id") -> DataFrame:
    """Heard words (key, idx, word, start_ms, end_ms) moved to where speech begins and stretched, within limits, to where it ends.

    Media without segments, or whose words or speech have no length, keep their times; ``totals`` (key, total_ms) bounds them.
    """
    ends = words.groupBy(key).agg(F.min_by("start_ms", "idx").alias("first"), F.max_by("end_ms", "idx").alias("last"))
    x = words.join(ends.join(totals, key).join(bounds(segments, key), key, "left"), key)
    begin, end = F.greatest(F.lit(0), F.col("speech_start") - LEAD), F.least(F.col("total_ms"), F.col("speech_end") + TAIL)
    source, target = F.col("last") - F.col("first"), end - begin
    x = x.withColumn("begin", begin).withColumn("scale", F.when((source > 0) & (target > 0), clamp(target / source, *SCALE)))

    def moved(c: str, low: Column) -> Column:
        return F.when(F.col("scale").isNull(), F.col(c)).otherwise(clamp(js_round_int(F.col("begin") + (F.col(c) - F.col("first")) * F.col("scale")), low, F.col("total_ms")))

    x = x.withColumn("s", moved("start_ms", F.lit(0)))
    return x.select(key, "idx", "word", F.col("s").alias("start_ms"), moved("end_ms", F.col("s")).alias("end_ms"))


def take_anchors(heard: DataFrame, segments: DataFrame, totals: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, source_ms, target_ms): estimated times and when they were heard, from (key, idx, start_ms, end_ms, heard_start, heard_end), with the
    recording's begin and end; of equal estimated times the first counts."""
    edge = totals.join(bounds(segments, key), key, "left")
    anchor = lambda order, source, target: F.struct(order.cast("long").alias("ord"), source.cast("long").alias("source_ms"), target.cast("long").alias("target_ms"))
    begin = anchor(F.lit(-1), F.lit(0), F.greatest(F.lit(0), F.coalesce("speech_start", F.lit(0)) - LEAD))
    end = anchor(F.lit(1 << 62), F.col("total_ms"), F.least(F.col("total_ms"), F.coalesce("speech_end", "total_ms") + TAIL))
    starts, stops = anchor(2 * F.col("idx"), F.col("start_ms"), F.col("heard_start")), anchor(2 * F.col("idx") + 1, F.col("end_ms"), F.col("heard_end"))
    every = edge.select(key, F.inline(F.array(begin, end))).unionByName(heard.select(key, F.inline(F.array(starts, stops))))
    return every.groupBy(key, "source_ms").agg(F.min_by("target_ms", "ord").alias("target_ms"))


def fused(words: DataFrame, heard: DataFrame, anchors: DataFrame, totals: DataFrame, key: str = "media_id") -> DataFrame:
    """Estimated words (key, idx, start_ms, end_ms) at the times at which they were heard (``heard_start``, ``heard_end``; a word at most once), and where they were
    not, warped between the ``anchors``; within the recording, and no end before its start.  All is grouped by ``key``: what is dealt by it already is not dealt again."""
    times = words.select(key, "idx", F.posexplode(F.array("start_ms", "end_ms")).alias("side", "t"))
    warped = warp(times, anchors, key, keep=["idx", "side"])
    both = warped.unionByName(heard.select(key, "idx", "heard_start", "heard_end"), allowMissingColumns=True)
    x = both.groupBy(key, "idx").agg(F.count("side").alias("sides"), F.max("heard_start").alias("heard_start"), F.max("heard_end").alias("heard_end"), *(F.max(F.when(F.col("side") == i, F.col("warped_ms"))).alias(f"w{i}") for i in (0, 1)))
    x = x.where("sides > 0").join(totals, key)
    x = x.withColumn("s", clamp(js_round_int(F.coalesce("heard_start", "w0")), F.lit(0), F.col("total_ms")))
    return x.select(key, "idx", F.col("s").alias("start_ms"), clamp(js_round_int(F.coalesce("heard_end", "w1")), F.col("s"), F.col("total_ms")).alias("end_ms"))


def phrase_timings(texts: DataFrame, words: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, ord, phrase, start_ms, end_ms) of the phrases of ``texts`` (key, text, total_ms): each gets the part of the timed words, by number, that
    its own words are of all.  A text of one phrase, without words or without timed words is one row."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    phrases = F.filter(F.transform(F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0)), trimmed), lambda p: p != "")
    sums = words.groupBy(key).agg(F.count("*").alias("n"), F.min_by("start_ms", "idx").alias("first"), F.max_by("end_ms", "idx").alias("last"))
    x = texts.withColumn("phrases", phrases).join(sums, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    whole = (F.size("phrases") <= 1) | (F.col("n") == 0)
    counts = F.transform("phrases", lambda p: F.regexp_count(p, F.lit(WORD)).cast("long"))
    x = x.withColumn("counts", counts).withColumn("all", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))
    single = x.where(whole | (F.col("all") == 0)).select(
        key, F.lit(0).alias("ord"), trimmed(F.col("text")).alias("phrase"),
        F.when(whole, F.coalesce("first", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("start_ms"), F.when(whole, F.coalesce("last", "total_ms")).otherwise(F.col("total_ms")).alias("end_ms"),
    )
    many = x.where(~whole & (F.col("all") > 0)).select(key, "n", "all", "total_ms", F.posexplode(F.arrays_zip("phrases", "counts")).alias("ord", "x"))
    upto = F.sum("x.counts").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = lambda words_before: js_round_int(words_before / F.col("all") * F.col("n"))
    many = many.withColumn("upto", upto).withColumn("from", F.least(F.col("n") - 1, at(F.col("upto") - F.col("x.counts"))))
    many = many.withColumn("to", F.least(F.col("n") - 1, F.greatest(F.col("from") + 1, at(F.col("upto"))) - 1))
    # phrases meet the words of their numbers by medium, so that no word is sent where texts and words are dealt by it
    mark = lambda side, at: F.struct(F.lit(side).alias("side"), F.col(at).alias("idx"))
    marks = many.select(key, "ord", F.col("x.phrases").alias("phrase"), "total_ms", F.inline(F.array(mark(0, "from"), mark(1, "to")))).withColumn("phrase", F.when(F.col("side") == 0, F.col("phrase")))
    both = words.select(key, F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms").unionByName(marks, allowMissingColumns=True)
    at = Window.partitionBy(key, "idx")
    met = both.withColumn("start_ms", F.max("start_ms").over(at)).withColumn("end_ms", F.max("end_ms").over(at)).where("side is not null")
    side = lambda i, c: F.max(F.when(F.col("side") == i, F.col(c)))
    timed = met.groupBy(key, "ord").agg(F.first("phrase", ignorenulls=True).alias("phrase"), F.max("total_ms").alias("total_ms"), side(0, "start_ms").alias("start_ms"), side(1, "end_ms").alias("end_ms"))
    return single.unionByName(timed.select(key, "ord", "phrase", F.coalesce("start_ms", F.lit(0).cast("long")).alias("start_ms"), F.coalesce("end_ms", "total_ms").alias("end_ms")))


def uniform(texts: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, idx, word, start_ms, end_ms): the words of ``texts`` (key, text, total_ms) in equal parts of the recording."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    x = texts.withColumn("ws", words).select(key, (F.greatest(F.lit(1), F.col("total_ms")) / F.greatest(F.lit(1), F.size("ws"))).alias("each"), F.posexplode("ws").alias("idx", "word"))
    return x.select(key, F.col("idx").cast("long").alias("idx"), "word", js_round_int(F.col("each") * F.col("idx")).alias("start_ms"), js_round_int(F.col("each") * (F.col("idx") + 1)).alias("end_ms"))


def best_source(sources: list[DataFrame], key: str = "media_id") -> DataFrame:
    """Of word timings (key, idx, word, start_ms, end_ms) by source, most trusted first, each medium's from the first source that has any, and its number."""
    every = None
    for i, s in enumerate(sources):
        rows = s.select(key, "idx", "word", "start_ms", "end_ms", F.lit(i).alias("source"))
        every = rows if every is None else every.unionByName(rows)
    return every.withColumn("best", F.min("source").over(Window.partitionBy(key))).where("source = best").drop("best")


def estimated_observation(words: DataFrame, segments: DataFrame, totals: DataFrame, constrained: Column, key: str = "media_id") -> DataFrame:
    """Estimated words (key, idx, start_ms, end_ms) rescaled into the span of speech, unless they are ``constrained`` to it or there is none; ``totals`` (key,
    total_ms, confidence) also tells how sure they were, and the result how sure they are."""
    x = words.join(totals.join(bounds(segments, key), key, "left"), key)
    heard = F.col("speech_start").isNotNull()
    moved = lambda c: F.when(heard & ~constrained, scale_boundary(F.col(c), F.col("total_ms"), F.col("speech_start"), F.col("speech_end"))).otherwise(F.col(c))
    return x.select(key, "idx", moved("start_ms").alias("start_ms"), moved("end_ms").alias("end_ms"), js_round(F.col("confidence") * F.when(heard, 0.72).otherwise(0.8), 3).alias("confidence"))
