"""Interval, window and order-dependent operators over (media, start, end) rows and frames."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.numbers import clamp, js_round, js_round_int


def overlap_ms(words: DataFrame, segments: DataFrame, key: str = "media_id") -> DataFrame:
    """Each word (key, idx, start_ms, end_ms, …) with the milliseconds of speech in it, 0 where there is none.

    Speech before a time t is the sum of t - start over the segments that began, less that of t - end over those that ended; so one ordered merge of segments' and
    words' times tells it by running counts and sums, and no word meets a segment.  Where segments overlap each counts.
    """
    word = F.struct(*words.columns)
    asked = words.select(key, F.posexplode(F.array("start_ms", "end_ms")).alias("side", "t"), F.lit(0).alias("d"), word.alias("w"))
    marks = segments.select(key, F.posexplode(F.array("start_ms", "end_ms")).alias("side", "t")).withColumn("d", F.when(F.col("side") == 0, 1).otherwise(-1))
    both = asked.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    speech = F.sum("d").over(before) * F.col("t") - F.sum(F.col("d") * F.col("t")).over(before)
    x = both.withColumn("speech", speech).where("w is not null").groupBy(key, F.col("w.idx").alias("idx"))
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("speech")))
    return x.agg(F.first("w").alias("w"), (at(1) - at(0)).cast("long").alias("overlap_ms")).select(*(F.col(c if c == key else f"w.{c}") for c in words.columns), "overlap_ms")


def speech_overlap(words: DataFrame, segments: DataFrame) -> DataFrame:
    """``ratio``: the part of each word that lies in speech, at most 1, and 0 for words without length."""
    length = F.col("end_ms") - F.col("start_ms")
    return overlap_ms(words, segments).withColumn("ratio", F.when(length > 0, F.least(F.lit(1.0), F.col("overlap_ms") / length)).otherwise(F.lit(0.0)))


def assess_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Per medium: plausible words (60 to 4000 ms, with letters), whether speech detection may gate them (segments exist and half of
    the plausible words have 0.35 of overlap), how many are accepted, and the status."""
    length = F.col("end_ms") - F.col("start_ms")
    x = speech_overlap(words, segments).withColumn("plausible", length.between(60, 4000) & F.col("word").rlike(r"[\p{L}\p{N}]"))
    supported = F.col("plausible") & (F.col("ratio") >= 0.35)
    x = x.groupBy("media_id").agg(F.count("*").alias("words"), F.count_if("plausible").alias("plausible"), F.count_if(supported).alias("supported"), F.coalesce(F.sum(F.when(F.col("plausible"), F.col("ratio"))), F.lit(0.0)).alias("ratios"))
    speech = segments.groupBy("media_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    x = x.join(speech, "media_id", "left")
    gate = F.col("speech_ms").isNotNull() & (F.col("supported") >= 0.5 * F.col("plausible"))
    x = x.withColumn("gated", F.coalesce(gate, F.lit(False))).withColumn("accepted", F.when(F.col("gated"), F.col("supported")).otherwise(F.col("plausible")))
    rate = lambda n, d: F.when(d > 0, js_round(n / d, 3)).otherwise(F.lit(0.0))
    x = x.withColumn("acceptance", rate(F.col("accepted"), F.col("words"))).withColumn("overlap", rate(F.col("ratios"), F.col("plausible")))
    x = x.withColumn("per_minute", F.when(F.col("speech_ms") > 0, js_round(F.col("accepted") * 60000 / F.col("speech_ms"), 1)).otherwise(F.lit(0.0)))
    bad = (F.col("accepted") == 0) | ~F.col("gated") | (F.col("acceptance") < 0.5) | (F.col("overlap") < 0.5) | (F.col("per_minute") > 360)
    warn = (F.col("acceptance") < 0.7) | (F.col("overlap") < 0.65) | (F.col("per_minute") > 320)
    return x.withColumn("status", F.when(bad, "insufficient").when(warn, "review").otherwise("accepted"))


def merge_segments(segments: DataFrame, pad: int = 140, gap: int = 180, total: Column | None = None, key: str = "media_id") -> DataFrame:
    """Padded, clamped to [0, total], and merged where the next starts within ``gap`` of the furthest end so far."""
    start, end = F.greatest(F.lit(0), F.col("start_ms") - pad), F.col("end_ms") + pad
    x = segments.select(key, start.alias("s"), (end if total is None else F.least(end, total)).alias("e")).where("e > s")
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("opens", F.coalesce((F.col("s") > reach + gap).cast("int"), F.lit(1)))
    x = x.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "island").agg(F.min("s").cast("long").alias("start_ms"), F.max("e").cast("long").alias("end_ms")).drop("island")


def pauses(segments: DataFrame, least: int = 150, key: str = "media_id") -> DataFrame:
    before = F.lag("end_ms").over(Window.partitionBy(key).orderBy("start_ms", "end_ms"))
    x = segments.select(key, before.alias("start_ms"), F.col("start_ms").alias("end_ms"))
    return x.where(F.col("end_ms") - F.col("start_ms") >= least)


def activity_threshold(floor: Column) -> Column:
    return js_round(clamp(floor + 12, -45.0, -24.0), 1)


def energy_segments(frames: DataFrame, threshold: float | Column, hop_ms: float = 1024 / 48, least: int = 60, key: str = "media_id") -> DataFrame:
    """Maximal runs of frames at or above the threshold that last ``least`` ms: gaps and islands."""
    on = frames.where(F.col("level") >= threshold)
    island = F.col("idx") - F.row_number().over(Window.partitionBy(key).orderBy("idx"))
    x = on.withColumn("island", island).groupBy(key, "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    x = x.select(key, js_round_int(F.col("first") * hop_ms).alias("start_ms"), js_round_int((F.col("last") + 1) * hop_ms).alias("end_ms"))
    return x.where(F.col("end_ms") - F.col("start_ms") >= least)


def energy_envelope(frames: DataFrame, width: int = 5, key: str = "media_id") -> DataFrame:
    """The mean level of every ``width`` frames, to one place."""
    x = frames.groupBy(key, F.floor(F.col("idx") / width).cast("long").alias("point")).agg(F.avg("level").alias("level"))
    return x.withColumn("level", js_round("level", 1))


def hysteresis(frames: DataFrame, frame_ms: int = 32, enter: float = 0.5, stay: float = 0.35, silence_ms: int = 300, least_ms: int = 200, pad_ms: int = 30, key: str = "media_id") -> DataFrame:
    """Speech segments of frame probabilities (key, idx, p): opened at ``enter``, kept at ``stay``, closed by ``silence_ms`` below it (ending where
    the silence began) or by the end of the frames, dropped if shorter than ``least_ms``, padded and clamped.  One pass over each medium's ordered frames."""
    schema = StructType([frames.schema[key], StructField("start_ms", LongType()), StructField("end_ms", LongType())])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medium, i, start, quiet = None, 0, None, None
        held: list[tuple[int, int]] = []  # closed segments whose padding may go beyond the frames

        def told(most: int | None) -> list[tuple]:
            """Segments that end before ``most``, or all, clamped to the frames there were."""
            out, limit = [], i * frame_ms
            while held and (most is None or held[0][1] * frame_ms + pad_ms <= most):
                s, e = held.pop(0)
                if (e - s) * frame_ms >= least_ms:
                    out.append((medium, max(0, s * frame_ms - pad_ms), min(limit, e * frame_ms + pad_ms)))
            return out

        for batch in batches:
            out: list[tuple] = []
            for k, p in zip(batch.column(key).to_pylist(), batch.column("p").to_pylist(), strict=True):
                if k != medium:
                    if start is not None:
                        held.append((start, i))
                    out += told(None)
                    medium, i, start, quiet = k, 0, None, None
                loud = p is not None and p >= (enter if start is None else stay)
                if loud:
                    start, quiet = i if start is None else start, None
                elif start is not None:
                    quiet = i if quiet is None else quiet
                    if (i - quiet + 1) * frame_ms >= silence_ms:
                        held.append((start, quiet))
                        start = quiet = None
                i += 1
                out += told(i * frame_ms)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if start is not None:
            held.append((start, i))
        out = told(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return frames.select(key, "idx", "p").repartition(key).sortWithinPartitions(key, "idx").select(key, "p").mapInArrow(each, schema)


def resolve_overlaps(timings: DataFrame, key: str = "media_id") -> DataFrame:
    """Neighbours that overlap meet at the clamped middle; each repair feeds the next, so this is one pass over each medium's ordered
    words, of which a worker holds the last alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the word whose end the next one may move: key, start, end, idx
        schema = None
        for batch in batches:
            schema = batch.schema
            out: list[list] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                this = list(row)
                if held is not None:
                    if held[0] == this[0] and held[2] > this[1]:
                        edge = max(held[1] + 1, min(this[2] - 1, (held[2] + this[1] + 1) // 2))
                        held[2] = this[1] = edge
                    out.append(held)
                held = this
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held, schema, strict=True)], schema=schema)

    x = timings.select(key, F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("idx").cast("long").alias("idx"))
    ordered = x.repartition(key).sortWithinPartitions(key, "start_ms", "end_ms", "idx")
    return ordered.mapInArrow(each, x.schema).select(key, "idx", "start_ms", "end_ms")


def accepted_chunks(chunks: DataFrame, total_ms: int = 1 << 40, key: str = "media_id") -> DataFrame:
    """(key, idx, start_ms, end_ms) of a recogniser's chunks (key, idx, start_s, end_s), in order: none begins before the last accepted one ends or ends after the
    recording, and what has no length then is left out.  One pass, of which a worker holds one number."""
    schema = StructType([chunks.schema[key], chunks.schema["idx"], StructField("start_ms", LongType()), StructField("end_ms", LongType())])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medium, last = None, 0
        for batch in batches:
            out = []
            for k, i, start, end in zip(*(batch.column(c).to_pylist() for c in (key, "idx", "start_s", "end_s")), strict=True):
                if k != medium:
                    medium, last = k, 0
                if start is None or end is None:
                    continue
                a, b = max(last, math.floor(start * 1000 + 0.5)), min(total_ms, math.floor(end * 1000 + 0.5))
                if b > a:
                    out.append((k, i, a, b))
                    last = b
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return chunks.select(key, "idx", "start_s", "end_s").repartition(key).sortWithinPartitions(key, "idx").mapInArrow(each, schema)


def word_at(words: DataFrame, times: DataFrame, key: str = "media_id") -> DataFrame:
    """The word index at each time ``t``: the word that contains it (both ends included), else the one before, -1 before the first.

    As of: times and words are merged in order and each time takes the last word that began, so that no pairs are made.
    """
    marks = words.select(key, F.col("start_ms").alias("t"), F.lit(0).alias("asked"), "idx")
    both = marks.unionByName(times.select(key, "t", F.lit(1).alias("asked"), F.lit(None).cast("long").alias("idx")))
    order = Window.partitionBy(key).orderBy("t", "asked", "idx").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("idx", F.last("idx", ignorenulls=True).over(order)).where("asked = 1")
    return found.select(key, "t", F.coalesce("idx", F.lit(-1).cast("long")).alias("idx"))


def warp(times: DataFrame, anchors: DataFrame, key: str = "media_id", keep: Sequence[str] = ()) -> DataFrame:
    """Piecewise-linear interpolation of ``t`` between anchors (source_ms, target_ms), clamped to the first and last.  The columns ``keep`` of ``times`` stay.

    Each anchor knows the next one, and the first stands before all times too; so one as-of merge of running values tells both anchors of a time, and no
    row looks through those after it.
    """
    order = Window.partitionBy(key).orderBy("source_ms")
    a = anchors.select(key, "source_ms", "target_ms", F.lead("source_ms").over(order).alias("next_source"), F.lead("target_ms").over(order).alias("next_target"), (F.row_number().over(order) == 1).alias("opens"))
    at = F.explode(F.when(F.col("opens"), F.array(F.lit(None).cast(times.schema["t"].dataType), F.col("source_ms"))).otherwise(F.array("source_ms")))  # nulls come first
    a = a.select(key, at.alias("t"), F.lit(0).alias("asked"), F.struct("source_ms", "target_ms", "next_source", "next_target").alias("a"))
    both = a.unionByName(times.select(key, "t", F.lit(1).alias("asked"), *keep), allowMissingColumns=True)
    low = F.last("a", ignorenulls=True).over(Window.partitionBy(key).orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0))
    x = both.withColumn("a", low).where("asked = 1")
    span = F.col("a.next_source") - F.col("a.source_ms")
    part = F.when(span > 0, (F.col("t") - F.col("a.source_ms")) / span).otherwise(F.lit(0.0))
    rise = F.coalesce(F.col("a.next_target") - F.col("a.target_ms"), F.lit(0))
    return x.select(key, *keep, "t", js_round_int(F.col("a.target_ms") + clamp(part, 0.0, 1.0) * rise).alias("warped_ms"))


def increasing_anchors(anchors: DataFrame, key: str = "media_id", order: str = "target_ms") -> DataFrame:
    """Anchors in the order of ``source_ms``, each later in it than the one before; of equal ones the first by ``order``.

    Targets may fall or repeat: what is estimated orders the anchors, what was heard does not.
    """
    x = anchors.withColumn("s", F.lag("source_ms").over(Window.partitionBy(key).orderBy("source_ms", order)))
    return x.where(F.col("s").isNull() | (F.col("source_ms") > F.col("s"))).drop("s")


def capture_time(times: DataFrame, timeline: DataFrame, key: str = "media_id") -> DataFrame:
    """Time ``t`` of speech alone, in the recording: through the segments' running lengths; beyond them, the last end."""
    order = Window.partitionBy(key).orderBy("start_ms")
    length = F.col("end_ms") - F.col("start_ms")
    x = timeline.withColumn("before", F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a = x.select(key, F.col("before").alias("t"), F.lit(0).alias("asked"), F.struct("before", "start_ms", "end_ms").alias("a"))
    both = a.unionByName(times.select(key, "t", F.lit(1).alias("asked"), F.lit(None).cast(a.schema["a"].dataType).alias("a")))
    last = F.last("a", ignorenulls=True).over(Window.partitionBy(key).orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("a", last).where("asked = 1 and a is not null")
    return both.select(key, "t", F.least(F.col("a.end_ms"), F.col("a.start_ms") + F.col("t") - F.col("a.before")).cast("long").alias("capture_ms"))


def scale_boundary(t: Column, length: Column, start: Column, end: Column) -> Column:
    return js_round_int(start + t / F.greatest(length, F.lit(1)) * (end - start))


def segment_summary(segments: DataFrame, totals: DataFrame, key: str = "media_id") -> DataFrame:
    """Leading and trailing silence and speech of each medium with its ``total_ms``; without segments both are the total."""
    sums = segments.groupBy(key).agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    x = totals.join(sums, key, "left")
    cover = F.when(F.col("total_ms") > 0, js_round(F.least(F.lit(1.0), F.col("speech_ms") / F.col("total_ms")), 3))
    return x.select(key, F.coalesce("s", "total_ms").cast("long").alias("leading_ms"), F.greatest(F.lit(0), F.coalesce(F.col("total_ms") - F.col("e"), F.col("total_ms"))).cast("long").alias("trailing_ms"), F.coalesce("speech_ms", F.lit(0)).cast("long").alias("speech_ms"), F.coalesce(cover, F.lit(0.0)).alias("coverage"))


def word_clips(words: DataFrame, total: Column, pad: int = 60, keep: Sequence[str] = ()) -> DataFrame:
    """Clips of words, padded and clamped, numbered from 1, with a path of four digits and a slug; the columns ``keep`` stay."""
    from ..functions.text import slug

    number = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "idx"))
    name = F.coalesce(F.nullif(slug("word"), F.lit("")), F.lit("word"))
    return words.select("media_id", *keep, number.cast("long").alias("sequence"), "word", F.greatest(F.lit(0), F.col("start_ms") - pad).cast("long").alias("clip_start_ms"), F.least(total, F.col("end_ms") + pad).cast("long").alias("clip_end_ms"), F.concat(F.lit("words/"), F.lpad(number.cast("string"), 4, "0"), F.lit("-"), name, F.lit(".wav")).alias("path"))
