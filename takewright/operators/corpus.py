"""Scripts and subtitles as prompts: segmentation, cues, labels, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LABEL = r"^\s*([\p{L}\p{N}][\p{L}\p{N} _-]{0,31})\s*:\s+"


def strip_speaker_labels(lines: DataFrame, key: str) -> DataFrame:
    """``label`` and ``text`` without it: a label counts if it occurs twice in its script, whatever its case, or is in capitals."""
    label = F.trim(F.regexp_extract("text", LABEL, 1))
    x = lines.withColumn("label", F.when(F.col("text").contains(":"), label).otherwise("")).withColumn("label", F.when(F.col("label").rlike(r"\p{L}"), F.col("label")).otherwise(""))
    count = F.count(F.when(F.col("label") != "", True)).over(Window.partitionBy(key, F.lower("label")))
    drop = (F.col("label") != "") & ((count >= 2) | (F.upper("label") == F.col("label")))
    return x.withColumn("text", F.when(drop, F.trim(F.regexp_replace("text", LABEL, ""))).otherwise(F.col("text")))


def pack_sentences(docs: DataFrame, key: str, most: int = 24) -> DataFrame:
    """Pieces that end in . ! ? ; or :, packed while they have ``most`` words together: a fold over each text's pieces."""
    return docs.select(key, F.posexplode(packed(F.col("text"), most)).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))


def packed(text: Column, most: int = 24) -> Column:
    """Pieces of ``text``, packed; as the whole text is collapsed first, they are cleaned (``text.clean_segment``) without patterns, and their words are their spaces and one."""

    def clean(p: Column) -> Column:
        bare = F.ltrim(p)
        return F.when(p.contains("﻿"), X.clean_segment(p)).when(bare.startswith("- ") | bare.startswith("* ") | bare.startswith("• "), F.trim(F.substring(bare, 3, 1 << 30))).otherwise(F.trim(bare))

    pieces = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit("[^.!?;:]+[.!?;:]?"), F.lit(0)), clean)
    counted = F.transform(F.array_remove(pieces, ""), lambda s: F.struct(s.alias("s"), (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).alias("n")))
    start = F.struct(F.lit("").alias("now"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    state = lambda now, n, out: F.struct(now.alias("now"), n.alias("n"), out.alias("out"))

    def step(a: Column, p: Column) -> Column:
        more = state(F.concat(a["now"], F.lit(" "), p["s"]), a["n"] + p["n"], a["out"])
        return F.when(a["now"] == "", state(p["s"], p["n"], a["out"])).when(a["n"] + p["n"] <= most, more).otherwise(state(p["s"], p["n"], F.array_append(a["out"], a["now"])))

    return F.aggregate(counted, start, step, lambda a: F.when(a["now"] == "", a["out"]).otherwise(F.array_append(a["out"], a["now"])))


def split_long(segments: DataFrame, most: int = 32, size: int = 24, place: str | None = None) -> DataFrame:
    """Segments of more than ``most`` words in chunks of ``size``; other columns go to each chunk, and as ``place``, if named, its number."""
    words = F.col("its_words")
    chunks = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(size)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    parts = F.when(F.size(words) > most, chunks).otherwise(F.array("text"))
    x = segments.withColumn("its_words", F.array_remove(F.split("text", r"\s+"), ""))  # split once
    if place is None:
        return x.withColumn("text", F.explode(parts)).drop("its_words")
    return x.select(*(c for c in segments.columns if c != "text"), F.posexplode(parts).alias(place, "text"))


def subtitle_cues(files: DataFrame, key: str) -> DataFrame:
    """Cues of subtitle texts: a timing line opens one, an empty line or a block header closes it, lines outside are ignored."""
    x = files.select(key, F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    header = F.col("line").rlike(r"(?i)^(?:WEBVTT|NOTE|STYLE|REGION)(?:\s|$)")
    timing = X.is_timing_line("line")
    mark = F.when((F.col("line") == "") | header, "close").when(timing, "open")
    order = Window.partitionBy(key).orderBy("pos")
    x = x.withColumn("mark", mark).withColumn("state", F.last("mark", ignorenulls=True).over(order)).withColumn("cue", F.count(F.when(timing, True)).over(order))
    x = x.where((F.col("state") == "open"))
    line = F.when(F.col("mark").isNull(), F.struct("pos", "line"))
    x = x.groupBy(key, "cue").agg(F.first(F.when(F.col("mark") == "open", X.timing("line")), ignorenulls=True).alias("at"), F.array_sort(F.collect_list(line)).alias("lines"))
    text = X.clean_subtitle(F.array_join(F.transform("lines", lambda v: v["line"]), " "))
    return x.select(key, F.col("cue").cast("long").alias("cue"), F.col("at.start_ms").alias("start_ms"), F.col("at.end_ms").alias("end_ms"), text.alias("text")).where("text <> ''")


def segments(scripts: DataFrame, key: str, name: str = "source_name", place: str | None = None) -> DataFrame:
    """Prompt segments of scripts: cues of subtitles, else lines if three or more have words, else packed prose; labels stripped, long ones cut."""
    x = scripts.withColumn("text", X.normalize_corpus_text("text")).withColumn("subtitle", X.is_subtitle(F.col("text"), F.coalesce(name, F.lit(""))))
    none = F.lit(None).cast("long")
    cues = subtitle_cues(x.where("subtitle"), key).select(key, F.col("cue").alias("ord"), "text", "start_ms", "end_ms")
    # lines and prose in one pass
    x = x.withColumn("lines", X.clean_lines("text"))
    told = F.when(F.col("subtitle"), F.array().cast("array<string>")).when(F.size("lines") >= 3, F.col("lines")).otherwise(packed(F.col("text")))
    others = x.select(key, F.posexplode(told).alias("ord", "text")).select(key, F.col("ord").cast("long"), "text", none.alias("start_ms"), none.alias("end_ms"))
    return split_long(strip_speaker_labels(cues.unionByName(others), key), place=place)


def prompt_defaults(words: Column) -> list[Column]:
    """Bounds and difficulty of a prompt without its own."""
    low = F.greatest(F.lit(900), F.floor(260 * words + 0.5)).cast("long")
    high = F.greatest(low + 1100, F.floor(920 * words + 0.5).cast("long"))
    return [low.alias("min_ms"), high.alias("max_ms"), F.when(words > 26, "high").when(words > 14, "medium").otherwise("low").alias("difficulty")]


def canonical_bounds(words: Column) -> list[Column]:
    """Shortest and longest duration of a prompt of the built-in corpus, in ms."""
    return [F.greatest(F.lit(1500).cast("long"), words * 230).alias("min_ms"), F.greatest(F.lit(6500).cast("long"), words * 740).alias("max_ms")]


def infer_smile(tags: Column) -> Column:
    some = F.array(*map(F.lit, ["slight_smile", "professional_smile", "light_smile", "smile"]))
    return F.when(F.array_contains(tags, "audible_smile"), "audible").when(F.arrays_overlap(tags, some), "slight").otherwise("none")


def infer_pause_style(pace: Column, instruction: Column) -> Column:
    return F.when(pace.isin("fast", "medium_fast"), "urgent").when(F.lower(instruction).contains("pause"), "thoughtful").otherwise("structured")


def infer_pitch(energy: Column) -> Column:
    return F.when(energy.isin("high", "medium_high"), "slightly_lifted").when(energy == "low", "lower_stable").otherwise("natural")


def infer_pitch_variation(primary: Column) -> Column:
    return F.when(primary.rlike("thinking|question|surprise|narrative"), "medium").otherwise("low")


def infer_attack(primary: Column) -> Column:
    return F.when(primary.rlike("direct|urgent|firm|critique"), "assertive").when(primary.rlike("warm|thinking|narrative|encouragement"), "soft").otherwise("clean")


def corpus_id(mode: str, language: Column, text: Column) -> Column:
    return X.hash_corpus_text(F.concat_ws(":", F.lit(mode), language, X.normalize_corpus_text(text)))


CORPUS_VERSION = "0.1.0"


def local_corpora(scripts: DataFrame, key: str, mode: str, name: str = "source_name") -> tuple[DataFrame, DataFrame]:
    """Corpora of scripts (``key``, text, language, ``name``), one each: their prompts, and their summaries.

    Ids are made of a hash of mode, language and normalised text; prompts are numbered from 1 with three digits at least, in order, and have bounds and a difficulty of their own.  A script without
    segments has no corpus.
    """
    from pyspark.sql import Window

    ids = scripts.select(key, "language", F.col(name).alias("source_name"), corpus_id(mode, F.col("language"), F.col("text")).alias("hash"))
    x = segments(scripts, key, name, "chunk").withColumn("words", F.size(X.tokens_by_space("text")).cast("long"))
    order = Window.partitionBy(key).orderBy("ord", "chunk")
    x = x.withColumn("place", F.row_number().over(order)).join(ids, key)
    place = F.col("place").cast("string")
    ordinal = F.lpad(place, F.greatest(F.lit(3), F.length(place)), F.lit("0"))
    prompts = x.select(
        key, F.concat(F.lit(f"corpus.local.{mode}."), "hash").alias("corpus_id"), F.concat_ws(".", F.lit("scenario"), "language", F.lit(mode), "hash").alias("scenario_id"), F.concat_ws(".", F.lit("prompt"), "language", F.lit(mode), "hash", ordinal).alias("prompt_id"),
        "language", "text", "words", "start_ms", "end_ms", *prompt_defaults(F.col("words")),
    )
    totals = prompts.groupBy(key, "corpus_id").agg(F.count("*").alias("prompts"), F.count("start_ms").alias("timed"), F.sum("words").alias("words"))
    summary = totals.join(ids.select(key, "source_name"), key).select(key, "corpus_id", F.lit(CORPUS_VERSION).alias("version"), F.nullif(F.trim("source_name"), F.lit("")).alias("source_name"), "prompts", "timed", "words")
    return prompts, summary
