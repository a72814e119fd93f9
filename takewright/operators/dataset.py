"""Dataset packages of keeper takes: which files one holds, their contents, its reports, and each take's own folder of documents.

A plan is rows (path, kind, content): nothing of a package passes through the driver, and ``sources.packages`` writes them.  What the dataset tells of all takes, a line each, is
cut into files of ``per_file`` sessions, so that no file grows with the dataset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import js_round
from . import dsp

#: Names of methods, formats and reports.
PHONEMES, FORMAT, ALIGNMENT = "voice.dataset_phonemes.v1", "wav_pcm_mono_48khz", "text_derived_estimate"
REPORTS = ("audio_quality", "transcript_alignment", "phonetic_coverage", "intent_balance", "prosody_distribution", "dataset_readiness")


def slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-zA-Z0-9._-]+", "-")


def kept(takes: DataFrame, prompts: DataFrame) -> DataFrame:
    """Keeper takes with what their prompts ask for (nulls where the corpus has none), ``take_id``, ``slug`` and ``file_name``."""
    asked = prompts.select("prompt_id", "language", "pace", "energy", "intent")
    take_id = F.concat_ws("-", "session_id", "take_ord")
    x = takes.where("rating = 'keeper'").join(asked, "prompt_id", "left")
    return x.withColumns({"take_id": take_id, "slug": slug(take_id), "file_name": F.concat(take_id, F.lit(".wav"))})


def metadata(x: DataFrame) -> Column:
    take = {"takeId": "take_id", "sessionId": "session_id", "promptId": "prompt_id", "durationMs": "duration_ms", "transcript": "text", "pace": "pace", "energy": "energy", "rating": "rating"}
    return F.to_json(F.struct(*(F.col(c).alias(n) for n, c in take.items())), {"ignoreNullFields": "false"})


def word_map(x: DataFrame) -> Column:
    """Words of the text with estimated places: equal shares of the take, in order."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    # an array of one, so that words are split once and not once a word
    given = F.array(F.struct(words.alias("words"), F.col("duration_ms").cast("double").alias("ms")))
    place = lambda g, i: F.floor(g["ms"] / F.size(g["words"]) * i + 0.5)
    each = lambda g: F.transform(g["words"], lambda w, i: F.struct(w.alias("word"), F.lower(w).alias("normalized"), place(g, i).alias("startMs"), place(g, i + 1).alias("endMs")))
    return F.element_at(F.transform(given, each), 1)


def phonemes(x: DataFrame) -> Column:
    doc = [F.lit(PHONEMES).alias("schemaVersion"), F.col("take_id").alias("takeId"), F.col("prompt_id").alias("promptId"), "language", F.col("duration_ms").alias("durationMs"), F.lit(ALIGNMENT).alias("alignmentSource"), word_map(x).alias("wordPhonemeMap")]
    return F.to_json(F.struct(*doc), {"ignoreNullFields": "false"})


def manifest_line(x: DataFrame) -> Column:
    audio = F.struct(F.concat(F.lit("raw/"), "slug", F.lit(".wav")).alias("raw_path"), F.concat(F.lit("processed/"), "slug", F.lit(".wav")).alias("processed_path"), F.lit(FORMAT).alias("format"), F.col("byte_size").alias("byte_length"), "sha256")
    return F.to_json(F.struct("take_id", "session_id", "speaker_id", "language", "prompt_id", audio.alias("audio"), F.col("text").alias("transcript"), "duration_ms", "intent", "pace", "energy"), {"ignoreNullFields": "false"})


def sharded(lines: DataFrame, folder: str, per_file: int, order: list[str]) -> DataFrame:
    """(path, content) of rows with a ``line`` each: files of ``per_file`` sessions, lines in order and each ended."""
    name = F.concat(F.lit(f"{folder}-"), F.lpad(F.floor(F.col("session_id") / per_file).cast("string"), 8, "0"), F.lit(".jsonl"))
    some = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(name.alias("path")).agg(some.alias("x")).select("path", F.concat(F.array_join(F.col("x.line"), "\n"), F.lit("\n")).alias("content"))


def reports(takes: DataFrame, prompts: DataFrame) -> DataFrame:
    """(report, key, value): the figures of all six reports, in one pass over takes and prompts; shares in per cent."""
    asked = prompts.select("prompt_id", "intent", "pace", F.lit(True).alias("known"))
    x = takes.join(asked, "prompt_id", "left").withColumn("keeper", F.col("rating") == "keeper")
    keeper = F.col("keeper") & F.col("known")
    wpm = F.when(F.col("duration_ms") > 0, F.col("words") * 60000 / F.col("duration_ms"))
    figures = {
        ("audio_quality", "take_count"): F.count("*"), ("audio_quality", "keeper_count"): F.count_if("keeper"), ("audio_quality", "total_duration_ms"): F.coalesce(F.sum("duration_ms"), F.lit(0)),
        ("transcript_alignment", "aligned_takes"): F.count_if(F.col("words") > 0), ("transcript_alignment", "words"): F.coalesce(F.sum("words"), F.lit(0)),
        ("phonetic_coverage", "distinct_prompts"): F.countDistinct(F.when(keeper, F.col("prompt_id"))),
        ("intent_balance", "intents"): F.countDistinct(F.when(keeper, F.col("intent"))),
        ("prosody_distribution", "mean_words_per_minute"): F.coalesce(js_round(F.avg(F.when(F.col("keeper"), wpm)), 1), F.lit(0.0)),
        ("dataset_readiness", "keeper_share"): F.when(F.count("*") > 0, F.floor(F.count_if("keeper") * 100 / F.count("*") + 0.5)).otherwise(0),
    }
    whole = x.agg(*(v.cast("double").alias(f"{r}|{k}") for (r, k), v in figures.items()))
    one = F.explode(F.array(*(F.struct(F.lit(r).alias("report"), F.lit(k).alias("key"), F.col(f"{r}|{k}").alias("value")) for r, k in figures)))
    counts = [("intent_balance", "intent"), ("prosody_distribution", "pace")]
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("report"), F.concat(F.lit(f"{c}:"), c).alias("key")) for r, c in counts)))
    by = x.where(keeper).select(each.alias("e")).groupBy("e.report", "e.key").agg(F.count("*").cast("double").alias("value"))
    return whole.select(one.alias("e")).select("e.*").unionByName(by.where("key is not null"))


def report_files(rows: DataFrame) -> DataFrame:
    """A file for each report, of its figures by key; a report without any is an empty object."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(r,) for r in REPORTS], "report string")
    some = rows.groupBy("report").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
    body = F.coalesce(F.to_json("m"), F.lit("{}"))
    return names.join(some, "report", "left").select(F.concat(F.lit("reports/report."), "report", F.lit(".json")).alias("path"), F.lit("report").alias("kind"), body.cast("binary").alias("content"))


def plan(takes: DataFrame, prompts: DataFrame, recordings: DataFrame, processed: bool = True, per_file: int = 1000) -> DataFrame:
    """(path, kind, content) of the package of ``takes``' keepers; content is null where the store has no recording of that name.

    ``takes``: session_id, take_ord, speaker_id, prompt_id, rating, text, words, duration_ms; ``prompts``: prompt_id, language, pace, energy, intent;
    ``recordings``: file_name, content.  Of each keeper there are its raw recording, its voice (``processed``), transcript, metadata and phonemes;
    of all, the training manifest, the sessions, six reports and a short description.  A null text is an empty transcript.
    """
    x = kept(takes, prompts).withColumn("text", F.coalesce("text", F.lit("")))
    held = x.join(recordings.select("file_name", "content"), "file_name", "left").withColumns({"byte_size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})
    documents = {"raw": ("wav", F.col("content")), "transcripts": ("txt", F.col("text")), "metadata": ("json", metadata(x)), "phonemes": ("json", phonemes(x))}
    if processed:
        held = held.withColumn("voice", dsp.processed_voice("content").getField("content"))
        documents["processed"] = ("wav", F.col("voice"))
    each = F.explode(F.array(*(F.struct(F.concat(F.lit(f"{k}/"), "slug", F.lit(f".{end}")).alias("path"), F.lit(k).alias("kind"), c.cast("binary").alias("content")) for k, (end, c) in documents.items())))
    lines = sharded(held.select("session_id", "take_ord", manifest_line(held).alias("line")), "manifests/training_manifest", per_file, ["session_id", "take_ord"])
    session = takes.groupBy("session_id").agg(F.count("*").alias("takeCount"), F.count_if(F.col("rating") == "keeper").alias("keeperCount"))
    sessions = sharded(session.select("session_id", F.to_json(F.struct(F.col("session_id").alias("id"), "takeCount", "keeperCount")).alias("line")), "sessions/sessions", per_file, ["session_id"])
    readme = takes.agg(F.concat(F.lit("# Dataset\n\nKeeper takes: "), F.count_if(F.col("rating") == "keeper"), F.lit(" / "), F.count("*"), F.lit("\n")).alias("text"))
    parts = [held.select(each.alias("e")).select("e.*"), report_files(reports(takes, prompts)), readme.select(F.lit("README.md").alias("path"), F.lit("readme").alias("kind"), F.col("text").cast("binary").alias("content"))]
    parts += [p.select("path", F.lit(k).alias("kind"), F.col("content").cast("binary").alias("content")) for k, p in (("manifest", lines), ("sessions", sessions))]
    return reduce(DataFrame.unionByName, parts)


def take_folders(takes: DataFrame, prompts: DataFrame, recordings: DataFrame) -> DataFrame:
    """(session_id, path, content): each take's own documents under its session's folder, with its audio where the store has it, and for each session a
    ``manifest.json`` that lists them with sizes and digests."""
    every = takes.withColumn("rating_", F.col("rating")).withColumn("rating", F.lit("keeper"))
    x = kept(every, prompts).withColumn("rating", F.col("rating_")).withColumn("text", F.coalesce("text", F.lit("")))
    x = x.join(recordings.select("file_name", F.col("content").alias("audio")), "file_name", "left")
    documents = {"take.json": F.to_json(F.struct(F.col("take_id").alias("id"), F.col("prompt_id").alias("promptId"), F.col("duration_ms").alias("durationMs"))), "transcript.txt": F.col("text"), "timing.json": F.to_json(F.struct(word_map(x).alias("words"))), "intent.json": F.to_json(F.struct("intent", "pace", "energy"), {"ignoreNullFields": "false"}), "quality.json": F.to_json(F.struct("rating"), {"ignoreNullFields": "false"})}
    files = [F.struct(F.lit("audio.wav").alias("name"), F.col("audio").alias("content")), *(F.struct(F.lit(n).alias("name"), c.cast("binary").alias("content")) for n, c in documents.items())]
    each = x.select("session_id", "slug", F.explode(F.array(*files)).alias("f")).where("f.content is not null")
    return each.select("session_id", F.concat(F.lit("takes/"), "slug", F.lit("/"), F.col("f.name")).alias("path"), F.col("f.content").alias("content"))


def with_manifests(files: DataFrame) -> DataFrame:
    """(path, byte_size, sha256, content) of ``take_folders`` and of each session's manifest, after its other files."""
    told = files.withColumns({"byte_size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})
    some = F.array_sort(F.collect_list(F.struct("path", F.col("byte_size").alias("byteLength"), "sha256")))
    manifests = told.groupBy("session_id").agg(F.to_json(F.struct(some.alias("artifacts"))).cast("binary").alias("content"))
    manifests = manifests.select("session_id", F.lit("manifest.json").alias("path"), F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")
    return told.unionByName(manifests).select(F.concat_ws("/", "session_id", "path").alias("path"), "byte_size", "sha256", "content")
