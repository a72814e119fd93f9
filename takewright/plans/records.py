"""Queries of records: consents, licenses, scopes, archive entries, speakers, manifests, workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..functions import text as X
from ..operators import corpus, imports, package, records
from ..sources import archives, workspaces
from ..streaming import live
from .base import Tables, query
from .further import recognized
from .scalar import TOKENS, js


def texts(*x: Column | str) -> Column:
    return F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))


def nth(x: str, n: int, k: int) -> Column:
    return F.col(x) % n == k


CONSENT = "consent_id % 7 = 0 OR (consent_id % 7 = 1 AND status <> 'unknown')"


@query("c06_q12_consent_records", f"SELECT consent_id, {CONSENT} AS valid FROM consents")
def consent_records(t: Tables) -> DataFrame:
    """Seven kinds of records: whole ones, and with an unknown status renamed, a blank speaker, no grants, a blank grant, another source, no version."""
    i = "consent_id"
    r = F.struct(
        F.concat(F.lit("c"), i).alias("consentId"), F.when(nth(i, 7, 2), " ").otherwise("s").alias("speakerId"), F.when(~nth(i, 7, 6), "1").alias("policyVersion"), F.when(nth(i, 7, 1) & (F.col("status") == "unknown"), "perhaps").otherwise(F.col("status")).alias("status"),
        F.when(nth(i, 7, 4), texts("a", " ")).when(~nth(i, 7, 3), texts("a")).alias("grants"), F.array().cast("array<string>").alias("restrictions"), F.when(nth(i, 7, 5), "other").otherwise(records.SOURCE).alias("source"),
    )
    return t.consents.select("consent_id", records.is_consent(r).alias("valid"))


@query("c07_license_records", "SELECT license_id, license_id % 4 = 0 OR (license_id % 4 = 1 AND status = 'granted') AS valid FROM licenses")
def license_records(t: Tables) -> DataFrame:
    i = "license_id"
    r = F.struct(
        F.concat(F.lit("l"), i).alias("licenseId"), F.when(~nth(i, 4, 2), "c").alias("corpusId"), F.lit("1").alias("corpusVersion"), F.when(nth(i, 4, 1) & (F.col("status") == "unknown"), "revoked").otherwise(F.col("status")).alias("status"),
        F.when(~nth(i, 4, 3), F.array().cast("array<string>")).alias("restrictions"), F.lit(records.SOURCE).alias("source"),
    )
    return t.licenses.select("license_id", records.is_license(r).alias("valid"))


@query("c04_c05_progress_records", "SELECT prompt_id, prompt_id % 5 IN (0, 1) AS snapshot, language = 'fr' AND prompt_id % 5 IN (0, 3) AS source FROM prompts")
def progress_records(t: Tables) -> DataFrame:
    i = "prompt_id"
    some = F.array().cast("array<bigint>")
    snapshot = F.struct(F.col("language").alias("corpusId"), F.lit("2").alias("corpusVersionSeen"), F.when(nth(i, 5, 2), "").otherwise("s").alias("speakerId"), F.when(~nth(i, 5, 3), "fr").alias("language"), some.alias("completedScenarios"), F.when(~nth(i, 5, 4), some).alias("completedPrompts"))
    source = F.struct(F.col("language").alias("corpusId"), F.when(nth(i, 5, 2), "\t").otherwise("s").alias("speakerId"), F.when(~nth(i, 5, 4), "fr").alias("language"), F.when(~nth(i, 5, 1), some).alias("takes"))
    return t.prompts.select("prompt_id", records.is_snapshot(snapshot).alias("snapshot"), records.is_progress_source(source, "fr").alias("source"))


@query(
    "b12_unknown_consent",
    """WITH c AS (SELECT speaker_id, max_by(status, consent_id) AS status, max_by(struct_pack(e := evidence), consent_id).e AS evidence, max(consent_id) AS consent_id FROM consents WHERE speaker_id % 2 = 0 GROUP BY speaker_id)
    SELECT session_id, take_ord, coalesce(CAST(consent_id AS VARCHAR), 'consent.unknown.' || t.speaker_id) AS consent_id, coalesce(status, 'unknown') AS consent_status, evidence FROM takes t LEFT JOIN c ON t.speaker_id = c.speaker_id""",
)
def unknown_consent(t: Tables) -> DataFrame:
    return records.with_consent(t.takes.select("session_id", "take_ord", "speaker_id"), t.consents.where("speaker_id % 2 = 0")).drop("speaker_id")


@query(
    "b13_unknown_license",
    "SELECT prompt_id, coalesce(CAST(license_id AS VARCHAR), 'license.unknown.' || scenario_id || '.' || p.language) AS license_id, coalesce(status, 'unknown') AS license_status FROM prompts p LEFT JOIN (SELECT *, CASE WHEN license_id % 2 = 0 THEN 'fr' ELSE 'en' END AS language FROM licenses WHERE license_id < 2) l ON p.language = l.language AND scenario_id = (SELECT min(source) FROM documents)",
)
def unknown_license(t: Tables) -> DataFrame:
    first = F.broadcast(t.documents.agg(F.min("source").alias("corpus_id")))  # one row
    licenses = t.licenses.where("license_id < 2").crossJoin(first).select("corpus_id", F.when(nth("license_id", 2, 0), "fr").otherwise("en").alias("corpus_version"), "license_id", "status")
    x = records.with_license(t.prompts.select("prompt_id", F.col("scenario_id").alias("corpus_id"), F.col("language").alias("corpus_version")), licenses)
    return x.select("prompt_id", "license_id", "license_status")


@query("q89_recording_entries", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'mapping' WHEN 2 THEN 'name' WHEN 3 THEN 'mapping' WHEN 4 THEN 'record' END AS error FROM documents")
def recording_entries(t: Tables) -> DataFrame:
    """Whole entries, and with another path, an unsafe name, a fraction of a byte, or no JSON at all."""
    sha = F.sha2("text", 256)
    e = F.struct(F.concat(F.when(nth("doc_id", 5, 2), "../").otherwise(""), F.lit("take-"), "doc_id", F.lit(".wav")).alias("fileName"), F.concat(F.lit("audio/"), F.when(nth("doc_id", 5, 1), "x").otherwise(""), sha, F.lit(".wav")).alias("path"), F.when(nth("doc_id", 5, 3), 10.5).otherwise(44.0).alias("byteLength"), sha.alias("sha256"))
    json = F.when(nth("doc_id", 5, 4), "{").otherwise(F.to_json(e))
    x = t.documents.select("doc_id", records.recording_entry(json).alias("r"))
    return x.select("doc_id", "r.error")


@query("o08_normal_scope", "SELECT event_id, CASE WHEN event_id % 6 = 1 THEN 'ids' WHEN event_id % 6 IN (2, 3) THEN 'selection' WHEN event_id % 6 = 4 THEN 'locale' END AS error, CASE WHEN event_id % 6 = 2 THEN '' WHEN event_type = 'view' THEN 'view' ELSE event_type || ',view' END AS speakers FROM events")
def normal_scope(t: Tables) -> DataFrame:
    i, one = "event_id", texts("x")
    s = F.struct(
        F.when(~nth(i, 6, 1), "d").otherwise(" ").alias("datasetId"), F.lit("p").alias("projectId"), F.when(~nth(i, 6, 2), F.array("event_type", F.lit("view"), "event_type")).otherwise(F.array().cast("array<string>")).alias("speakerIds"), one.alias("languages"), one.alias("corpusRefs"),
        F.when(~nth(i, 6, 3), one).alias("sessionIds"), one.alias("takeStatuses"), F.when(nth(i, 6, 4), F.array().cast("array<string>")).otherwise(one).alias("locales"),
    )
    x = t.events.select("event_id", records.scope(s).alias("r"))
    return x.select("event_id", "r.error", F.array_join("r.speakerIds", ",").alias("speakers"))


@query("b18_recognition_observation")
def recognition_observation(t: Tables) -> DataFrame:
    return records.recognition_observation(live.hypotheses(recognized(t)))


@query(
    "b18_final_transcripts",
    "SELECT take_ord, string_agg(text, ' ' ORDER BY session_id) FILTER (WHERE session_id % 3 = 0) AS transcript, " + js("avg(words / 100.0) FILTER (WHERE session_id % 2 = 0 OR session_id % 3 = 0)", 3) + " AS confidence FROM (SELECT * FROM takes WHERE text <> '' AND text = trim(text)) GROUP BY take_ord",
)
def final_transcripts(t: Tables) -> DataFrame:
    """Takes of one number as a session's hypotheses: every third session is a first alternative, every second or third is final."""
    i = F.col("session_id")
    x = t.takes.where("text <> '' and text = trim(text)").select("take_ord", i.alias("result"), F.when(i % 3 == 0, 0).otherwise(1).alias("alternative"), "text", (F.col("words") / 100.0).alias("confidence"), ((i % 2 == 0) | (i % 3 == 0)).alias("final"))
    return records.recognition_observation(x, "take_ord")


@query("q96_free_transcript", r"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unavailable' WHEN NOT regexp_matches(text, '[\p{L}\p{N}]') THEN 'no-final-words' WHEN doc_id % 4 = 1 THEN 'candidate-sung' ELSE 'detected' END AS status, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’.\-][\p{L}\p{N}]+)*')) AS INTEGER) AS words FROM documents")
def free_transcript(t: Tables) -> DataFrame:
    kind = F.when(nth("doc_id", 4, 1), "sung_candidate").otherwise("spoken")
    x = t.documents.select("doc_id", records.free_transcript(F.col("text"), kind, ~nth("doc_id", 4, 0)).alias("x"))
    return x.select("doc_id", "x.*")


@query("b19_speaker_profiles", "SELECT CAST(workspace AS VARCHAR) AS workspace_id, ord, speaker_id, CASE WHEN trim(name) = '' THEN 'Voix ' || (ord + 1) ELSE trim(name) END AS display_name FROM (SELECT DISTINCT session_id % 20 AS workspace, CAST(speaker_id AS INTEGER) AS ord, 's' || speaker_id AS speaker_id, CASE WHEN speaker_id % 3 = 0 THEN ' ' ELSE ' Name ' || speaker_id END AS name FROM takes WHERE session_id % 20 > 3) UNION ALL SELECT DISTINCT CAST(session_id % 20 AS VARCHAR), o.ord, o.id, o.name FROM takes, (VALUES (0, 'first', 'Voix 1'), (1, 'second', 'Voix 2')) o(ord, id, name) WHERE session_id % 20 <= 3")
def speaker_profiles(t: Tables) -> DataFrame:
    place, speaker = F.col("session_id") % 20, F.col("speaker_id")
    known = lambda x: F.when(place > 3, x)
    rows = t.takes.select(place.cast("string").alias("workspace_id"), known(speaker.cast("int")).alias("ord"), known(F.concat(F.lit("s"), speaker)).alias("speaker_id"), known(F.when(speaker % 3 == 0, " ").otherwise(F.concat(F.lit(" Name "), speaker))).alias("name")).distinct()
    initial = t.spark.createDataFrame([(0, "first", "Primary Voice"), (1, "second", "Secondary Voice")], "ord int, speaker_id string, name string")
    return records.speakers(rows, initial)


@query("d05_package_lookups", "WITH r AS (SELECT user_id, event_type, event_id, value FROM events), f AS (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM r GROUP BY user_id) SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM r JOIN f USING (user_id, event_type) GROUP BY user_id, event_type")
def package_lookups(t: Tables) -> DataFrame:
    return records.lookup(t.events.select("user_id", "event_type", "event_id", "value"), "user_id", "event_type", "event_id")


@query("q90_stored_recordings", "SELECT 'f' || doc_id AS file_name, CASE WHEN doc_id % 2 = 0 THEN 'a' || source WHEN doc_id % 3 = 0 THEN 'b' || lang END AS content, CASE WHEN doc_id % 2 = 0 THEN 'first' WHEN doc_id % 3 = 0 THEN 'second' END AS store FROM documents")
def stored_recordings(t: Tables) -> DataFrame:
    x = t.documents.select(F.concat(F.lit("f"), "doc_id").alias("file_name"), "doc_id", F.concat(F.lit("a"), "source").alias("a"), F.concat(F.lit("b"), "lang").alias("b"))
    return records.stored(x.select("file_name"), x.where("doc_id % 2 = 0").select("file_name", F.col("a").alias("content")), x.where("doc_id % 3 = 0").select("file_name", F.col("b").alias("content")))


@query("q82_q91_tracked_files", "SELECT path, byte_size, sha256 FROM files")
def tracked_files(t: Tables) -> DataFrame:
    return records.tracked(t.files.select("path", F.col("text").alias("content")))


@query("q83_package_readme", "SELECT source, '# ' || source || chr(10) || chr(10) || '- prompts: ' || count(*) || chr(10) || '- languages: ' || count(DISTINCT lang) AS readme FROM documents GROUP BY source")
def package_readme(t: Tables) -> DataFrame:
    x = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("l"))
    return x.select("source", records.readme(F.col("source"), {"prompts": F.col("n"), "languages": F.col("l")}).alias("readme"))


@query(
    "b14_manifest_rows",
    r"""WITH w AS (SELECT session_id, take_ord, string_agg(p, ',' ORDER BY p) AS inventory FROM (SELECT DISTINCT session_id, take_ord, unnest(string_split(regexp_replace(lower(strip_accents(text)), '[^aeiou]', '', 'g'), '')) AS p FROM takes) WHERE p <> '' GROUP BY ALL)
    SELECT session_id * 1000 + take_ord AS take_id, t.prompt_id, CASE rating WHEN 'keeper' THEN 'training_candidate' WHEN 'maybe' THEN 'needs_review' WHEN 'reject' THEN 'rejected' ELSE 'captured' END AS status, CASE WHEN take_ord % 2 = 0 THEN sha256(text) END AS sha256, CASE WHEN take_ord % 2 = 0 THEN words END AS byte_size, coalesce(inventory, '') AS inventory
    FROM takes t LEFT JOIN w USING (session_id, take_ord)""",
)
def manifest_rows(t: Tables) -> DataFrame:
    take = (F.col("session_id") * 1000 + F.col("take_ord")).alias("take_id")
    rows = t.takes.select(take, "prompt_id", "rating", F.when(nth("take_ord", 2, 0), F.sha2("text", 256)).alias("sha256"), F.col("words").alias("byte_size"))
    words = t.takes.select(take, F.filter(F.split(F.regexp_replace(X.fold("text"), "[^aeiou]", ""), ""), lambda p: p != "").alias("phonemes"))
    x = records.manifest_rows(rows, words)
    return x.withColumn("inventory", F.array_join("inventory", ","))


@query("q11_q14_workspaces", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'w' || doc_id ELSE 'workspace' END AS workspace_id, CAST(CASE doc_id % 4 WHEN 3 THEN 10 WHEN 2 THEN 60 WHEN 1 THEN 1 ELSE least(60, greatest(1, doc_id % 90)) END AS BIGINT) AS minutes, CAST(CASE WHEN doc_id % 4 = 3 THEN 15 ELSE least(45, greatest(5, doc_id % 70)) END AS BIGINT) AS distance_cm, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS consents FROM documents")
def normal_workspaces(t: Tables) -> DataFrame:
    """Whole workspaces, and without an id or with numbers out of range, and what is no record at all."""
    i = F.col("doc_id")
    minutes = F.when(i % 4 == 1, -5.0).when(i % 4 == 2, 1e6).otherwise((i % 90).cast("double"))
    right = lambda s, v: F.struct(F.lit(s).alias("speakerId"), F.lit(v).alias("status"), F.lit("e").alias("evidence"))
    w = F.struct(
        F.when(i % 4 == 0, F.concat(F.lit("w"), i)).otherwise(" ").alias("id"), F.lit(2.0).alias("version"), F.struct(minutes.alias("minutes"), (i % 70).cast("double").alias("distanceCm")).alias("settings"),
        F.when(i % 4 == 0, F.array(right("s", "granted"), right(" ", "granted"), right("s", "perhaps"))).alias("consents"),
    )
    x = workspaces.normalize(t.documents.select("doc_id", F.when(i % 4 == 3, "[1]").otherwise(F.to_json(w)).alias("json")))
    return x.select("doc_id", "workspace_id", "minutes", "distance_cm", F.size("consents").alias("consents"))


@query("a15_workspace_backup", "SELECT 'w' || doc_id AS workspace_id, 'workspace-backup' AS format, doc_id AS minutes FROM documents")
def workspace_backup(t: Tables) -> DataFrame:
    x = workspaces.backup(t.documents.select(F.concat(F.lit("w"), "doc_id").alias("workspace_id"), "doc_id", "source"))
    return x.select("workspace_id", F.get_json_object("json", "$.format").alias("format"), F.get_json_object("json", "$.workspace.doc_id").cast("long").alias("minutes"))


@query("a12_a13_a18_q85_archives", "SELECT source, 'text/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def archives_round_trip(t: Tables) -> DataFrame:
    """An archive for each source and hundred of documents, made and read again."""
    files = t.documents.select(F.concat_ws(":", "source", F.floor(F.col("doc_id") / 100)).alias("part"), F.concat(F.lit("text/"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    x = archives.unzip(archives.zip_groups(files, "part"))
    return x.select(F.substring_index("part", ":", 1).alias("source"), "path", F.sha2("content", 256).alias("sha256"))


@query("a07_a08_a30_insert_only", "SELECT doc_id, source FROM documents WHERE doc_id >= 0")
def insert_only(t: Tables) -> DataFrame:
    return archives.insert_only(t.documents.where("doc_id < 0").select("doc_id"), t.documents.where("doc_id >= 0").select("doc_id", "source"), "doc_id")


@query("a05_a09_media_identity", "SELECT path, byte_size AS byte_length, sha256, true AS safe FROM (SELECT 'takes/' || doc_id || '.wav' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size, sha256(text) AS sha256 FROM documents)")
def media_identity(t: Tables) -> DataFrame:
    x = archives.media_identity(t.documents.select(F.concat(F.lit("takes/"), "doc_id", F.lit(".wav")).alias("path"), F.encode("text", "utf-8").alias("content")))
    return x.withColumn("byte_length", F.col("byte_length").cast("long"))


@query("f06_speaker_labels", r"SELECT session_id, take_ord, role AS label FROM takes")
def speaker_labels(t: Tables) -> DataFrame:
    """Every take's text with its role before it as a label."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", r"\s+", " "))
    label = F.regexp_extract(line, r"^([^:]{1,32}):\s", 1)
    return t.takes.select("session_id", "take_ord", F.lower(label).alias("label"))


@query("f16_checksum_errors", "SELECT path, CASE WHEN path LIKE '%7.json' THEN 'malformed' END AS error FROM files")
def checksum_errors(t: Tables) -> DataFrame:
    """Checksum lines, every tenth with one space instead of two."""
    lines = package.checksum_lines(t.files)
    column = lines.columns[-1]
    bad = lines.withColumn(column, F.when(F.col(column).rlike("7[.]json$"), F.regexp_replace(column, "  ", " ")).otherwise(F.col(column)))
    x = package.parse_checksums(bad)
    path = F.when(F.col("path") == "", F.regexp_extract("error", r"(text/\S+)", 1)).otherwise(F.col("path"))
    return x.select(path.alias("path"), F.when(F.col("error").isNotNull(), "malformed").alias("error"))


@query("q01_prompt_segments")
def prompt_segments(t: Tables) -> DataFrame:
    found = corpus.segments(t.documents.select("doc_id", "text", F.lit("script.txt").alias("source_name")), "doc_id")
    return found.select("doc_id", "text")


@query("q37_q40_averages", "SELECT event_type, CAST(coalesce(avg(value) FILTER (WHERE value > 1e9), 0) AS DOUBLE) AS none, count(*) AS n FROM events GROUP BY event_type")
def averages(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(N.average_or_zero(F.when(F.col("value") > 1e9, F.col("value"))).alias("none"), F.count("*").alias("n"))


@query("q41_q42_medians", "SELECT event_type, median(CAST(floor(value) AS BIGINT)) AS middle FROM events GROUP BY event_type")
def medians(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.median(F.floor("value")).alias("middle"))


@query("q70_q81_identifiers", "SELECT count(*) AS n, true AS formed, count(*) AS different FROM documents")
def identifiers(t: Tables) -> DataFrame:
    x = t.documents.select(F.concat(F.lit("take."), F.uuid()).alias("id"))
    return x.agg(F.count("*").alias("n"), F.bool_and(F.col("id").rlike("^take[.][0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("formed"), F.countDistinct("id").alias("different"))


@query("q84_read_json", "SELECT doc_id, doc_id % 3 = 1 AS missing, doc_id % 3 = 2 AS broken, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM documents")
def read_json(t: Tables) -> DataFrame:
    body = F.when(nth("doc_id", 3, 0), F.to_json(F.struct("source"))).when(nth("doc_id", 3, 2), '{"source": ')
    x = t.documents.select("doc_id", body.alias("body")).withColumn("x", F.from_json("body", "source string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return x.select("doc_id", F.col("body").isNull().alias("missing"), F.col("x._corrupt").isNotNull().alias("broken"), "x.source")


@query("q54_m24_profile_of_capability", f"SELECT doc_id, CASE WHEN len({TOKENS}) * 1000 > 600000 OR doc_id % 3 = 0 THEN 'compatible' ELSE 'enhanced' END AS profile FROM documents")
def profile_of_capability(t: Tables) -> DataFrame:
    from ..operators.analysis import processing_profile

    return t.documents.select("doc_id", processing_profile(X.count_words("text") * 1000, F.col("doc_id") % 3 != 0).alias("profile"))


@query("q16_arrays_or_empty", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM documents")
def arrays_or_empty(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(workspaces.array_or_empty(F.when(nth("doc_id", 2, 0), F.array("source")), "array<string>")).alias("n"))


@query("q80_path_tokens")
def path_tokens(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.stable_token("url").alias("token"), L.trimmed(F.col("url")).alias("url"))


# ---- whole packages and payloads


@query(
    "a25_o02_package_archives",
    """SELECT 'text/' || doc_id || '.txt' AS path, CASE doc_id % 10 WHEN 1 THEN 'missing file' WHEN 2 THEN 'unmanifested file' WHEN 3 THEN 'size differs' WHEN 4 THEN 'sha256 differs' END AS error FROM documents WHERE doc_id % 10 BETWEEN 1 AND 4
    UNION ALL SELECT 'manifest.json', 'required file missing'""",
)
def package_archives(t: Tables) -> DataFrame:
    """Archives of each source's documents, read again and held against a manifest: of each ten files one is not there, one not manifested, one longer and one other than manifested.

    The other one has the manifested size and another digest, which every text can have, an empty one too."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("text/"), i, F.lit(".txt")).alias("path")
    content = F.when(i % 10 == 3, F.concat(text, F.lit("+"))).otherwise(text)
    files = t.documents.where("doc_id % 10 <> 1").select(F.concat_ws(":", "source", F.floor(i / 100)).alias("part"), path, F.encode(content, "utf-8").alias("content"))
    held = archives.unzip(archives.zip_groups(files, "part"))
    listed = t.documents.where("doc_id % 10 <> 2")
    same = records.tracked(listed.where("doc_id % 10 <> 4").select(path, text.alias("content")))
    other = records.tracked(listed.where("doc_id % 10 = 4").select(path, text.alias("content"))).withColumn("sha256", F.sha2("sha256", 256))
    return package.validate(same.unionByName(other), records.tracked(held.select("path", "content")), ["manifest.json"])


def aligned_twice(t: Tables) -> DataFrame:
    """Every medium's words as an alignment, and but for each fifth medium as a second one, 40 ms later, surer or less sure."""
    part = F.col("media_id")

    def alignment(later: int, confidence: Column) -> Column:
        words = F.transform("x", lambda w: F.struct(w["word"].alias("word"), (w["start_ms"] + later).cast("double").alias("startMs"), (w["end_ms"] + later).cast("double").alias("endMs"), F.lit(0.9).alias("confidence")))
        sound = F.expr("array(named_struct('phoneme', 'a', 'startMs', 0D, 'endMs', 10D, 'confidence', 0.5D, 'wordIndex', 0D))")
        return F.struct((F.col("last") + 100.0).alias("durationMs"), F.lit("tool").alias("aligner"), F.lit("fr").alias("language"), confidence.alias("confidence"), words.alias("words"), sound.alias("phonemes"))

    x = t.word_timings.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "start_ms", "end_ms"))).alias("x"), F.max("end_ms").alias("last"))
    first, second = alignment(0, F.lit(0.8)), alignment(40, F.when(part % 2 == 0, 0.6).otherwise(0.9))
    return x.select("media_id", F.when(part % 5 == 0, F.to_json(first)).otherwise(F.to_json(F.struct(F.array(first, second).alias("alignments")))).alias("payload"))


@query("f13_imported_consensus", "SELECT media_id AS take_id, idx, start_ms + CASE WHEN media_id % 5 <> 0 AND media_id % 2 = 1 THEN 40 ELSE 0 END AS start_ms, end_ms + CASE WHEN media_id % 5 <> 0 AND media_id % 2 = 1 THEN 40 ELSE 0 END AS end_ms FROM word_timings")
def imported_consensus(t: Tables) -> DataFrame:
    return imports.import_alignments(aligned_twice(t), "media_id")[0].select("take_id", "idx", "start_ms", "end_ms")


@query("l13_int24_samples", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x < 0 THEN floor(CAST(greatest(x, -1) AS DOUBLE) * 8388608 + 0.5) ELSE floor(CAST(least(x, 1) AS DOUBLE) * 8388607 + 0.5) END)) AS sum FROM embeddings")
def int24_samples(t: Tables) -> DataFrame:
    whole = F.transform("embedding", lambda x: N.int24(x.cast("double")).cast("double"))
    return t.embeddings.select("vec_id", F.aggregate(whole, F.lit(0.0), lambda a, x: a + x).alias("sum"))
