"""Queries of filters, lookups, aggregates, sets, intervals and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import intervals as I
from ..operators import rules as R
from ..operators import statistics as S
from .base import Tables, query

W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def b(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# ---- the flagship: exact and normalised duplicates by language, and whether they block a dataset


@query(
    "m11_duplicate_readiness",
    r"""SELECT lang, CAST(sum(exact) AS BIGINT) AS exact_groups, CAST(sum(normalised) AS BIGINT) AS normalised_groups, CASE WHEN sum(exact) > 0 THEN 'blocked' WHEN sum(normalised) > 0 THEN 'review' ELSE 'ready' END AS readiness FROM (
      SELECT lang, 1 AS exact, 0 AS normalised FROM documents GROUP BY lang, sha256(text) HAVING count(*) > 1
      UNION ALL SELECT lang, 0, 1 FROM documents GROUP BY lang, sha256(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) HAVING count(*) > 1) GROUP BY lang""",
)
def duplicate_readiness(t: Tables) -> DataFrame:
    docs = t.documents.select("lang", F.sha2("text", 256).alias("exact"), F.sha2(X.normalize_text("text"), 256).alias("normalised"))
    kinds = docs.select("lang", F.explode(F.array(F.struct(F.lit("exact").alias("kind"), F.col("exact").alias("hash")), F.struct(F.lit("normalised").alias("kind"), F.col("normalised").alias("hash")))).alias("x"))
    groups = kinds.groupBy("lang", "x.kind", "x.hash").agg(F.count("*").alias("n")).where("n > 1")
    x = groups.groupBy("lang").agg(F.count_if(F.col("kind") == "exact").alias("exact_groups"), F.count_if(F.col("kind") == "normalised").alias("normalised_groups"))
    return x.withColumn("readiness", F.when(F.col("exact_groups") > 0, "blocked").when(F.col("normalised_groups") > 0, "review").otherwise("ready"))


@query("g17_duplicate_groups", "SELECT sha256(text) AS key, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return S.duplicate_groups(t.documents, F.sha2("text", 256), "doc_id").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("g16_duplication_audit", "SELECT 'audio' AS audit, sha256 AS key, count(*) AS n FROM files GROUP BY sha256 HAVING count(*) > 1 UNION ALL SELECT 'text', sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))), count(*) FROM files GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'provenance', owner, count(*) FROM files GROUP BY owner HAVING count(*) > 1".replace("\\\\", "\\"))
def duplication_audit(t: Tables) -> DataFrame:
    parts = [("audio", F.col("sha256")), ("text", F.sha2(X.normalize_text("text"), 256)), ("provenance", F.col("owner"))]
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("audit"), k.alias("key")) for a, k in parts)))
    return t.files.select(pairs.alias("x")).groupBy("x.audit", "x.key").agg(F.count("*").alias("n")).where("n > 1")


# ---- grouped counts and reports


@query("g08_count_by_language", "SELECT language, count(*) AS n FROM prompts GROUP BY language")
def count_by(t: Tables) -> DataFrame:
    return t.prompts.groupBy("language").count().withColumnRenamed("count", "n")


@query("g09_count_by_rating", "SELECT rating, count(*) AS n FROM takes GROUP BY rating")
def count_by_rating(t: Tables) -> DataFrame:
    return t.takes.groupBy("rating").agg(F.count("*").alias("n"))


@query("g12_failed_gates", "SELECT take_id, ord, gate_id FROM gates WHERE status = 'fail'")
def failed_gates(t: Tables) -> DataFrame:
    return t.gates.where("status = 'fail'").select("take_id", "ord", "gate_id")


@query("g13_underrepresented", "SELECT language, intent, count(*) AS n FROM prompts GROUP BY language, intent HAVING count(*) < 40")
def underrepresented(t: Tables) -> DataFrame:
    return t.prompts.groupBy("language", "intent").agg(F.count("*").alias("n")).where("n < 40")


@query("g14_quality_summary", "SELECT rating, role, count(*) AS n FROM takes GROUP BY GROUPING SETS ((rating), (role))")
def quality_summary(t: Tables) -> DataFrame:
    return t.takes.groupingSets([[F.col("rating")], [F.col("role")]], "rating", "role").agg(F.count("*").alias("n"))


@query("g15_coverage_by", "SELECT language, scenario_id, pace, count(*) AS n FROM prompts GROUP BY GROUPING SETS ((language), (scenario_id), (pace), ())")
def coverage_by(t: Tables) -> DataFrame:
    c = F.col
    return t.prompts.groupingSets([[c("language")], [c("scenario_id")], [c("pace")], []], "language", "scenario_id", "pace").agg(F.count("*").alias("n"))


@query("g18_manifest_counts", f"SELECT {b('count(distinct session_id)')} AS sessions, {b('count(distinct speaker_id)')} AS speakers, {b('count(distinct prompt_id)')} AS prompts, {b('count(*)')} AS takes, {b('sum(duration_ms)')} AS duration_ms FROM takes")
def manifest_counts(t: Tables) -> DataFrame:
    return t.takes.agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("speaker_id").alias("speakers"), F.countDistinct("prompt_id").alias("prompts"), F.count("*").alias("takes"), F.sum("duration_ms").alias("duration_ms"))


@query("g21_session_rollup", "SELECT session_id, count(*) AS takes, count(*) FILTER (rating = 'keeper') AS keepers FROM takes GROUP BY session_id")
def session_rollup(t: Tables) -> DataFrame:
    return t.takes.groupBy("session_id").agg(F.count("*").alias("takes"), F.count_if(F.col("rating") == "keeper").alias("keepers"))


@query("g02_gate_score", "SELECT CAST(floor(avg(score) * 100 * 100 + 0.5) / 100 AS DOUBLE) AS score, count(*) AS takes FROM (SELECT take_id, avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'review' THEN 0.5 ELSE 0.0 END) AS score FROM gates WHERE gate_id IN ('clipping', 'snr', 'headroom', 'reverb', 'duration') GROUP BY take_id)")
def gate_score(t: Tables) -> DataFrame:
    return R.audio_score(t.gates)


@query(
    "g01_coverage_summary",
    """WITH keepers AS (SELECT DISTINCT prompt_id FROM takes WHERE rating = 'keeper'),
    marked AS (SELECT p.*, k.prompt_id IS NOT NULL AS done FROM prompts p LEFT JOIN keepers k ON p.prompt_id = k.prompt_id)
    SELECT language, count(*) AS total, count(*) FILTER (done) AS completed,
      CAST(floor(count(*) FILTER (done) / CAST(count(*) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percent,
      CAST(floor(count(DISTINCT CASE WHEN done THEN intent END) / CAST(count(DISTINCT intent) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS intent_coverage,
      array_to_string(list_sort(list_filter(list_distinct(list(intent)), lambda i: NOT list_contains(list_distinct(list(CASE WHEN done THEN intent ELSE '' END)), i))), ',') AS missing_intents,
      array_to_string(list_sort(list_filter(list_distinct(list(pace)), lambda i: NOT list_contains(list_distinct(list(CASE WHEN done THEN pace ELSE '' END)), i))), ',') AS missing_paces
    FROM marked GROUP BY language""",
)
def coverage_summary(t: Tables) -> DataFrame:
    keepers = t.takes.where("rating = 'keeper'").select("prompt_id", F.lit(True).alias("done")).distinct()
    x = t.prompts.join(keepers, "prompt_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    seen = lambda c: F.collect_set(F.when(F.col("done"), F.col(c)))
    missing = lambda c: F.array_join(F.array_sort(F.array_except(F.collect_set(c), seen(c))), ",")
    total, done = F.count("*"), F.count_if("done")
    return x.groupBy("language").agg(total.alias("total"), done.alias("completed"), N.percentage(done, total).alias("percent"), N.percentage(F.size(seen("intent")), F.size(F.collect_set("intent"))).alias("intent_coverage"), missing("intent").alias("missing_intents"), missing("pace").alias("missing_paces"))


@query("m12_readiness_tier", "SELECT session_id, CASE WHEN n >= 5 AND q >= 90 THEN 'Premium Candidate' WHEN n >= 4 AND q >= 70 THEN 'Production Candidate' WHEN n >= 2 AND q >= 50 THEN 'MVP Candidate' ELSE 'Needs Calibration' END AS tier FROM (SELECT take_id AS session_id, count(*) AS n, avg(CASE status WHEN 'pass' THEN 100.0 WHEN 'review' THEN 50.0 ELSE 0.0 END) AS q FROM gates GROUP BY take_id)")
def readiness_tier(t: Tables) -> DataFrame:
    x = t.gates.groupBy(F.col("take_id").alias("session_id")).agg(F.count("*").alias("n"), F.avg(R.gate_points() * 100).alias("q"))
    steps = [("Premium Candidate", 5, 90), ("Production Candidate", 4, 70), ("MVP Candidate", 2, 50)]
    return x.select("session_id", R.tier([(name, (F.col("n") >= n) & (F.col("q") >= q)) for name, n, q in steps], "Needs Calibration").alias("tier"))


@query("g26_deviation", "SELECT user_id AS media_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE floor(stddev_pop(value) * 1e6 + 0.5) / 1e6 END AS value FROM events GROUP BY user_id")
def deviation(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("media_id")).agg(N.js_round(S.deviation(F.col("value")), 6).alias("value"))


@query("g25_percentile_floor", "SELECT media_id, floor(level * 10.0 + 0.5) / 10.0 AS value FROM (SELECT media_id, level, row_number() OVER (PARTITION BY media_id ORDER BY level) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM frames) WHERE r = least(n - 1, CAST(floor(n * 0.2) AS BIGINT)) + 1")
def percentile_floor(t: Tables) -> DataFrame:
    return S.percentile(t.frames, "media_id", "level", 0.2)


@query("g27_median", "SELECT media_id, floor(median(level) * 1e6 + 0.5) / 1e6 AS value FROM frames GROUP BY media_id")
def median(t: Tables) -> DataFrame:
    return t.frames.groupBy("media_id").agg(N.js_round(F.median("level"), 6).alias("value"))


@query("g28_weighted_median", "SELECT l_orderkey AS take_id, min(l_quantity) AS value FROM (SELECT l_orderkey, l_quantity, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) AS run, sum(l_linenumber) OVER (PARTITION BY l_orderkey) AS whole FROM lineitem) WHERE run >= whole / 2.0 GROUP BY l_orderkey")
def weighted_median(t: Tables) -> DataFrame:
    x = t.lineitem.select(F.col("l_orderkey").alias("take_id"), "l_quantity", "l_linenumber")
    return S.weighted_median(x, ["take_id"], "l_quantity", "l_linenumber")


@query("g29_mode", "SELECT user_id AS media_id, arg_max(event_type, (n, -first)) AS mode FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def mode(t: Tables) -> DataFrame:
    return S.first_mode(t.events.withColumnRenamed("user_id", "media_id"), "media_id", "event_type", "event_id")


RUNS = "SELECT media_id, CAST(max(n) AS BIGINT) AS longest FROM (SELECT media_id, w, g, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) - row_number() OVER (PARTITION BY media_id, w ORDER BY idx) AS g FROM (SELECT media_id, idx, {w} AS w FROM {t})) WHERE w <> '' GROUP BY ALL) GROUP BY media_id"


@query("g30_longest_run", RUNS.format(w="lower(word)", t="word_timings"))
def longest_run(t: Tables) -> DataFrame:
    return S.longest_run(t.word_timings.select("media_id", "idx", F.lower("word").alias("w")), "media_id", "idx", "w")


@query("g31_repeated_tokens", RUNS.format(w="event_type", t="(SELECT user_id AS media_id, event_id AS idx, event_type FROM events)"))
def repeated_tokens(t: Tables) -> DataFrame:
    return S.longest_run(t.events.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("w")), "media_id", "idx", "w")


@query("g32_count_tokens", "SELECT media_id, word, count(*) AS n FROM word_timings GROUP BY media_id, word")
def count_tokens(t: Tables) -> DataFrame:
    return t.word_timings.groupBy("media_id", "word").agg(F.count("*").alias("n"))


@query("g24_ambient_profile", "SELECT media_id, floor(20 * log10(greatest(abs(sqrt(avg(p * p))), 1.5849e-5)) * 10 + 0.5) / 10 AS rms_dbfs, floor(20 * log10(greatest(abs(max(p)), 1.5849e-5)) * 10 + 0.5) / 10 AS peak_dbfs FROM frames GROUP BY media_id")
def ambient_profile(t: Tables) -> DataFrame:
    return t.frames.groupBy("media_id").agg(*S.ambient_profile(F.col("p")))


@query("g10_g11_finite", "SELECT media_id, floor(avg(level) * 1e6 + 0.5) / 1e6 AS mean, max(level) AS most FROM frames GROUP BY media_id")
def finite_stats(t: Tables) -> DataFrame:
    return t.frames.groupBy("media_id").agg(N.js_round(S.average_finite(F.col("level")), 6).alias("mean"), S.maximum_finite(F.col("level")).alias("most"))


@query("g03_average", "SELECT rating, floor(coalesce(avg(words), 0) * 100 + 0.5) / 100 AS mean FROM takes GROUP BY rating")
def average(t: Tables) -> DataFrame:
    return t.takes.groupBy("rating").agg(N.average_or_zero(F.col("words")).alias("mean"))


@query("g04_percentage", "SELECT session_id, CAST(floor(count(*) FILTER (rating = 'keeper') / CAST(count(*) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percent FROM takes GROUP BY session_id")
def percentage(t: Tables) -> DataFrame:
    return t.takes.groupBy("session_id").agg(N.percentage(F.count_if(F.col("rating") == "keeper"), F.count("*")).alias("percent"))


# ---- filters, lookups, semi and anti joins, division


@query("c02_keeper_takes", "SELECT t.session_id, t.take_ord, t.prompt_id FROM takes t JOIN prompts p ON t.prompt_id = p.prompt_id WHERE t.rating = 'keeper' AND p.language = 'fr' AND t.speaker_id = 3")
def keeper_takes(t: Tables) -> DataFrame:
    french = t.prompts.where("language = 'fr'").select("prompt_id")
    return t.takes.where("rating = 'keeper' and speaker_id = 3").join(french, "prompt_id").select("session_id", "take_ord", "prompt_id")


@query("c01_included_takes", "SELECT session_id, take_ord FROM takes WHERE rating IN ('keeper', 'maybe') OR CASE rating WHEN 'keeper' THEN 'training_candidate' WHEN 'maybe' THEN 'needs_review' WHEN 'reject' THEN 'rejected' ELSE 'captured' END IN ('captured')")
def included_takes(t: Tables) -> DataFrame:
    return t.takes.where(R.included(F.col("rating"), ["keeper", "maybe", "captured"])).select("session_id", "take_ord")


@query("c08_valid_consents", "SELECT consent_id, status = 'granted' AND evidence IS NOT NULL AS valid FROM consents")
def valid_consents(t: Tables) -> DataFrame:
    return t.consents.select("consent_id", R.valid_right(F.col("status"), F.col("evidence")).alias("valid"))


@query("c14_plausible_words", r"SELECT media_id, idx FROM word_timings WHERE end_ms - start_ms BETWEEN 60 AND 4000 AND regexp_matches(word, '[\p{L}\p{N}]')")
def plausible_words(t: Tables) -> DataFrame:
    return t.word_timings.where((F.col("end_ms") - F.col("start_ms")).between(60, 4000) & X.has_letters("word")).select("media_id", "idx")


@query("c26_scope_filter", "SELECT session_id, take_ord FROM takes WHERE speaker_id = 4 AND role = 'user'")
def scope_filter(t: Tables) -> DataFrame:
    return t.takes.where("speaker_id = 4 and role = 'user'").select("session_id", "take_ord")


@query("d01_find_prompt", "SELECT t.session_id, t.take_ord, p.text FROM takes t JOIN prompts p ON t.prompt_id = p.prompt_id")
def find_prompt(t: Tables) -> DataFrame:
    return t.takes.select("session_id", "take_ord", "prompt_id").join(t.prompts.select("prompt_id", "text"), "prompt_id").drop("prompt_id")


@query("d02_prompt_text", "SELECT t.session_id, t.take_ord, coalesce(p.text, CAST(t.prompt_id AS VARCHAR)) AS text FROM takes t LEFT JOIN (SELECT * FROM prompts WHERE language = 'en') p ON t.prompt_id = p.prompt_id")
def prompt_text(t: Tables) -> DataFrame:
    p = t.prompts.where("language = 'en'").select("prompt_id", F.col("text").alias("found"))
    return t.takes.join(p, "prompt_id", "left").select("session_id", "take_ord", F.coalesce("found", F.col("prompt_id").cast("string")).alias("text"))


@query("d03_scenario_titles", "SELECT language, string_agg(scenario_id, ', ' ORDER BY scenario_id) AS titles FROM (SELECT DISTINCT language, scenario_id FROM prompts WHERE scenario_id IN ('src1', 'src2', 'src3')) GROUP BY language")
def scenario_titles(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("src1",), ("src2",), ("src3",)], "scenario_id string")
    x = t.prompts.select("language", "scenario_id").distinct().join(wanted, "scenario_id", "left_semi")
    return x.groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("scenario_id")), ", ").alias("titles"))


@query("d06_unknown_sessions", "SELECT session_id FROM (SELECT unnest(range(0, 60)) AS session_id) WHERE session_id NOT IN (SELECT session_id FROM takes)")
def unknown_sessions(t: Tables) -> DataFrame:
    asked = t.spark.range(60).select(F.col("id").alias("session_id"))
    return asked.join(t.takes, "session_id", "left_anti")


@query("d07_rights_default", "SELECT s.speaker_id, coalesce(c.status, 'unknown') AS status FROM (SELECT DISTINCT speaker_id FROM takes) s LEFT JOIN (SELECT speaker_id, arg_min(status, consent_id) AS status FROM consents WHERE evidence IS NOT NULL AND speaker_id < 7 GROUP BY speaker_id) c ON s.speaker_id = c.speaker_id")
def rights_default(t: Tables) -> DataFrame:
    first = t.consents.where("evidence is not null and speaker_id < 7").groupBy("speaker_id").agg(F.min_by("status", "consent_id").alias("status"))
    return t.takes.select("speaker_id").distinct().join(first, "speaker_id", "left").select("speaker_id", F.coalesce("status", F.lit("unknown")).alias("status"))


@query("d09_keeper_instances", "SELECT p.scenario_id, count(*) AS n FROM takes t JOIN prompts p ON t.prompt_id = p.prompt_id WHERE t.rating = 'keeper' GROUP BY p.scenario_id")
def keeper_instances(t: Tables) -> DataFrame:
    return t.takes.where("rating = 'keeper'").join(t.prompts, "prompt_id").groupBy("scenario_id").agg(F.count("*").alias("n"))


@query("d10_last_wins", "SELECT scenario_id, arg_max(prompt_id, prompt_id) AS prompt_id FROM prompts GROUP BY scenario_id")
def last_wins(t: Tables) -> DataFrame:
    return S.last_wins(t.prompts.select("scenario_id", "prompt_id"), "scenario_id", "prompt_id")


@query("d11_completed_prompts", "SELECT prompt_id FROM prompts WHERE prompt_id IN (SELECT prompt_id FROM takes WHERE rating = 'keeper')")
def completed_prompts(t: Tables) -> DataFrame:
    return t.prompts.select("prompt_id").join(t.takes.where("rating = 'keeper'"), "prompt_id", "left_semi")


@query("d12_open_prompts", "SELECT prompt_id, prompt_id IN (SELECT prompt_id FROM takes) AS attempted FROM prompts WHERE prompt_id NOT IN (SELECT prompt_id FROM takes WHERE rating = 'keeper')")
def open_prompts(t: Tables) -> DataFrame:
    open_ = t.prompts.select("prompt_id").join(t.takes.where("rating = 'keeper'"), "prompt_id", "left_anti")
    tried = t.takes.select("prompt_id", F.lit(True).alias("attempted")).distinct()
    return open_.join(tried, "prompt_id", "left").withColumn("attempted", F.coalesce("attempted", F.lit(False)))


@query("d13_attempted_prompts", "SELECT DISTINCT prompt_id FROM takes WHERE speaker_id = 2")
def attempted_prompts(t: Tables) -> DataFrame:
    return t.takes.where("speaker_id = 2").select("prompt_id").distinct()


@query("d14_completed_scenarios", "SELECT scenario_id || ':' || language || ':' || pace AS part FROM prompts p GROUP BY 1 HAVING bool_and(prompt_id IN (SELECT prompt_id FROM takes WHERE rating <> 'reject'))")
def completed_scenarios(t: Tables) -> DataFrame:
    required = t.prompts.select(F.concat_ws(":", "scenario_id", "language", "pace").alias("part"), "prompt_id")
    return S.divide(required, t.takes.where("rating <> 'reject'"), "part", "prompt_id")


# ---- intervals

OVERLAPS = """SELECT w.media_id, w.idx, w.word, w.start_ms, w.end_ms, CAST(sum(CASE WHEN s.media_id IS NULL THEN 0 ELSE least(w.end_ms, s.end_ms) - greatest(w.start_ms, s.start_ms) END) AS BIGINT) AS overlap_ms
  FROM word_timings w LEFT JOIN speech_segments s ON w.media_id = s.media_id AND w.start_ms < s.end_ms AND s.start_ms < w.end_ms GROUP BY ALL"""


@query("d15_speech_overlap", f"SELECT media_id, idx, overlap_ms, CASE WHEN end_ms > start_ms THEN least(1.0, overlap_ms / CAST(end_ms - start_ms AS DOUBLE)) ELSE 0.0 END AS ratio FROM ({OVERLAPS})")
def speech_overlap(t: Tables) -> DataFrame:
    return I.speech_overlap(t.word_timings, t.speech_segments).select("media_id", "idx", "overlap_ms", "ratio")


@query("d16_supported_rate", f"SELECT media_id, floor(count(*) FILTER (overlap_ms > 0) / CAST(count(*) AS DOUBLE) * 1000 + 0.5) / 1000 AS rate FROM ({OVERLAPS}) GROUP BY media_id")
def supported_rate(t: Tables) -> DataFrame:
    x = I.overlap_ms(t.word_timings, t.speech_segments)
    return x.groupBy("media_id").agg(N.js_round(F.count_if(F.col("overlap_ms") > 0) / F.count("*"), 3).alias("rate"))


ASSESSED = f"""WITH o AS (SELECT *, CASE WHEN end_ms > start_ms THEN least(1.0, overlap_ms / CAST(end_ms - start_ms AS DOUBLE)) ELSE 0.0 END AS ratio, end_ms - start_ms BETWEEN 60 AND 4000 AND regexp_matches(word, '[\\p{{L}}\\p{{N}}]') AS ok FROM ({OVERLAPS})),
  m AS (SELECT media_id, count(*) AS words, count(*) FILTER (ok) AS plausible, count(*) FILTER (ok AND ratio >= 0.35) AS supported FROM o GROUP BY media_id)
  SELECT media_id, words, plausible, CASE WHEN supported >= 0.5 * plausible THEN supported ELSE plausible END AS accepted, supported >= 0.5 * plausible AS gated, floor(CASE WHEN supported >= 0.5 * plausible THEN supported ELSE plausible END / CAST(words AS DOUBLE) * 1000 + 0.5) / 1000 AS acceptance FROM m"""


@query("k09_assess_words", ASSESSED)
def assess_words(t: Tables) -> DataFrame:
    return I.assess_words(t.word_timings, t.speech_segments).select("media_id", "words", "plausible", "accepted", "gated", "acceptance")


@query("d17_word_at", "SELECT x.media_id, x.t, coalesce(w.idx, -1) AS idx FROM (SELECT doc_id AS media_id, unnest(range(0, n_chars * 90, 2500)) AS t FROM documents) x ASOF LEFT JOIN word_timings w ON x.media_id = w.media_id AND x.t >= w.start_ms")
def word_at(t: Tables) -> DataFrame:
    times = t.documents.where("n_chars > 0").select(F.col("doc_id").alias("media_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") * 90 - 1, F.lit(2500).cast("long"))).alias("t"))
    return I.word_at(t.word_timings, times)


MERGED = """SELECT media_id, min(s) AS start_ms, max(e) AS end_ms FROM (SELECT *, sum(opens) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 180 THEN 0 ELSE 1 END AS opens FROM (
  SELECT media_id, greatest(0, start_ms - 140) AS s, end_ms + 140 AS e FROM (SELECT media_id, start_ms + idx // 7 * 600 AS start_ms, end_ms + idx // 7 * 600 AS end_ms FROM word_timings)))) GROUP BY media_id, island"""


def parted(t: Tables) -> DataFrame:
    """All words, with a pause after every seventh."""
    later = F.floor(F.col("idx") / 7) * 600
    return t.word_timings.select("media_id", "idx", (F.col("start_ms") + later).alias("start_ms"), (F.col("end_ms") + later).alias("end_ms"))


@query("i07_merge_segments", MERGED)
def merge_segments(t: Tables) -> DataFrame:
    return I.merge_segments(parted(t))


@query("i08_activity_timeline", MERGED.replace("+ 180", "+ 120").replace("start_ms - 140", "start_ms - 0").replace("end_ms + 140", "end_ms + 0"))
def activity_timeline(t: Tables) -> DataFrame:
    return I.merge_segments(parted(t), pad=0, gap=120)


@query("i10_pauses", "SELECT media_id, before AS start_ms, start_ms AS end_ms FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS before FROM speech_segments) WHERE start_ms - before >= 150")
def pauses(t: Tables) -> DataFrame:
    return I.pauses(t.speech_segments)


@query("i02_energy_segments", "SELECT media_id, CAST(floor(min(idx) * (1024 / 48.0) + 0.5) AS BIGINT) AS start_ms, CAST(floor((max(idx) + 1) * (1024 / 48.0) + 0.5) AS BIGINT) AS end_ms FROM (SELECT media_id, idx, idx - row_number() OVER (PARTITION BY media_id ORDER BY idx) AS g FROM frames WHERE level >= -40) GROUP BY media_id, g HAVING floor((max(idx) + 1) * (1024 / 48.0) + 0.5) - floor(min(idx) * (1024 / 48.0) + 0.5) >= 60")
def energy_segments(t: Tables) -> DataFrame:
    return I.energy_segments(t.frames, -40)


@query("i03_threshold", "SELECT session_id, take_ord, floor(least(greatest(floor + 12, -45.0), -24.0) * 10.0 + 0.5) / 10.0 AS threshold FROM metrics")
def threshold(t: Tables) -> DataFrame:
    return t.metrics.select("session_id", "take_ord", I.activity_threshold(F.col("floor")).alias("threshold"))


@query("i04_energy_envelope", "SELECT media_id, idx // 5 AS point, floor(avg(level) * 10.0 + 0.5) / 10.0 AS level FROM frames GROUP BY 1, 2")
def energy_envelope(t: Tables) -> DataFrame:
    return I.energy_envelope(t.frames)


@query("i05_activity_ratio", "SELECT media_id, floor(count(*) FILTER (level >= -40) / CAST(count(*) AS DOUBLE) * 1000 + 0.5) / 1000 AS ratio FROM frames GROUP BY media_id")
def activity_ratio(t: Tables) -> DataFrame:
    return t.frames.groupBy("media_id").agg(N.js_round(F.count_if(F.col("level") >= -40) / F.count("*"), 3).alias("ratio"))


@query("i01_hysteresis")
def hysteresis(t: Tables) -> DataFrame:
    return I.hysteresis(t.frames)


@query("i13_resolve_overlaps")
def resolve_overlaps(t: Tables) -> DataFrame:
    """Words stretched so that neighbours overlap; a fold, so that it is tested on a small table instead of by SQL."""
    return I.resolve_overlaps(t.word_timings.withColumn("end_ms", F.col("end_ms") + 60))


@query("i09_capture_time", "WITH s AS (SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM speech_segments), x AS (SELECT doc_id AS media_id, unnest(range(0, n_chars * 50, 2000)) AS t FROM documents) SELECT x.media_id, x.t, CAST(least(s.end_ms, s.start_ms + x.t - s.before) AS BIGINT) AS capture_ms FROM x ASOF JOIN s ON x.media_id = s.media_id AND x.t >= s.before")
def capture_time(t: Tables) -> DataFrame:
    times = t.documents.where("n_chars > 0").select(F.col("doc_id").alias("media_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") * 50 - 1, F.lit(2000).cast("long"))).alias("t"))
    return I.capture_time(times, t.speech_segments)


@query(
    "i15_warp_time",
    """WITH a AS (SELECT media_id, start_ms AS source_ms, start_ms + idx * 7 AS target_ms FROM word_timings WHERE idx % 10 = 0),
    x AS (SELECT doc_id AS media_id, unnest(range(0, n_chars * 100, 3000)) AS t FROM documents),
    l AS (SELECT x.media_id, x.t, a.source_ms AS s0, a.target_ms AS t0 FROM x ASOF JOIN a ON x.media_id = a.media_id AND x.t >= a.source_ms),
    h AS (SELECT l.*, a.source_ms AS s1, a.target_ms AS t1 FROM l ASOF LEFT JOIN a ON l.media_id = a.media_id AND l.t <= a.source_ms)
    SELECT media_id, t, CAST(floor(t0 + CASE WHEN coalesce(s1, s0) > s0 THEN (t - s0) / CAST(s1 - s0 AS DOUBLE) ELSE 0.0 END * (coalesce(t1, t0) - t0) + 0.5) AS BIGINT) AS warped_ms FROM h""",
)
def warp_time(t: Tables) -> DataFrame:
    anchors = t.word_timings.where("idx % 10 = 0").select("media_id", F.col("start_ms").alias("source_ms"), (F.col("start_ms") + F.col("idx") * 7).alias("target_ms"))
    times = t.documents.where("n_chars > 0").select(F.col("doc_id").alias("media_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") * 100 - 1, F.lit(3000).cast("long"))).alias("t"))
    return I.warp(times.join(t.word_timings.select("media_id").distinct(), "media_id", "left_semi"), anchors)


@query("g22_g23_segment_summary", "WITH s AS (SELECT media_id, min(start_ms) AS s, max(end_ms) AS e, sum(end_ms - start_ms) AS speech FROM speech_segments GROUP BY media_id) SELECT doc_id AS media_id, CAST(coalesce(s, n_chars * 90) AS BIGINT) AS leading_ms, CAST(greatest(0, n_chars * 90 - coalesce(e, 0)) AS BIGINT) AS trailing_ms, CAST(coalesce(speech, 0) AS BIGINT) AS speech_ms, CASE WHEN n_chars > 0 THEN floor(least(1.0, speech / CAST(n_chars * 90 AS DOUBLE)) * 1000 + 0.5) / 1000 ELSE 0.0 END AS coverage FROM documents LEFT JOIN s ON doc_id = media_id")
def segment_summary(t: Tables) -> DataFrame:
    return I.segment_summary(t.speech_segments, t.documents.select(F.col("doc_id").alias("media_id"), (F.col("n_chars") * 90).alias("total_ms")))


@query("b08_word_clips", r"SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, idx) AS sequence, word, greatest(0, start_ms - 60) AS clip_start_ms, end_ms + 60 AS clip_end_ms, 'words/' || lpad(CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, idx) AS VARCHAR), 4, '0') || '-' || coalesce(nullif(substring(regexp_replace(regexp_replace(lower(strip_accents(word)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'word') || '.wav' AS path FROM word_timings")
def word_clips(t: Tables) -> DataFrame:
    return I.word_clips(t.word_timings, F.lit(1 << 40))


@query("e27_running_occurrence", "SELECT media_id, idx, word, row_number() OVER (PARTITION BY media_id, lower(strip_accents(word)) ORDER BY idx) AS occurrence FROM word_timings")
def running_occurrence(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("media_id", X.fold("word")).orderBy("idx"))
    return t.word_timings.select("media_id", "idx", "word", n.alias("occurrence"))


@query("i21_weight_position", "WITH w AS (SELECT media_id, idx, sum(CAST(round(least(greatest(length(word) / 5, 0.72), 2.35) * 100) AS BIGINT)) OVER (PARTITION BY media_id ORDER BY idx) AS run, sum(CAST(round(least(greatest(length(word) / 5, 0.72), 2.35) * 100) AS BIGINT)) OVER (PARTITION BY media_id) AS whole FROM word_timings) SELECT media_id, min(idx) AS idx FROM w WHERE run >= whole * 0.4 GROUP BY media_id")
def weight_position(t: Tables) -> DataFrame:
    weight = F.round(X.word_weight("word") * 100).cast("long")
    w = Window.partitionBy("media_id")
    x = t.word_timings.select("media_id", "idx", F.sum(weight).over(w.orderBy("idx")).alias("run"), F.sum(weight).over(w).alias("whole"))
    return x.where(F.col("run") >= F.col("whole") * 0.4).groupBy("media_id").agg(F.min("idx").alias("idx"))


@query("e30_word_weights", "SELECT media_id, CAST(sum(CAST(round(least(greatest(length(word) / 5, 0.72), 2.35) * 100) AS BIGINT)) AS BIGINT) AS weight FROM word_timings GROUP BY media_id")
def word_weights(t: Tables) -> DataFrame:
    return t.word_timings.groupBy("media_id").agg(F.sum(F.round(X.word_weight("word") * 100).cast("long")).alias("weight"))


# ---- sets, order, pages


@query("h08_page", "SELECT media_id, idx, word FROM word_timings WHERE media_id = 4 ORDER BY idx LIMIT 40 OFFSET 80")
def page(t: Tables) -> DataFrame:
    return t.word_timings.where("media_id = 4").orderBy("idx").offset(80).limit(40).select("media_id", "idx", "word")


@query("h09_checksums", "SELECT path, sha256 || '  ' || path AS line FROM files ORDER BY path")
def checksums(t: Tables) -> DataFrame:
    return t.files.select("path", F.concat("sha256", F.lit("  "), "path").alias("line")).orderBy("path")


@query("h04_best_per_group", "SELECT session_id, arg_max(take_ord, (words, -take_ord)) AS take_ord FROM takes GROUP BY session_id")
def best_per_group(t: Tables) -> DataFrame:
    return t.takes.groupBy("session_id").agg(F.max_by("take_ord", F.struct("words", -F.col("take_ord"))).alias("take_ord"))


@query("h11_union_distinct", "SELECT language AS x FROM prompts UNION SELECT role FROM takes")
def union_distinct(t: Tables) -> DataFrame:
    return t.prompts.select(F.col("language").alias("x")).union(t.takes.select("role")).distinct()


@query("h12_upsert", "SELECT session_id, take_ord, rating FROM takes WHERE session_id NOT IN (SELECT session_id FROM takes WHERE speaker_id = 1) UNION ALL SELECT session_id, take_ord, 'keeper' FROM takes WHERE speaker_id = 1")
def upsert(t: Tables) -> DataFrame:
    rows = t.takes.where("speaker_id = 1").select("session_id", "take_ord", F.lit("keeper").alias("rating"))
    return S.upsert(t.takes.select("session_id", "take_ord", "rating"), rows, "session_id")


@query("h14_except", "SELECT prompt_id FROM prompts EXCEPT SELECT prompt_id FROM takes")
def except_(t: Tables) -> DataFrame:
    return t.prompts.select("prompt_id").subtract(t.takes.select("prompt_id"))


@query("h15_except_all", "SELECT rating FROM takes EXCEPT ALL SELECT rating FROM takes WHERE speaker_id < 5")
def except_all(t: Tables) -> DataFrame:
    return t.takes.select("rating").exceptAll(t.takes.where("speaker_id < 5").select("rating"))


@query("h17_unique_last_value", "SELECT scenario_id, language, max(prompt_id) AS prompt_id, min(prompt_id) AS position FROM prompts GROUP BY scenario_id, language")
def unique_last_value(t: Tables) -> DataFrame:
    return t.prompts.groupBy("scenario_id", "language").agg(F.max_by("prompt_id", "prompt_id").alias("prompt_id"), F.min("prompt_id").alias("position"))


@query("h21_rebuild_progress", "SELECT speaker_id, array_to_string(list_sort(list_distinct(list(prompt_id))), ',') AS prompts FROM takes WHERE rating = 'keeper' GROUP BY speaker_id")
def rebuild_progress(t: Tables) -> DataFrame:
    x = t.takes.where("rating = 'keeper'").groupBy("speaker_id").agg(F.array_sort(F.collect_set("prompt_id")).alias("p"))
    return x.select("speaker_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("prompts"))


# ---- rules and rights


@query("m01_verdict", R.VERDICT_SQL)
def verdict(t: Tables) -> DataFrame:
    return t.metrics.select("session_id", "take_ord", R.verdict("training").alias("verdict"))


@query("l15_gain_plan", R.GAIN_SQL)
def gain_plan(t: Tables) -> DataFrame:
    return t.metrics.select("session_id", "take_ord", *R.auto_gain())


@query("m10_lifecycle", "SELECT session_id, take_ord, CASE rating WHEN 'keeper' THEN 'training_candidate' WHEN 'maybe' THEN 'needs_review' WHEN 'reject' THEN 'rejected' ELSE 'captured' END AS lifecycle FROM takes")
def lifecycle(t: Tables) -> DataFrame:
    return t.takes.select("session_id", "take_ord", R.lifecycle(F.col("rating")).alias("lifecycle"))


@query("m09_performance", "SELECT session_id, take_ord, CASE WHEN peak >= -7 AND snr >= 2.2 AND active >= 0.2 THEN 'sung_candidate' WHEN active >= 0.12 THEN 'spoken' ELSE 'undetermined' END AS kind, CASE WHEN peak >= -7 AND snr >= 2.2 AND active >= 0.2 THEN 0.55 WHEN active >= 0.12 THEN 0.66 ELSE 0.35 END AS confidence FROM metrics")
def performance(t: Tables) -> DataFrame:
    x = t.metrics.withColumn("x", R.performance(F.col("peak") + 14, F.col("snr"), F.col("active"), F.lit(False)))
    return x.select("session_id", "take_ord", "x.kind", "x.confidence")


@query("m16_capture_scene", "SELECT session_id, take_ord, CASE WHEN snr < 18 OR reverb > 0.6 OR active < 0.12 THEN 'constrained_voice' WHEN snr >= 24 AND reverb <= 0.45 AND active >= 0.18 THEN 'clean_voice' ELSE 'uncertain' END AS scene FROM metrics")
def capture_scene(t: Tables) -> DataFrame:
    return t.metrics.select("session_id", "take_ord", R.capture_scene(F.lit("spoken"), F.col("snr"), F.col("reverb"), F.col("active")).alias("scene"))


@query("m21_runtime_class", "SELECT event_id, CASE WHEN value / 100 <= 0.35 THEN 'fast' WHEN value / 100 <= 0.8 THEN 'moderate' ELSE 'constrained' END AS class FROM events")
def runtime_class(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.runtime_class(F.col("value") / 100).alias("class"))


@query("m15_coach_note", "SELECT take_id, coalesce(arg_min(gate_id, ord) FILTER (status = 'fail'), arg_min(gate_id, ord) FILTER (status = 'review'), 'none') AS note FROM gates GROUP BY take_id")
def coach_note(t: Tables) -> DataFrame:
    first = lambda s: F.min_by(F.when(F.col("status") == s, F.col("gate_id")), F.when(F.col("status") == s, F.col("ord")))
    return t.gates.groupBy("take_id").agg(F.coalesce(first("fail"), first("review"), F.lit("none")).alias("note"))


@query("g19_rights_status", "WITH s AS (SELECT c.speaker_id, bool_and(c.status = 'granted' AND c.evidence IS NOT NULL AND l.status = 'granted') AS ok FROM consents c LEFT JOIN licenses l ON c.license_id = l.license_id WHERE c.speaker_id < 8 GROUP BY c.speaker_id) SELECT x.speaker_id, CASE WHEN s.ok IS NULL THEN 'unknown' WHEN s.ok THEN 'resolved' ELSE 'blocked' END AS status FROM (SELECT DISTINCT speaker_id FROM takes) x LEFT JOIN s ON x.speaker_id = s.speaker_id")
def rights_status(t: Tables) -> DataFrame:
    valid = R.valid_right(F.col("status"), F.col("evidence")) & (F.col("l") == "granted")
    x = t.consents.where("speaker_id < 8").join(t.licenses.select("license_id", F.col("status").alias("l")), "license_id", "left")
    x = x.groupBy("speaker_id").agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("ok"))
    status = F.when(F.col("ok").isNull(), "unknown").when(F.col("ok"), "resolved").otherwise("blocked")
    return t.takes.select("speaker_id").distinct().join(x, "speaker_id", "left").select("speaker_id", status.alias("status"))


# ---- tables from text


@query("f04_long_segments", f"WITH w AS (SELECT doc_id, {W} AS ws FROM documents) SELECT doc_id, CAST(i // 24 AS BIGINT) AS chunk, array_to_string(ws[i + 1:i + 24], ' ') AS text FROM (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) > 32 THEN len(ws) ELSE 1 END, 24)) AS i FROM w WHERE len(ws) > 32)")
def long_segments(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", X.tokens_by_space("text").alias("ws")).where("size(ws) > 32")
    x = x.select("doc_id", "ws", F.explode(F.expr("sequence(0, size(ws) - 1, 24)")).alias("i"))
    return x.select("doc_id", F.floor(F.col("i") / 24).cast("long").alias("chunk"), F.array_join(F.slice("ws", F.col("i") + 1, 24), " ").alias("text"))


LABELLED = r"SELECT conv_id, turn, upper(role) || ': ' || text AS text FROM conversations"


@query("f05_strip_labels", rf"WITH l AS (SELECT *, regexp_extract(text, '^\s*([\p{{L}}\p{{N}}][\p{{L}}\p{{N}} _-]{{0,31}})\s*:\s+', 1) AS label FROM ({LABELLED})) SELECT conv_id, turn, label, trim(regexp_replace(text, '^\s*[\p{{L}}\p{{N}}][\p{{L}}\p{{N}} _-]{{0,31}}\s*:\s+', '')) AS text FROM l")
def strip_labels(t: Tables) -> DataFrame:
    from ..operators import corpus

    script = t.conversations.select("conv_id", "turn", F.concat(F.upper("role"), F.lit(": "), "text").alias("text"))
    return corpus.strip_speaker_labels(script, "conv_id").select("conv_id", "turn", "label", "text")


@query("f07_phrases", r"SELECT doc_id, i - 1 AS idx, ps[i] AS phrase FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?…]+[.!?…]*') AS ps FROM documents))")
def phrases(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[^.!?…]+[.!?…]*"), F.lit(0))
    return t.documents.select("doc_id", F.posexplode(found).alias("idx", "phrase")).withColumn("idx", F.col("idx").cast("long"))


@query("f03_pack_sentences")
def pack_sentences(t: Tables) -> DataFrame:
    from ..operators import corpus

    return corpus.pack_sentences(t.documents.select("doc_id", "text"), "doc_id")


@query("f02_subtitle_cues")
def subtitle_cues(t: Tables) -> DataFrame:
    """Turns of a conversation as one subtitle file each."""
    from ..operators import corpus

    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    cue = F.concat(F.lit("00:00:"), two(F.col("turn") * 2), F.lit(",000 --> 00:00:"), two(F.col("turn") * 2 + 1), F.lit(",500\n"), "text", F.lit("\n"))
    files = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n").alias("text"))
    return corpus.subtitle_cues(files, "conv_id")


@query("o01_manifest_reconcile", "WITH m AS (SELECT path, sha256, byte_size FROM files WHERE path NOT LIKE '%7.json'), f AS (SELECT path, sha256, CASE WHEN path LIKE '%3.json' THEN byte_size + 1 ELSE byte_size END AS byte_size FROM files WHERE path NOT LIKE '%5.json') SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing file' WHEN m.path IS NULL THEN 'unmanifested file' ELSE 'size differs' END AS error FROM m FULL JOIN f ON m.path = f.path WHERE m.path IS NULL OR f.path IS NULL OR m.byte_size <> f.byte_size")
def manifest_reconcile(t: Tables) -> DataFrame:
    from ..operators import package

    files = t.files.select("path", "sha256", "byte_size")
    held = files.where("path not like '%5.json'").withColumn("byte_size", F.when(F.col("path").like("%3.json"), F.col("byte_size") + 1).otherwise(F.col("byte_size")))
    return package.reconcile(files.where("path not like '%7.json'"), held)


@query("d20_dangling_references", "SELECT DISTINCT t.prompt_id FROM takes t LEFT JOIN (SELECT * FROM prompts WHERE language <> 'es') p ON t.prompt_id = p.prompt_id WHERE p.prompt_id IS NULL")
def dangling_references(t: Tables) -> DataFrame:
    return t.takes.select("prompt_id").distinct().join(t.prompts.where("language <> 'es'"), "prompt_id", "left_anti")


@query("j03_bounded_edit", "SELECT media_id, idx, least(3, levenshtein(a, b)) AS distance FROM neighbours")
def bounded_edit(t: Tables) -> DataFrame:
    from ..operators import rules

    return t.neighbours.select("media_id", "idx", rules.bounded_distance(F.col("a"), F.col("b"), 2).cast("long").alias("distance"))


@query("l08_array_rms", "SELECT vec_id, floor(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)) * 1e6 + 0.5) / 1e6 AS rms, floor(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) * 1e6 + 0.5) / 1e6 AS dc FROM embeddings")
def array_rms(t: Tables) -> DataFrame:
    wide = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda f: F.aggregate(wide, F.lit(0.0), lambda a, x: a + f(x))
    return t.embeddings.select("vec_id", N.js_round(F.sqrt(total(lambda x: x * x) / F.size("embedding")), 6).alias("rms"), N.js_round(total(lambda x: x) / F.size("embedding"), 6).alias("dc"))


@query("l16_array_gain", "SELECT vec_id, floor(list_sum(list_transform(embedding, lambda x: abs(least(greatest(CAST(x AS DOUBLE) * 3.5, -1.0), 1.0)))) * 1e6 + 0.5) / 1e6 AS loudness FROM embeddings")
def array_gain(t: Tables) -> DataFrame:
    gained = F.transform("embedding", lambda x: N.clamp(x.cast("double") * 3.5, -1.0, 1.0))
    return t.embeddings.select("vec_id", N.js_round(F.aggregate(gained, F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("loudness"))
