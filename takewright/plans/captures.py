"""Queries of captures: adaptive analyses, device settings, levels and spectra, live folds, local corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adaptive, alignment, capture, corpus
from ..streaming import live, recorder
from .base import CTES, ENTITIES, Tables, query
from .kernels import _turns


def _lines(t: Tables) -> DataFrame:
    """A row for each order and line: where both repeat, the largest of each column."""
    return t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("take_id")).agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_returnflag")))


def _heard(t: Tables) -> DataFrame:
    """Takes as they were measured: sung, spoken and possibly sung ones, some of them long, some with a stored real-time factor."""
    kind = F.when(F.col("l_returnflag") == "R", "sung").when(F.col("l_returnflag") == "A", "sung_candidate").otherwise("spoken")
    d = lambda c: F.col(c).cast("double")
    snr = F.when(F.col("l_partkey") % 11 != 0, 8 + d("l_quantity") / 2)
    return _lines(t).select("take_id", kind.alias("kind"), snr.alias("snr"), (d("l_discount") * 7).alias("reverb"), (d("l_tax") * 8).alias("active"), ((F.col("l_suppkey") % 397 + 1) * 1000).cast("long").alias("duration_ms"), F.when(F.col("l_partkey") % 2 == 0, d("l_discount") * 10).alias("factor"))


def _readings(t: Tables) -> DataFrame:
    """Four readings of each take, of which each hears more of its words, and at most the second pays with time."""
    q, p = F.col("l_quantity").cast("long"), F.col("place")
    rows = _lines(t).select("take_id", "l_quantity", "l_partkey", "l_suppkey", F.posexplode(F.array(*map(F.lit, adaptive.READINGS))).alias("place", "reading"))
    words = F.when(F.col("l_partkey") % 13 == 0, p).otherwise(q + p - 1)
    expected = F.when(F.col("l_partkey") % 5 == 0, F.lit(0)).otherwise(q)
    status = F.element_at(F.array(*map(F.lit, ["strong", "acceptable", "review", "insufficient"])), ((F.col("l_suppkey") + p) % 4 + 1).cast("int"))
    return rows.select(
        "take_id", "reading", words.cast("long").alias("words"), expected.cast("long").alias("expected"), F.least(expected, words, q - F.col("l_suppkey") % 4 + p).cast("long").alias("matched"), ((F.col("l_partkey") % 8 + p) / 11).alias("supported"),
        (q * 400 - (F.col("l_partkey") % 3) * q * 180).cast("long").alias("speech_ms"), (F.col("l_partkey") % 7).cast("long").alias("segments"), status.alias("alignment"), ((F.col("l_suppkey") + p) % 6).cast("long").alias("run"), ((p + 1) * 20000 + F.col("l_partkey") % 97 * 1000).cast("double").alias("elapsed_ms"),
    )


CTES["take_lines"] = "SELECT l_orderkey * 10 + l_linenumber AS take_id, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1"
ENTITIES |= {"heard_takes": _heard, "readings": _readings}
CTES["heard_takes"] = "SELECT take_id, CASE l_returnflag WHEN 'R' THEN 'sung' WHEN 'A' THEN 'sung_candidate' ELSE 'spoken' END AS kind, CASE WHEN l_partkey % 11 <> 0 THEN 8 + CAST(l_quantity AS DOUBLE) / 2 END AS snr, CAST(l_discount AS DOUBLE) * 7 AS reverb, CAST(l_tax AS DOUBLE) * 8 AS active, CAST((l_suppkey % 397 + 1) * 1000 AS BIGINT) AS duration_ms, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_discount AS DOUBLE) * 10 END AS factor FROM take_lines"
CTES["readings"] = """SELECT take_id, reading, place, words, expected, least(expected, words, q - l_suppkey % 4 + place) AS matched, (l_partkey % 8 + place) / 11.0 AS supported, q * 400 - (l_partkey % 3) * q * 180 AS speech_ms, l_partkey % 7 AS segments,
    ['strong', 'acceptable', 'review', 'insufficient'][(l_suppkey + place) % 4 + 1] AS alignment, (l_suppkey + place) % 6 AS run, CAST((place + 1) * 20000 + l_partkey % 97 * 1000 AS DOUBLE) AS elapsed_ms
    FROM (SELECT *, CASE WHEN l_partkey % 13 = 0 THEN place ELSE q + place - 1 END AS words, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE q END AS expected
      FROM (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS q, unnest([0, 1, 2, 3]) AS place, unnest(['tiny', 'base', 'focus', 'separated']) AS reading FROM take_lines))"""

SCORE = """CASE WHEN expected = 0 THEN supported * 2.5 + least(words, 24) / 80.0 ELSE CAST(matched AS DOUBLE) / expected * 4 + CASE alignment WHEN 'strong' THEN 1.0 WHEN 'acceptable' THEN 0.78 WHEN 'review' THEN 0.42 ELSE 0.0 END * 1.6
    + greatest(0.0, 1 - abs(words - expected) / CAST(expected AS DOUBLE)) * 0.8 + supported * 0.6 END + CASE WHEN place > 0 THEN 0.12 ELSE 0.0 END - CASE WHEN words / (speech_ms / 60000.0) > 360 THEN 1.5 ELSE 0.0 END - CASE WHEN run >= 4 THEN 1.0 ELSE 0.0 END"""
ADAPTIVE = f"""WITH scored AS (SELECT *, CAST({SCORE} AS DOUBLE) AS score FROM readings),
    seen AS (SELECT *, CASE WHEN kind IN ('sung', 'sung_candidate') THEN 'sung_voice' WHEN snr < 18 OR reverb > 0.6 OR active < 0.12 THEN 'constrained_voice' WHEN kind = 'spoken' AND coalesce(snr >= 24, true) AND reverb <= 0.45 AND active >= 0.18 THEN 'clean_voice' ELSE 'uncertain' END AS scene FROM heard_takes),
    first AS (SELECT s.*, r.elapsed_ms, CASE WHEN r.segments = 0 THEN scene = 'sung_voice' WHEN scene <> 'clean_voice' THEN true WHEN words = 0 THEN true WHEN expected = 0 THEN false ELSE CAST(matched AS DOUBLE) / expected < 0.9 OR alignment NOT IN ('strong', 'acceptable') END AS again FROM seen s JOIN readings r ON s.take_id = r.take_id AND r.place = 0),
    paced AS (SELECT f.*, floor(greatest(f.elapsed_ms, coalesce(r.elapsed_ms, 0)) / f.duration_ms * 1000 + 0.5) / 1000 AS measured FROM first f LEFT JOIN readings r ON f.take_id = r.take_id AND r.place = 1 AND f.again),
    planned AS (SELECT *, CASE WHEN scene = 'clean_voice' THEN 1 WHEN duration_ms > 300000 OR measured > 0.8 OR (measured > 0.35 AND duration_ms > 120000) THEN 2 ELSE 3 END AS budget FROM paced),
    asked AS (SELECT *, scene <> 'clean_voice' AND budget >= 2 AND duration_ms <= 300000 AS focused FROM planned),
    told AS (SELECT a.take_id, a.scene, a.budget, s.* EXCLUDE (take_id) FROM asked a JOIN scored s ON a.take_id = s.take_id AND (s.place = 0 OR (s.place = 1 AND a.again) OR (s.place = 2 AND a.focused) OR (s.place = 3 AND a.focused AND a.budget >= 3 AND (a.scene = 'sung_voice' OR coalesce(a.snr, 99) < 16))))
    SELECT take_id, any_value(scene) AS scene, any_value(budget) AS budget, CASE WHEN max(place) = 3 THEN 'deep' WHEN count(*) > 1 THEN 'verified' ELSE 'fast' END AS depth, arg_max(reading, (score, -place)) AS reading,
      CASE WHEN count(*) = 1 THEN 'fast_path_sufficient' WHEN bool_or(expected > 0) THEN 'prompt_match' ELSE 'acoustic_support' END AS reason, CASE WHEN count(*) = 1 THEN 1.0 ELSE floor(max(score) * 1000 + 0.5) / 1000 END AS score,
      arg_max(words, (score, -place)) AS words, arg_max(matched, (score, -place)) AS matched, string_agg(reading, ',' ORDER BY place) AS readings FROM told GROUP BY take_id"""


@query("n12_p04_p05_adaptive_analysis", ADAPTIVE)
def adaptive_analysis(t: Tables) -> DataFrame:
    return adaptive.analyze(t.heard_takes, adaptive.from_table(t.readings))


SPECTRUM = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 700) AS BIGINT) % 256)"
BAND = "CASE WHEN {1} > {0} THEN least(1.0, power(list_sum(s[{0} + 1:{1}]) / CAST({1} - {0} AS DOUBLE) / 255, 0.7)) ELSE 0.0 END AS {2}"
FIELD = "SELECT vec_id, " + ", ".join(BAND.format(f"CAST(ceil({low} / hz) AS BIGINT)", f"least(len(s), CAST(floor({high} / hz) AS BIGINT) + 1)", name) for name, (low, high) in capture.BANDS.items()) + f" FROM (SELECT vec_id, {SPECTRUM} AS s, (8000 + vec_id % 5 * 10000) / 128.0 AS hz FROM embeddings)"


@query("i24_acoustic_field", "SELECT vec_id, " + ", ".join(f"round({b}, 9) AS {b}" for b in capture.BANDS) + f" FROM ({FIELD})")
def acoustic_field(t: Tables) -> DataFrame:
    """The field of spectra of 64 bins at rates from 8 to 48 kHz."""
    s = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 700) % 256)
    x = t.embeddings.select("vec_id", capture.acoustic_field(s, F.lit(8000) + F.col("vec_id") % 5 * 10000, F.lit(128)).alias("f"))
    return x.select("vec_id", *(F.round(f"f.{b}", 9).alias(b) for b in capture.BANDS))


@query("q67_level", "SELECT vec_id, round(greatest(0.0, least(1.0, greatest((20 * log10(greatest(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 0.000001)) + 60) / 45, (20 * log10(greatest(list_max(list_transform(v, lambda x: abs(x))), 0.000001)) + 36) / 36 * 0.78))), 9) AS level FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (1 + vec_id % 100)) AS v FROM embeddings)")
def level(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") / (1 + F.col("vec_id") % 100))
    return t.embeddings.select("vec_id", F.round(capture.level(v), 9).alias("level"))


@query("q68_q75_capture_provenance", """SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 = 0 THEN 2 WHEN c_custkey % 4 = 1 THEN 1 END AS DOUBLE) AS channels, CASE WHEN trim(c_name) <> '' AND c_custkey % 3 <> 0 THEN c_name END AS label, CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 5 = 1 THEN false END AS echo,
    CASE WHEN c_acctbal > 0 THEN true ELSE false END AS noise, c_nationkey % 2 = 0 AS resampled FROM customer""")  # fmt: skip
def capture_provenance(t: Tables) -> DataFrame:
    """Settings with numbers, texts and nothing where true or false is due, and blank labels."""
    i = F.col("c_custkey")
    channels = F.when(i % 4 == 0, F.lit("2")).when(i % 4 == 1, F.lit("1")).otherwise(F.lit("null"))
    echo = F.when(i % 5 == 0, F.lit("true")).when(i % 5 == 1, F.lit("false")).when(i % 5 == 2, F.lit("1")).otherwise(F.lit("null"))
    noise = F.when(F.col("c_acctbal") > 0, F.lit("true")).otherwise(F.lit("false"))
    json = F.concat(F.lit('{"channelCount":'), channels, F.lit(',"echoCancellation":'), echo, F.lit(',"noiseSuppression":'), noise, F.lit("}"))
    p = capture.capture_provenance(json, F.when(i % 3 != 0, F.col("c_name")).otherwise(" "), F.when(F.col("c_nationkey") % 2 == 0, 44_100).otherwise(48_000))
    x = t.customer.select("c_custkey", p.alias("p"))
    return x.select("c_custkey", "p.channels", "p.label", F.col("p.processing.echoCancellation").alias("echo"), F.col("p.processing.noiseSuppression").alias("noise"), "p.resampled")


@query("q78_q52_media_and_budget", "SELECT prompt_id, CASE WHEN words % 3 <> 0 THEN sha256(text) END AS sha256, CASE WHEN words % 2 = 0 THEN intent END AS scene, CASE WHEN words % 2 = 0 THEN words END AS budget FROM prompts")
def media_and_budget(t: Tables) -> DataFrame:
    schema = F.when(F.col("words") % 3 == 0, "voice.media.v0").otherwise(capture.MEDIA)
    media = capture.read_media(schema, F.sha2("text", 256))
    strategy = capture.with_budget(F.when(F.col("words") % 2 == 0, F.struct(F.col("intent").alias("scene"))), F.col("words"))
    return t.prompts.select("prompt_id", media.alias("sha256"), strategy["scene"].alias("scene"), strategy["runtime"].alias("budget"))


@query("a01_local_corpora")
def local_corpora(t: Tables) -> DataFrame:
    """Summaries of corpora made of documents, a subtitle file's name for some; tests hold ids and numbers against brute force."""
    scripts = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 3 != 0, "script.txt").otherwise(" ").alias("source_name"))
    return corpus.local_corpora(scripts, "doc_id", "voice")[1]


@query("j13_q103_prompt_positions")
def prompt_positions(t: Tables) -> DataFrame:
    """How far into its prompt each turn has come."""
    return alignment.dealt(_turns(t)).select("conv_id", "turn", alignment.align_spoken("expected", "observed").getField("position").alias("position"))


@query("n10_frame_pace")
def frame_pace(t: Tables) -> DataFrame:
    """Each user's events as frames, whose gaps are 1 to 300 ms; tests hold it against a plain loop."""
    from pyspark.sql import Window

    gap = F.floor(F.col("value") * F.when(F.col("event_type") == "error", 4).otherwise(0.2)) % 300 + 1
    at = F.sum(gap).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return live.frame_paces(t.events.select("user_id", "event_id", at.cast("double").alias("at"))).select("user_id", "event_id", F.round("mean", 6).alias("mean"), "slow")


ENDS = """WITH x AS (SELECT user_id, event_id, event_type = 'purchase' AS final, event_type = 'click' AS active, user_id % 2 = 0 AS expressive, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at FROM events),
    y AS (SELECT *, min(CASE WHEN final THEN at END) OVER (PARTITION BY user_id ORDER BY at, event_id ROWS UNBOUNDED PRECEDING) AS confirmed, count(*) FILTER (active) OVER (PARTITION BY user_id ORDER BY at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM x),
    z AS (SELECT *, CASE WHEN active THEN 0 ELSE at - min(CASE WHEN NOT active THEN at END) OVER (PARTITION BY user_id, island) END AS quiet, CASE WHEN expressive THEN 640 ELSE 520 END AS settle, CASE WHEN expressive THEN 1900 ELSE 1550 END AS failsafe FROM y)
    SELECT user_id, event_id, coalesce(at - confirmed >= settle AND ((NOT active AND quiet >= settle) OR at - confirmed >= failsafe), false) AS ready FROM z"""


@query("n02_endpoints", ENDS.replace(" AS at ", " AS spot ").replace("THEN at ", "THEN spot ").replace("BY at,", "BY spot,").replace("at - ", "spot - "))
def endpoints(t: Tables) -> DataFrame:
    """Whether each user's capture may stop after each event: purchases confirm the end, clicks are speech."""
    from pyspark.sql import Window

    at = F.sum(F.floor("value")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = t.events.select("user_id", "event_id", at.cast("double").alias("at"), (F.col("event_type") == "purchase").alias("final"), (F.col("event_type") == "click").alias("active"), (F.col("user_id") % 2 == 0).alias("expressive"))
    return live.endpoints(x)


RECORDED = """WITH x AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, sum(CAST(floor(value * 3) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ms, value FROM events),
    g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY media_id ORDER BY ms, seq) > 500 THEN 1 ELSE 0 END AS starts FROM x),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY media_id ORDER BY ms, seq) AS n FROM g),
    s AS (SELECT media_id, n, seq, unnest(range(0, 16)) AS i, value FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY media_id, n ORDER BY seq, i) AS place, (CAST(floor(value * 100) AS BIGINT) * 7 + i * 131) % 2001 / 1000.0 - 1 AS v FROM s)
    SELECT media_id, min(seq) AS first_seq, count(DISTINCT seq) AS batches, count(*) FILTER (place <= 100) AS samples, count(*) > 100 AS truncated, round(sqrt(avg(CAST(v * v AS DOUBLE)) FILTER (place <= 100)), 6) AS rms, round(max(abs(CAST(v AS DOUBLE))) FILTER (place <= 100), 6) AS peak FROM k GROUP BY media_id, n"""


@query("n03_recordings", RECORDED)
def recorded_batches(t: Tables) -> DataFrame:
    """Each user's events as batches of 16 samples, 0 to 0.9 s apart, as recordings of 100 samples at most."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.floor(F.col("value") * 100) * 7 + i * 131) % 2001 / 1000.0 - 1)
    x = t.events.select(F.col("user_id").alias("media_id"), F.row_number().over(order).cast("long").alias("seq"), F.timestamp_millis(F.sum(F.floor(F.col("value") * 3)).over(order)).alias("at"), v.alias("samples"))
    return recorder.record(x, most=100)
