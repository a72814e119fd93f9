"""Registration of queries, and the driver tables seen as the library's entities.

``ENTITIES`` binds prompts, takes, gates, word timings and the like to the driver's tables; ``CTES`` says the same for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_word

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by attribute, and the entities by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ENTITIES:
            return ENTITIES[name](self)
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables``; ``sql`` may use the entities' names."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_entities(sql)
        return f

    return register


def with_entities(sql: str) -> str:
    """``sql`` after the CTEs of the entities that it names, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(sql)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:].strip()}"
    return f"WITH {ctes}, {body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


PACES = ["slow", "medium", "fast", "medium_fast", "urgent"]
ENERGIES = ["low", "medium", "high"]
INTENTS = ["calm", "assertive", "question", "surprise", "narrative", "soft", "thinking"]
RATINGS = ["keeper", "maybe", "reject", "unreviewed"]
GATES = ["clipping", "snr", "headroom", "transcript_match", "reverb", "duration", "room_tone"]


def _prompts(t: Tables) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    return t.documents.select(F.col("doc_id").alias("prompt_id"), F.col("lang").alias("language"), F.col("source").alias("scenario_id"), "text", words.alias("words"), pick(PACES, F.col("doc_id") % 5).alias("pace"), pick(ENERGIES, F.col("doc_id") % 3).alias("energy"), pick(INTENTS, F.col("doc_id") % 7).alias("intent"))


def _takes(t: Tables) -> DataFrame:
    count = t.documents.agg(F.count("*").alias("prompts"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    rows = t.conversations.crossJoin(F.broadcast(count))  # one row
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("take_ord"), (F.col("conv_id") % 10).alias("speaker_id"), ((F.col("conv_id") * 31 + F.col("turn")) % F.col("prompts")).alias("prompt_id"), pick(RATINGS, (F.col("conv_id") + F.col("turn")) % 4).alias("rating"), "role", "text", words.alias("words"), (words * 400).alias("duration_ms"))


def _metrics(t: Tables) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return t.lineitem.select(
        F.col("l_orderkey").cast("long").alias("session_id"), F.col("l_linenumber").cast("long").alias("take_ord"), (-d("l_quantity")).alias("peak"), (-(d("l_quantity") + d("l_discount") * 100)).alias("rms"), (-60 - d("l_tax") * 100).alias("floor"),
        (-(d("l_quantity") / 2 + d("l_discount") * 100)).alias("lufs"), (d("l_quantity") / 50).alias("active"), (d("l_discount") * 10).alias("reverb"), (d("l_tax") / 4).alias("dc"), (d("l_quantity") - d("l_tax") * 100).alias("snr"), (F.col("l_partkey") % 40 == 0).alias("clipping"), ((F.col("l_suppkey") % 9000) + 200).cast("long").alias("duration_ms"),
    )


def _gates(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "N", "review").otherwise("fail")
    return t.lineitem.select(F.col("l_orderkey").cast("long").alias("take_id"), F.col("l_linenumber").cast("long").alias("ord"), pick(GATES, F.col("l_linenumber") - 1).alias("gate_id"), status.alias("status"))


def by_medium(rows: DataFrame) -> DataFrame:
    """``rows`` of texts, or of a number a medium, dealt by ``media_id``: all alike, so that what is made of them meets where it is, and in three parts for
    each of the session's, as the words of a text take more room than it does when they are sorted."""
    return rows.repartition(3 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "media_id")


def _word_timings(t: Tables) -> DataFrame:
    """Words of each document one after another, 80 ms a letter and 90 ms a letter apart.

    Texts are dealt by medium before they are split, once for all uses of a query; what is grouped or ordered by medium then needs no words to be sent.
    """
    texts = by_medium(t.documents.select(F.col("doc_id").alias("media_id"), "text"))
    rows = texts.select("media_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("idx", "word")).withColumn("idx", F.col("idx").cast("long"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.length("word")).over(Window.partitionBy("media_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # ordered by the number as it is told, so that what is ordered by it later needs no other sort
    return rows.select("media_id", "idx", "word", (before * 90).alias("start_ms"), (before * 90 + F.length("word") * 80).cast("long").alias("end_ms"))


def _speech_segments(t: Tables) -> DataFrame:
    """1.1 s of speech in every 1.5 s, as far as the text goes; dealt by medium while it is a number a medium."""
    n = F.floor(F.length("text") * 75 / 1500).cast("long")
    media = by_medium(t.documents.select(F.col("doc_id").alias("media_id"), n.alias("n")))
    rows = media.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i"))
    return rows.select("media_id", (F.col("i") * 1500).alias("start_ms"), (F.col("i") * 1500 + 1100).alias("end_ms"))


def _frames(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(F.col("user_id").alias("media_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (-F.col("value") / 3).alias("level"), F.least(F.lit(1.0), F.col("value") / 200).alias("p"))


def _consents(t: Tables) -> DataFrame:
    status = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "granted").when(F.col("c_mktsegment") == "AUTOMOBILE", "revoked").otherwise("unknown")
    return t.customer.select(F.col("c_custkey").cast("long").alias("consent_id"), (F.col("c_custkey") % 10).cast("long").alias("speaker_id"), status.alias("status"), F.when(F.col("c_acctbal") >= 0, F.lit("signed form")).alias("evidence"), F.col("c_nationkey").cast("long").alias("license_id"))


def _licenses(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("license_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 3, "granted").otherwise("unknown").alias("status"))


def _files(t: Tables) -> DataFrame:
    return t.documents.select(F.concat(F.lit("text/"), F.col("doc_id"), F.lit(".json")).alias("path"), "text", F.octet_length("text").cast("long").alias("byte_size"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("owner"))


def _neighbours(t: Tables) -> DataFrame:
    """Each word that has letters or digits with the next such one: in small letters, without marks."""
    from pyspark.sql import Window

    x = t.word_timings.select("media_id", "idx", ascii_word("word").alias("a")).where("a <> ''")
    return x.withColumn("b", F.lead("a").over(Window.partitionBy("media_id").orderBy("idx"))).where("b is not null")


ENTITIES: dict[str, Callable[[Tables], DataFrame]] = {"prompts": _prompts, "takes": _takes, "metrics": _metrics, "gates": _gates, "word_timings": _word_timings, "neighbours": _neighbours, "speech_segments": _speech_segments, "frames": _frames, "consents": _consents, "licenses": _licenses, "files": _files}

_WORDS = r"CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT)"


def _pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} + 1]"


CTES = {
    "prompts": f"SELECT doc_id AS prompt_id, lang AS language, source AS scenario_id, text, {_WORDS} AS words, {_pick(PACES, 'doc_id % 5')} AS pace, {_pick(ENERGIES, 'doc_id % 3')} AS energy, {_pick(INTENTS, 'doc_id % 7')} AS intent FROM documents",
    "takes": f"SELECT conv_id AS session_id, turn AS take_ord, conv_id % 10 AS speaker_id, (conv_id * 31 + turn) % (SELECT count(*) FROM documents) AS prompt_id, {_pick(RATINGS, '(conv_id + turn) % 4')} AS rating, role, text, {_WORDS} AS words, {_WORDS} * 400 AS duration_ms FROM conversations",
    "metrics": "SELECT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS take_ord, -CAST(l_quantity AS DOUBLE) AS peak, -(l_quantity + l_discount * 100) AS rms, -60 - l_tax * 100 AS floor, -(l_quantity / 2 + l_discount * 100) AS lufs, l_quantity / 50 AS active, l_discount * 10 AS reverb, l_tax / 4 AS dc, l_quantity - l_tax * 100 AS snr, l_partkey % 40 = 0 AS clipping, CAST(l_suppkey % 9000 + 200 AS BIGINT) AS duration_ms FROM lineitem",
    "gates": f"SELECT l_orderkey AS take_id, CAST(l_linenumber AS BIGINT) AS ord, {_pick(GATES, '(l_linenumber - 1)')} AS gate_id, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'review' ELSE 'fail' END AS status FROM lineitem",
    "word_timings": r"SELECT media_id, idx, word, CAST(before * 90 AS BIGINT) AS start_ms, CAST(before * 90 + length(word) * 80 AS BIGINT) AS end_ms FROM (SELECT *, coalesce(sum(length(word)) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT media_id, generate_subscripts(words, 1) - 1 AS idx, unnest(words) AS word FROM (SELECT doc_id AS media_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents)))",
    "neighbours": "SELECT * FROM (SELECT *, lead(a) OVER (PARTITION BY media_id ORDER BY idx) AS b FROM (SELECT media_id, idx, regexp_replace(lower(strip_accents(word)), '[^a-z0-9]', '', 'g') AS a FROM word_timings) WHERE a <> '') WHERE b IS NOT NULL",
    "speech_segments": "SELECT media_id, i * 1500 AS start_ms, i * 1500 + 1100 AS end_ms FROM (SELECT doc_id AS media_id, unnest(range(0, CAST(floor(length(text) * 75 / 1500) AS BIGINT) + 1)) AS i FROM documents)",
    "frames": "SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, -value / 3 AS level, least(1.0, value / 200) AS p FROM events",
    "consents": "SELECT c_custkey AS consent_id, CAST(c_custkey % 10 AS BIGINT) AS speaker_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'granted' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'revoked' ELSE 'unknown' END AS status, CASE WHEN c_acctbal >= 0 THEN 'signed form' END AS evidence, CAST(c_nationkey AS BIGINT) AS license_id FROM customer",
    "licenses": "SELECT CAST(n_nationkey AS BIGINT) AS license_id, n_name AS name, CASE WHEN n_regionkey < 3 THEN 'granted' ELSE 'unknown' END AS status FROM nation",
    "files": "SELECT 'text/' || doc_id || '.json' AS path, text, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size, sha256(text) AS sha256, source AS owner FROM documents",
}
