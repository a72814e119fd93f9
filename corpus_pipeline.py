"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takewright.llm import common, jaccard, mixing, packing, sampling, secrets, toxicity

TOKENIZER = "byte_bpe_50k.json"
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on labelled documents of the input, scores below the threshold.

    Null and wordless texts score 0 and stay, repeated rows stay each; where no label of both classes is there, all stay (the share of toxic
    documents being below the threshold) and an empty table stays empty.
    """
    labels = common.table(spark, sf_dir, "labels")
    net = sampling.fitted(*sampling.labelled(docs, labels, "toxic", F.lit(True), 1500), toxicity.fit)
    into = common.fresh(docs, "toxicity")
    scored = toxicity.score(docs.withColumn("text", F.col("text").cast("string")), net, into=into)
    return scored.where(F.col(into) < TOXIC).select(*map(common.named, docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, the one with the smallest doc_id (null first); of its repeated rows, one.

    Texts without words, null ones too, are in no group and stay, one of each doc_id and text; an empty table stays empty.
    """
    return jaccard.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kinds, and ``n_chars`` that of the new text; null texts keep theirs, an empty table stays empty."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*map(common.named, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that the mix does not take goes.  Null sources are a source, null texts have size 0; an empty table stays empty."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null text is one piece, an empty table has none."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The first stage's network cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
