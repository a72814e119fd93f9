"""Bounded samples of labelled documents to fit a classifier on."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id's text, modulo ``modulus``; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, kept_back: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == kept_back, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, most_bytes: int = 64 << 20) -> tuple[DataFrame, float]:
    """(text, y): texts and labels (0, 1) of ``per_class`` documents of each class at most, whose texts take ``most_bytes`` a class at most; and
    the share of label 1 among all that may be learned from.

    ``train`` says of ``labels`` rows which may be used.  Of each class those come whose md5 is smallest, so that a rerun takes the same.
    Null doc_ids, other labels and documents without a row are left out; of repeated rows one counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(train & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = [rows.where(F.col("y") == y).orderBy(order).limit(per_class) for y in (0, 1)]
    # two classes of per_class ids: small enough to send to every task
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(ids, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(order, "doc_id"))
    texts = texts.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "text", "y")
    total = sum(counts.values())
    return texts, counts.get(1, 0) / total if total else 0.5


def fitted(sample: DataFrame, prior: float, fit: Callable[[list[tuple[str, int]], float], Any]) -> Any:
    """What ``fit`` makes of a sample of bounded size: it runs in one task, and the driver gets the model alone."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        for batch in batches:
            rows += zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, prior))], pa.binary())], names=["model"])

    made = sample.repartition(1).sortWithinPartitions("doc_id").select("text", "y").mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], prior)
