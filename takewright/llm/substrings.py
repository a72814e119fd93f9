"""Removal of passages that stand earlier in the corpus, by level-wise doubling of repeated windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

NO_ID = -(1 << 63)
#: Bits of an anchor's hash that are compared: a chance match lets a window through to the next level, where all 64 count.
FILTER = np.uint64((1 << 48) - 1)
OTHER = np.uint64(0xA0761D6478BD642F)  # makes a second hash of a word from its first


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, from the words' hashes, by doubling."""
    out, done = h, 1
    with np.errstate(over="ignore"):
        while done < length:
            step = min(done, length - done)
            out = common.mix64(out[: len(out) - step] * np.uint64(0x9E3779B97F4A7C15) + out[step:] + np.uint64(step))
            done += step
    return out


def anchors(base: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` consecutive base windows, the position of the smallest: equal runs have theirs at the same place."""
    view = np.lib.stride_tricks.sliding_window_view(base, span)
    return view.argmin(axis=1) + np.arange(len(view))


def earliest(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stand where their hash comes first, by (doc, at), and how many rows each hash has."""
    order = np.lexsort((at, doc, h))
    new = np.r_[True, h[order][1:] != h[order][:-1]] if len(order) else np.zeros(0, bool)
    first, count = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    groups = np.cumsum(new) - 1
    head = np.flatnonzero(new)[groups] if len(order) else order
    first[order] = (doc[order] == doc[order][head]) & (at[order] == at[order][head])
    count[order] = np.bincount(groups)[groups] if len(order) else 0
    return first, count


def apart(doc: np.ndarray) -> np.ndarray:
    """Keys for rows whose fate is known already: they lie with the others of their document, where equal keys take little room."""
    return common.mix64(doc.astype(np.uint64) + np.uint64(0x51ED27))


def lengths(length: int, shortest: int) -> list[int]:
    """The lengths of the levels: doubling from ``shortest``, up to ``length``."""
    found = [min(shortest, length)]
    while found[-1] < length:
        found.append(min(2 * found[-1], length))
    return found


def repeated_starts(docs: DataFrame, length: int, shortest: int) -> DataFrame:
    """(doc, starts): the starts of windows of ``length`` words whose words also stand earlier, by document.

    Level by level windows are twice as long, from ``shortest`` words on.  Of the windows of a level that lie in a full one only that with the smallest hash is
    looked at, its anchor, which equal full windows share; an anchor that occurs once rules out all full windows that have it, and only those of
    repeated anchors are extended to the next level, where they are compared again, until none survives or the full length is reached.  All levels
    read one shuffle of the texts.  Within a batch a worker keeps the earliest of equal windows and knows the others to be late, so that a window, however common, sends one row per batch.
    """
    levels = lengths(length, shortest)

    def candidates(h: np.ndarray, n: int, kept: np.ndarray) -> np.ndarray:
        """Full windows whose anchor of ``n`` words is among ``kept``."""
        base = windows(h, n)
        mark = np.zeros(len(base), bool)
        mark[kept[kept < len(base)]] = True  # rows that share a doc_id can differ in length
        return mark[anchors(base, length - n + 1)]

    def texts_of(batch: pa.RecordBatch, hashes: common.WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        kept = batch.column("kept") if "kept" in batch.schema.names else [None] * batch.num_rows
        for doc, text, at in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), kept, strict=True):
            if at is None or at.is_valid:
                words = common.split_words(text or "")
                if len(words) >= length:
                    yield doc, hashes.of(words), None if at is None else at.values.to_numpy()

    def anchored(n: int, before: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = common.WordHashes()
            for batch in common.slices(batches, most=16 << 20):
                hashes.forget()
                found = []
                for doc, h, kept in texts_of(batch, hashes):
                    base = windows(h, n)
                    at = anchors(base, length - n + 1)
                    at = np.unique(at if kept is None else at[candidates(h, before, kept)])
                    found.append((base[at], np.full(len(at), doc), at))
                if found:
                    h, doc, at = map(np.concatenate, zip(*found, strict=True))
                    first, count = earliest(h, doc, at)
                    key = (np.where(first, h, apart(doc)) & FILTER).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(np.minimum(count, 2).astype(np.int32))], names=["h", "doc", "at", "n"])

        return level

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in common.slices(batches, most=16 << 20):
            hashes.forget()
            found = []
            for doc, h, kept in texts_of(batch, hashes):
                at = np.arange(len(h) - length + 1) if kept is None else np.flatnonzero(candidates(h, levels[-2], kept))
                if len(at):
                    found.append((windows(h, length)[at], windows(common.mix64(h ^ OTHER), length)[at] >> np.uint64(33), np.full(len(at), doc), at))
            if found:
                h, check, doc, at = map(np.concatenate, zip(*found, strict=True))
                first, _ = earliest(h ^ (check << np.uint64(33)), doc, at)
                key = np.where(first, h, apart(doc)).view(np.int64)
                # a place and, below it, 31 bits that equal windows share too; a late window's place is told as a negative number
                place = np.where(first, (at.astype(np.int64) << 32) | check.astype(np.int64), -1 - at)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(place)], names=["h", "doc", "place"])

    kept, before = None, 0
    for n in levels[:-1]:
        asked = docs if kept is None else docs.join(kept, "doc", "left")
        met = asked.mapInArrow(anchored(n, before), "h long, doc long, at int, n int")
        met = met.withColumn("n", F.sum("n").over(Window.partitionBy("h"))).where("n > 1")
        kept, before = met.groupBy("doc").agg(F.collect_list("at").alias("kept")), n
    asked = docs if kept is None else docs.join(kept, "doc", "left")
    found = asked.mapInArrow(whole, "h long, doc long, place long").repartition("h")
    found = found.withColumn("at", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.shiftright("place", 32)).cast("int"))
    found = found.withColumn("check", F.when(F.col("place") < 0, -1).otherwise(F.col("place").bitwiseAND((1 << 32) - 1)))
    place = F.struct("doc", "at")
    first = F.min(place).over(Window.partitionBy("h", "check"))
    late = found.withColumn("first", first).where((F.col("place") < 0) | (F.col("first") < place))
    return late.groupBy("doc").agg(F.collect_list("at").alias("starts"))


def dedup(docs: DataFrame, length: int = 20, texts: bool = False, shortest: int = 5) -> DataFrame:
    """Remove each word covered by a window of ``length`` words whose words also start earlier in the corpus.

    Earlier means a smaller doc_id, or the same document and an earlier start; all windows are judged on the input.  Returns
    ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words, joined by a space) and with ``texts`` also
    ``kept``.  Words are runs of characters other than space and U+0009 to U+000D, compared unchanged, by two hashes of whole windows, 95 bits together.
    Windows are found by doubling from ``shortest`` words (``repeated_starts``); longer repeats than ``length`` are covered by windows of it.

    Null text has no words.  A null doc_id comes first.  Rows that repeat a doc_id are one document: the same start is not earlier
    than itself, and a start removed in one of them is removed in all.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text")).repartition("doc")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, most=16 << 20):
            out: list[tuple] = []
            for doc, text, starts in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("starts"), strict=True):
                words, removed = common.split_words(text or ""), 0
                kept = words
                if starts.is_valid and len(words) >= length:
                    at = starts.values.to_numpy()
                    edges = np.zeros(len(words) + 1, np.int32)
                    at = at[at <= len(words) - length]
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + length, -1)
                    covered = np.cumsum(edges[:-1]) > 0
                    removed = int(covered.sum())
                    kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                joined = " ".join(kept)
                out.append((None if doc == NO_ID else doc, len(words), removed, hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest(), joined if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    found = rows.join(repeated_starts(rows, length, shortest), "doc", "left").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return found if texts else found.drop("kept")
